"""Registered queries: sources, projections, filters, joins, summaries, series."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs, vocab
from ..operators import aggregates as A
from ..operators import names as N
from ..operators import ordering as O
from ..operators import planning as P
from ..operators import schema as S
from ..operators import season as W
from ..operators import timeline as L
from ..operators.scaling import attach_group_means, fit_scaler, min_max_scale
from ..operators.scaling import apply_scaler
from ..operators.suitability import forecast_means, success_or_all
from ..sources import payloads, readers, selection, sinks
from . import fixtures as X
from .fixtures import table
from .registry import query
from .storage import new_folder


def rounded(df, *names, digits=6):
    return df.withColumns({n: exprs.half_even(n, digits) for n in names})


def r(names, digits=6):
    """SQL: the names rounded."""
    return ", ".join(f"round_even({n}, {digits}) AS {n}" for n in names)


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# --- sources ---------------------------------------------------------------------

DAILY = ["temp", "min_temp", "max_temp", "rainfall", "humidity"]


@query("json_param_map_to_daily", f"""
SELECT site_id, date, {r(DAILY)} FROM ({X.FORECAST})""")
def json_param_map_to_daily(spark, folder):
    """One payload per site, unpacked again. A site's map has one entry per day."""
    days = rounded(X.forecast(spark, folder), *DAILY)
    code = {v: k for k, v in payloads.PARAMETERS.items()}
    day = F.date_format("date", "yyyyMMdd")
    packed = days.groupBy("site_id").agg(
        *[F.map_from_entries(F.collect_list(F.struct(day, F.col(m)))).alias(code[m]) for m in DAILY]
    )
    params = F.map_from_arrays(
        F.array(*[F.lit(code[m]) for m in DAILY]), F.array(*[F.col(code[m]) for m in DAILY])
    )
    body = packed.select("site_id", F.to_json(F.struct(F.struct(params.alias("parameter")).alias("properties"))).alias("body"))
    return payloads.parameter_map_to_daily(body, ["site_id"])


@query("json_forecast_flatten", """
SELECT event_id, CAST(ts AS DATE) AS date,
       CASE WHEN event_type = 'error' THEN 20.0 ELSE value END AS temp,
       CASE WHEN event_type = 'view' THEN 15.0 ELSE value END AS min_temp,
       CAST(25 AS DOUBLE) AS max_temp,
       CASE WHEN event_type = 'purchase' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE)
            ELSE 0 END AS rainfall,
       CASE WHEN event_type = 'click' THEN 60.0
            ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS humidity
FROM events""")
def json_forecast_flatten(spark, folder):
    """Each event as a payload whose fields come and go with its type."""
    k = F.get_json_object("props", "$.k").cast("double")
    kind, v = F.col("event_type"), F.col("value")
    main = F.struct(
        F.when(kind != "error", v).alias("temp"),
        F.when(kind != "view", v).alias("temp_min"),
        F.when(kind != "click", k).alias("humidity"),
    )
    rain = F.when(kind == "purchase", F.create_map(F.lit("3h"), k))
    item = F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("dt_txt"), main.alias("main"), rain.alias("rain")
    )
    body = table(spark, folder, "events").select(
        "event_id", F.to_json(F.struct(F.array(item).alias("list"))).alias("body")
    )
    return payloads.forecast_list_to_rows(body, ["event_id"])


@query("equality_filter", "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def equality_filter(spark, folder):
    return selection.equality_filter(
        table(spark, folder, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}
    )


@query("source_quality_gate", f"""
SELECT site_id, source, count(*) AS n_rows,
       count(*) > 1 AND count(temp) > 0 AND count(humidity) > 0 AS usable
FROM ({X.GOOD_READINGS}) GROUP BY 1, 2""")
def source_quality_gate(spark, folder):
    good = L.replace_sentinels(X.readings(spark, folder), ["temp"])
    return selection.quality_gate(good, ["site_id", "source"], ["temp", "humidity"])


# Error sensors come first, but a source with nothing but sentinels is refused.
PRIORITY = ["error", "signup", "click", "purchase", "view"]


@query("source_arbitration", f"""
WITH e AS (SELECT *, list_position({PRIORITY}, source) AS priority FROM ({X.GOOD_READINGS})),
ok AS (SELECT site_id, min(priority) AS priority FROM (
  SELECT site_id, priority FROM e GROUP BY 1, 2
  HAVING count(*) > 1 AND count(temp) > 0 AND count(humidity) > 0) GROUP BY 1)
SELECT event_id, site_id, source, temp FROM e JOIN ok USING (site_id, priority)""")
def source_arbitration(spark, folder):
    good = L.replace_sentinels(X.readings(spark, folder), ["temp"])
    order = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("source")).cast("int")
    best = selection.arbitrate(good.withColumn("priority", order), ["site_id"], "priority", ["temp", "humidity"])
    return best.select("event_id", "site_id", "source", "temp")


TWO_SOURCES = """
p AS (SELECT user_id AS site_id, CAST(ts AS DATE) AS date, avg(value) AS temp, 'first' AS origin
      FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
s AS (SELECT user_id AS site_id, CAST(ts AS DATE) AS date, avg(value) AS temp, 'second' AS origin
      FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1, 2)"""


def two_sources(spark, folder):
    events = table(spark, folder, "events").withColumnRenamed("user_id", "site_id")
    first = F.col("event_type").isin("click", "view")
    return [
        A.daily_resample(events.filter(pick), ["site_id"], "ts", {"temp": ("avg", "value")}).withColumn(
            "origin", F.lit(name)
        )
        for pick, name in ((first, "first"), (~first, "second"))
    ]


@query("source_topup", f"""
WITH {TWO_SOURCES},
b AS (SELECT * FROM p UNION ALL SELECT * FROM s
      WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.site_id = s.site_id AND p.date = s.date))
SELECT site_id, date, round_even(temp, 6) AS temp, origin FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date) AS rn FROM b) WHERE rn <= 14""")
def source_topup(spark, folder):
    primary, reserve = two_sources(spark, folder)
    return rounded(selection.top_up(primary, reserve, ["site_id"], "date", 14), "temp")


# --- projections -----------------------------------------------------------------

@query("rename_aliases", """
SELECT p_partkey, p_type AS crop, p_retailprice AS temp, p_size AS humidity, p_brand AS soil_ph FROM part""")
def rename_aliases(spark, folder):
    raw = table(spark, folder, "part").select(
        "p_partkey", F.col("p_type").alias(" Label"), F.col("p_retailprice").alias("T2M"),
        F.col("p_size").alias("RH2M "), F.col("p_brand").alias("pH"),
    )
    return S.apply_aliases(S.plain_headers(raw))


@query("sentinel_to_null", f"""
SELECT event_id, temp, CASE WHEN event_id % 5 = 0 THEN CAST(event_id AS VARCHAR) WHEN event_id % 5 = 4 THEN 'n/a' END AS typed
FROM ({X.GOOD_READINGS})""")
def sentinel_to_null(spark, folder):
    texts = F.array(F.lit(None).cast("string"), F.lit("-999"), F.lit("-999.0"), F.lit(" -9999"), F.lit("n/a"))
    part = (F.col("event_id") % 5).cast("int")
    typed = F.when(part == 0, F.col("event_id").cast("string")).otherwise(F.element_at(texts, part + 1))
    return L.replace_sentinels(X.readings(spark, folder).select("event_id", "temp", typed.alias("typed")))


@query("coerce_numeric", """
SELECT event_id, try_cast(raw AS DOUBLE) AS number, coalesce(try_cast(raw AS DOUBLE), 0) AS number_or_zero
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN props
                            ELSE json_extract_string(props, '$.k') END AS raw FROM events)""")
def coerce_numeric(spark, folder):
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_type") == "error", F.col("props")).otherwise(k)
    return table(spark, folder, "events").select(
        "event_id", exprs.to_number(raw).alias("number"), exprs.number_or_zero(raw).alias("number_or_zero")
    )


@query("normalise_text", """
SELECT p_partkey, lower(trim(p_name)) AS name, lower(trim('  ' || p_type || ' ')) AS kind FROM part""")
def normalise_text(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey",
        exprs.normalise_text("p_name").alias("name"),
        exprs.normalise_text(F.concat(F.lit("  "), "p_type", F.lit("\t "))).alias("kind"),
    )


PARTY = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("balance", T.DoubleType()),
        T.StructField("segment", T.StringType()),
        T.StructField("result", T.IntegerType()),
    ]
)


@query("conform_schema", """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 1 AS result FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, 1 FROM supplier""")
def conform_schema(spark, folder):
    parts = []
    for name, p in (("customer", "c"), ("supplier", "s")):
        key = "c_custkey" if p == "c" else "s_suppkey"
        names = {key: "id", f"{p}_name": "name", f"{p}_acctbal": "balance", "c_mktsegment": "segment"}
        parts.append(S.conform(table(spark, folder, name), PARTY, names, {"result": 1}))
    S.require_same_schema(*parts)
    return parts[0].unionByName(parts[1])


@query("parse_compact_date", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS from_compact, CAST(o_orderdate AS DATE) AS from_text FROM orders""")
def parse_compact_date(spark, folder):
    compact = F.date_format("o_orderdate", "yyyyMMdd")
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return table(spark, folder, "orders").select(
        "o_orderkey", exprs.compact_date(compact).alias("from_compact"), exprs.leading_date(text).alias("from_text")
    )


@query("derive_bounds", """
SELECT p_type AS crop, count(*) AS n, count(*) AS in_order, count(*) AS in_range FROM part GROUP BY 1""")
def derive_bounds(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", F.col("p_type").alias("crop"), F.col("p_retailprice").alias("temp"))
    df = W.derive_bounds(df, ["p_partkey"], 2.0, 5.0)
    down, up = F.col("temp") - F.col("min_temp"), F.col("max_temp") - F.col("temp")
    ordered = (down > 0) & (up > 0)
    near = (down >= 1.999999) & (down < 5) & (up >= 1.999999) & (up < 5)
    return df.groupBy("crop").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ordered).alias("in_order"), F.count_if(near).alias("in_range")
    )


@query("attach_group_means", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round_even(min(q), 6) AS l_quantity_mean, round_even(max(d), 6) AS l_discount_mean,
       sum(CASE WHEN l_quantity > q THEN 1 ELSE 0 END)::BIGINT AS above
FROM (SELECT l_returnflag, l_linestatus, l_quantity, avg(l_quantity) OVER g AS q, avg(l_discount) OVER g AS d
      FROM lineitem WINDOW g AS (PARTITION BY l_returnflag)) GROUP BY 1, 2""")
def attach_group_means_query(spark, folder):
    df = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    df = attach_group_means(df, ["l_quantity", "l_discount"], ["l_returnflag"])
    return df.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        exprs.half_even(F.min("l_quantity_mean"), 6).alias("l_quantity_mean"),
        exprs.half_even(F.max("l_discount_mean"), 6).alias("l_discount_mean"),
        F.count_if(F.col("l_quantity") > F.col("l_quantity_mean")).alias("above"),
    )


# --- filters ---------------------------------------------------------------------

@query("success_or_all", """
WITH h AS (SELECT p_partkey, p_brand AS crop, CASE WHEN p_size >= 42 THEN 1 ELSE 0 END AS result FROM part),
g AS (SELECT crop, max(result) AS best FROM h GROUP BY crop)
SELECT h.* FROM h JOIN g USING (crop) WHERE result = 1 OR best = 0""")
def success_or_all_query(spark, folder):
    h = table(spark, folder, "part").select(
        "p_partkey", F.col("p_brand").alias("crop"), (F.col("p_size") >= 42).cast("int").alias("result")
    )
    return success_or_all(h, ["crop"])


@query("weather_condition", """
SELECT label, count(*) AS n FROM (
  SELECT CASE WHEN l_tax * 200 > 8 THEN 'rainy' WHEN l_tax * 200 > 1.5 THEN 'showers'
    WHEN l_quantity > 30 AND l_discount * 1000 < 50 THEN 'sunny'
    WHEN l_discount * 1000 > 75 AND l_tax * 200 <= 1 THEN 'humid_overcast'
    WHEN l_quantity < 15 THEN 'cool' ELSE 'temperate' END AS label FROM lineitem) GROUP BY 1""")
def weather_condition(spark, folder):
    label = exprs.weather_condition("l_quantity", F.col("l_tax") * 200, F.col("l_discount") * 1000)
    return table(spark, folder, "lineitem").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("risk_level", """
SELECT p_partkey, CASE WHEN s >= 85 AND p * 100 >= 75 THEN 'low' WHEN s >= 68 THEN 'medium' ELSE 'high' END AS intended,
       CASE WHEN s >= 85 AND p >= 75 THEN 'low' WHEN s >= 68 THEN 'medium' ELSE 'high' END AS as_fraction
FROM (SELECT p_partkey, p_size * 2.0 AS s, (p_retailprice - 900) / 100 AS p FROM part)""")
def risk_level(spark, folder):
    s, p = F.col("p_size") * 2.0, (F.col("p_retailprice") - 900) / 100
    return table(spark, folder, "part").select(
        "p_partkey", exprs.risk_level(s, p).alias("intended"), exprs.risk_level(s, p, "fraction").alias("as_fraction")
    )


@query("recommendation", """
SELECT p_partkey, CASE WHEN s >= 85 AND p >= 80 THEN 'yes' WHEN s >= 70 AND p >= 60 THEN 'alternative option like this'
  ELSE 'no' END AS recommended
FROM (SELECT p_partkey, p_size * 2.0 AS s, p_retailprice - 900 AS p FROM part)""")
def recommendation(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", exprs.recommendation(F.col("p_size") * 2.0, F.col("p_retailprice") - 900).alias("recommended")
    )


CROP_SYNONYMS = {"rusty rod": "economy", "hot": "small", "old bolt": "promo"}


@query("resolve_crop", """
WITH req AS (SELECT DISTINCT r FROM (SELECT lower(p_name) AS r FROM part UNION ALL SELECT lower(c_mktsegment) FROM customer
                            UNION ALL SELECT lower(split_part(p_name, ' ', 1)) FROM part
                            UNION ALL SELECT lower(left(p_type, 3)) FROM part UNION ALL SELECT lower(p_type) FROM part)),
cat AS (SELECT DISTINCT c FROM (SELECT lower(p_type) AS c FROM part UNION ALL SELECT lower(split_part(p_name, ' ', 2)) FROM part)),
syn AS (SELECT * FROM (VALUES ('rusty rod', 'economy'), ('hot', 'small'), ('old bolt', 'promo')) v(a, b)),
cand AS (SELECT r, c, 1 AS t FROM req JOIN cat ON r = c
  UNION ALL SELECT r, c, 2 FROM req JOIN syn ON r = a JOIN cat ON c = b
  UNION ALL SELECT r, c, 3 FROM req JOIN cat ON contains(r, c) OR contains(c, r)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY t, length(c) DESC, c) AS n FROM cand) WHERE n = 1)
SELECT r AS requested, c AS resolved, CASE t WHEN 1 THEN 'exact' WHEN 2 THEN 'synonym' WHEN 3 THEN 'partial' ELSE 'none' END AS tier
FROM req LEFT JOIN best USING (r)""")
def resolve_crop(spark, folder):
    part, customer = table(spark, folder, "part"), table(spark, folder, "customer")
    one = lambda df, c: df.select(F.lower(c).alias("requested"))
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    asked = one(part, F.col("p_name")).union(one(customer, F.col("c_mktsegment"))).union(one(part, first))
    asked = asked.union(one(part, F.left("p_type", F.lit(3)))).union(one(part, F.col("p_type"))).distinct()
    second = F.split_part("p_name", F.lit(" "), F.lit(2))
    known = part.select(F.col("p_type").alias("crop")).union(part.select(second))
    return N.resolve_crop(asked, known, synonyms=CROP_SYNONYMS)


# --- joins -------------------------------------------------------------------------

DAYS = f"""
d AS (SELECT site_id, date, arg_min(temp, event_id) FILTER (WHERE temp IS NOT NULL) AS temp,
             arg_min(humidity, event_id) FILTER (WHERE humidity IS NOT NULL) AS humidity,
             arg_min(source, event_id) AS source
      FROM ({X.GOOD_READINGS}) GROUP BY 1, 2)"""
SPINE = """
span AS (SELECT site_id, min(date) AS a, max(date) AS z FROM d GROUP BY 1),
spine AS (SELECT site_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
f AS (SELECT spine.*, temp, humidity, source FROM spine LEFT JOIN d USING (site_id, date))"""


def good_days(spark, folder):
    good = L.replace_sentinels(X.readings(spark, folder), ["temp"])
    good = good.withColumn("humidity", exprs.to_number("humidity"))
    return L.first_per_day(good, ["site_id"], "date", "event_id", ["temp", "humidity", "source"])


@query("dedup_first_non_null", f"WITH {DAYS} SELECT * FROM d")
def dedup_first_non_null(spark, folder):
    return good_days(spark, folder)


@query("calendar_fill", f"WITH {DAYS}, {SPINE} SELECT * FROM f")
def calendar_fill(spark, folder):
    return L.fill_calendar(good_days(spark, folder), ["site_id"], "date")


@query("align_to_dates", f"""
WITH {TWO_SOURCES} SELECT s.site_id, s.date, round_even(p.temp, 6) AS temp FROM s LEFT JOIN p USING (site_id, date)""")
def align_to_dates(spark, folder):
    first, second = two_sources(spark, folder)
    aligned = L.align_to(first, second, ["site_id", "date"])
    return rounded(aligned.drop("origin"), "temp")


@query("lookup_with_default", """
SELECT p_partkey, CASE lower(p_type) WHEN 'economy' THEN 8.0 WHEN 'small' THEN 4.2 WHEN 'promo' THEN 5.5
       ELSE 4.5 END::DOUBLE AS need, coalesce(r_name, 'none') AS place
FROM part LEFT JOIN region ON r_regionkey = p_size""")
def lookup_with_default(spark, folder):
    part = table(spark, folder, "part")
    region = table(spark, folder, "region").select(F.col("r_regionkey").alias("p_size"), F.col("r_name").alias("place"))
    out = P.lookup_with_default(part, {"economy": 8.0, "small": 4.2, "promo": 5.5}, "p_type", "need", 4.5)
    return P.join_lookup(out, region, ["p_size"], "place", "none").select("p_partkey", "need", "place")


@query("equalise_length", f"""
WITH {TWO_SOURCES},
c AS (SELECT site_id, count(DISTINCT s.date) AS want, count(DISTINCT p.date) AS have
      FROM s LEFT JOIN p USING (site_id) GROUP BY 1),
cut AS (SELECT p.*, row_number() OVER (PARTITION BY site_id ORDER BY date) AS rn FROM p),
res AS (SELECT site_id, date, temp FROM cut JOIN c USING (site_id) WHERE have >= want AND rn <= want
  UNION ALL SELECT s.site_id, s.date, p.temp FROM s JOIN c USING (site_id) LEFT JOIN p USING (site_id, date) WHERE have < want)
SELECT site_id, date, round_even(temp, 6) AS temp FROM res""")
def equalise_length(spark, folder):
    first, second = two_sources(spark, folder)
    return rounded(L.equalise_length(first.drop("origin"), second, ["site_id"], "date"), "temp")


@query("start_window_join", f"""
WITH f AS ({X.FORECAST}), q AS ({X.REQUESTS}),
w AS (SELECT q.*, o AS "offset", start_date + o::INT AS window_start FROM q, (VALUES (0), (7), (14)) v(o))
SELECT request_id, "offset", window_start, count(*) AS n_days, {r(['temp', 'rainfall', 'humidity']).replace('round_even(', 'round_even(avg(').replace(', 6)', '), 9)')}
FROM w JOIN f ON f.site_id = w.site_id AND f.date BETWEEN window_start AND window_start + duration - 1
GROUP BY 1, 2, 3, duration HAVING count(*) = duration""")
def start_window_join(spark, folder):
    asked = P.start_windows(X.requests(spark, folder))
    means = P.window_means(asked, X.forecast(spark, folder), ["site_id"], X.FEATURES)
    return rounded(means, *X.FEATURES, digits=9).select(
        "request_id", "offset", "window_start", "n_days", *X.FEATURES
    )


# --- files written and read back ---------------------------------------------------------

@query("csv_folder_of_several_headers", """
SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS c_nationkey
FROM customer""")
def csv_folder_of_several_headers(spark, folder):
    """Three kinds of files in one folder: other columns, another order, inner folders."""
    customers, path = table(spark, folder, "customer"), new_folder(spark)
    headers = [["c_custkey", "c_name", "c_acctbal", "c_nationkey"], ["c_mktsegment", "c_acctbal", "c_custkey", "c_name"], ["c_name", "c_mktsegment", "c_custkey", "c_acctbal"]]
    for i, names in enumerate(headers):
        sinks.write_csv(customers.filter(F.col("c_custkey") % 3 == i).select(*names), f"{path}/part{i}")
    return readers.read_csv(spark, path, T.StructType([customers.schema[c] for c in ("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")]))


@query("season_tables_round_trip", f"""
WITH f AS ({X.FORECAST}) SELECT site_id::VARCHAR AS crop, date, {r(['temp', 'rainfall'])} FROM f""")
def season_tables_round_trip(spark, folder):
    """Aligned tables written by crop as CSV and read back with the crop from the folder names."""
    path = new_folder(spark)
    days = rounded(X.forecast(spark, folder), "temp", "rainfall").select(F.col("site_id").cast("string").alias("crop"), "date", "temp", "rainfall")
    sinks.write_season(days, days, path, "csv")
    kinds = T.StructType([T.StructField(n, t) for n, t in (("crop", T.StringType()), ("date", T.DateType()), ("temp", T.DoubleType()), ("rainfall", T.DoubleType()))])
    return readers.read_csv(spark, f"{path}/weather_data", kinds)


@query("run_log_round_trip", """
SELECT c_mktsegment AS target_crop, count(*) AS n, max(c_custkey) AS top FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1""")
def run_log_round_trip(spark, folder):
    """A record for each segment, appended one after the other, read back by a nested equality."""
    path, customers = f"{new_folder(spark)}/runs", table(spark, folder, "customer")
    records = customers.groupBy(F.col("c_mktsegment").alias("target_crop")).agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("top")).alias("summary"),
        F.when(F.col("target_crop") != "BUILDING", "kept").otherwise("left").alias("mark"),
    )
    for mark in ("kept", "left"):
        sinks.append_runs(records.filter(F.col("mark") == mark), path)
    found = sinks.read_runs(spark, path, {"mark": "kept"})
    return found.select("target_crop", "summary.n", "summary.top")


# --- summaries -----------------------------------------------------------------------

@query("daily_resample", f"SELECT site_id, date, {r(DAILY)} FROM ({X.FORECAST})")
def daily_resample(spark, folder):
    return rounded(X.forecast(spark, folder), *DAILY)


@query("optimal_conditions", """
SELECT p_type AS crop, median(p_size) AS p_size, round_even(median(p_retailprice), 6) AS p_retailprice FROM part GROUP BY 1""")
def optimal_conditions(spark, folder):
    part = table(spark, folder, "part").withColumnRenamed("p_type", "crop")
    return rounded(O.exact_median(part, ["crop"], ["p_size", "p_retailprice"]), "p_retailprice")


@query("forecast_mean", f"""
SELECT site_id, {', '.join(f'round_even(avg({m}), 9) AS {m}' for m in DAILY)} FROM ({X.FORECAST}) GROUP BY 1""")
def forecast_mean(spark, folder):
    return rounded(forecast_means(X.forecast(spark, folder), DAILY, ["site_id"]), *DAILY, digits=9)


@query("distinct_count", """
SELECT p_type, count(DISTINCT p_name) AS n_p_name, count(DISTINCT p_brand) AS n_p_brand FROM part GROUP BY 1""")
def distinct_count(spark, folder):
    return A.distinct_counts(table(spark, folder, "part"), ["p_type"], ["p_name", "p_brand"])


@query("scaler_stats", f"""
SELECT l_returnflag, {', '.join(f'round_even(avg({n}), 6) AS {n}__mean, round_even(stddev_pop({n}), 6) AS {n}__sd' for n in NUMBERS)}
FROM lineitem GROUP BY 1""")
def scaler_stats(spark, folder):
    stats = fit_scaler(table(spark, folder, "lineitem"), NUMBERS, ["l_returnflag"])
    return rounded(stats, *[c for c in stats.columns if c != "l_returnflag"])


@query("value_counts", "SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1")
def value_counts(spark, folder):
    return A.value_counts(table(spark, folder, "lineitem"), "l_linestatus")


@query("all_missing", f"""
SELECT site_id, source, count(temp) = 0 AS temp_missing, count(humidity) = 0 AS humidity_missing
FROM ({X.GOOD_READINGS}) GROUP BY 1, 2""")
def all_missing(spark, folder):
    good = L.replace_sentinels(X.readings(spark, folder), ["temp"])
    return A.all_missing(good, ["site_id", "source"], ["temp", "humidity"])


@query("water_requirement", f"""
SELECT site_id, round_even(avg(rainfall) * 10 / max(days), 2) AS water_requirement
FROM (SELECT *, count(*) OVER (PARTITION BY site_id) AS days FROM ({X.FORECAST})) GROUP BY 1""")
def water_requirement(spark, folder):
    days = X.forecast(spark, folder)
    size = days.groupBy("site_id").agg(F.count(F.lit(1)).alias("days"))
    return A.water_requirement(days.join(size, ["site_id"]), ["site_id"], "days")


# --- series ---------------------------------------------------------------------------

SIDES = """
w AS (SELECT *, row_number() OVER k AS pos FROM f WINDOW k AS (PARTITION BY site_id ORDER BY date)),
n AS (SELECT *,
  last_value(temp IGNORE NULLS) OVER b AS tb, first_value(temp IGNORE NULLS) OVER a AS ta,
  last_value(CASE WHEN temp IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pb,
  first_value(CASE WHEN temp IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS pa,
  last_value(humidity IGNORE NULLS) OVER b AS hb, first_value(humidity IGNORE NULLS) OVER a AS ha,
  last_value(CASE WHEN humidity IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS qb,
  first_value(CASE WHEN humidity IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS qa,
  last_value(source IGNORE NULLS) OVER b AS sb, first_value(source IGNORE NULLS) OVER a AS sa
  FROM w WINDOW b AS (PARTITION BY site_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                a AS (PARTITION BY site_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
LERP_T = "coalesce(temp, tb + (ta - tb) * (pos - pb) / nullif(pa - pb, 0), tb, ta)"
LERP_H = "coalesce(humidity, hb + (ha - hb) * (pos - qb) / nullif(qa - qb, 0), hb, ha)"


@query("interpolate_linear", f"""
WITH {DAYS}, {SPINE}, {SIDES} SELECT site_id, date, round_even({LERP_T}, 6) AS temp, round_even({LERP_H}, 6) AS humidity FROM n""")
def interpolate_linear(spark, folder):
    days = L.fill_calendar(good_days(spark, folder), ["site_id"], "date")
    out = L.interpolate(days, ["site_id"], "date", ["temp", "humidity"])
    return rounded(out.drop("source"), "temp", "humidity")


@query("ffill_bfill", f"""
WITH {DAYS}, {SPINE}, {SIDES}
SELECT site_id, date, coalesce(tb, ta) AS temp, coalesce(hb, ha) AS humidity, coalesce(sb, sa) AS source FROM n""")
def ffill_bfill(spark, folder):
    days = L.fill_calendar(good_days(spark, folder), ["site_id"], "date")
    return L.fill_forward_back(days, ["site_id"], "date", ["temp", "humidity", "source"])


@query("fill_defaults", f"""
SELECT event_id, coalesce(temp, 25.0) AS temp, coalesce(humidity, 65.0) AS humidity FROM ({X.GOOD_READINGS})""")
def fill_defaults(spark, folder):
    good = L.replace_sentinels(X.readings(spark, folder).select("event_id", "temp", "humidity"), ["temp"])
    return L.fill_defaults(good.withColumn("humidity", exprs.to_number("humidity")))


@query("clean_series", f"""
WITH {DAYS}, {SPINE}, {SIDES}
SELECT site_id, date, round_even(coalesce({LERP_T}, 25), 6) AS temp, round_even(coalesce({LERP_H}, 65), 6) AS humidity,
       lower(trim(coalesce(sb, sa))) AS weather_condition FROM n""")
def clean_series(spark, folder):
    raw = X.readings(spark, folder).select(
        "site_id", "event_id", F.date_format("date", "yyyy-MM-dd").alias("Date "),
        # As a CSV reader gives them: all text, the sentinel without a fraction.
        F.when(F.col("temp") == -999, F.lit("-999")).otherwise(F.col("temp").cast("string")).alias("T2M"),
        F.col("humidity").alias("RH2M"), F.concat(F.lit(" "), F.upper("source")).alias("Weather_Condition"),
    )
    return rounded(L.clean(raw, ["site_id"], order="event_id"), "temp", "humidity")


@query("season_pad", f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date) AS rn,
                  count(*) OVER (PARTITION BY site_id) AS n FROM ({X.FORECAST})),
t AS (SELECT site_id, unnest(range(1, 41))::INT AS season_day, n FROM (SELECT DISTINCT site_id, n FROM s))
SELECT t.site_id, season_day, s.date, round_even(temp, 6) AS temp FROM t JOIN s ON s.site_id = t.site_id AND s.rn =
  CASE WHEN season_day <= t.n THEN season_day
       ELSE t.n - least(10, t.n) + 1 + (season_day - t.n - 1) % least(10, t.n) END""")
def season_pad(spark, folder):
    days = X.forecast(spark, folder).select("site_id", "date", "temp")
    return rounded(W.pad_season(days, ["site_id"], ["date"], 40), "temp")


@query("redate_sequence", """
SELECT event_id, event_type, DATE '2025-01-01' + CAST(floor((rn - 1) / 24) AS INT) AS date FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events)""")
def redate_sequence(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    return W.redate(events, ["event_type"], ["event_id"], "2025-01-01", per_day=24)


@query("growth_stage", f"""
SELECT site_id, date, day, CASE WHEN day <= floor(n * 0.15::DOUBLE) THEN 'Germination & Emergence'
  WHEN day <= floor(n * 0.45::DOUBLE) THEN 'Vegetative Growth'
  WHEN day <= floor(n * 0.75::DOUBLE) THEN 'Flowering & Pollination' ELSE 'Yield Formation & Ripening' END AS stage
FROM (SELECT site_id, date, row_number() OVER (PARTITION BY site_id ORDER BY date)::INT AS day,
             count(*) OVER (PARTITION BY site_id) AS n FROM ({X.FORECAST}))""")
def growth_stage(spark, folder):
    days = X.forecast(spark, folder).select("site_id", "date")
    size = days.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))
    days = W.season_day(days, ["site_id"]).join(size, ["site_id"])
    return days.withColumn("stage", exprs.growth_stage("day", "n")).drop("n")


@query("head_per_key", """
SELECT event_id, event_type, value, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)::INT AS rn FROM events) WHERE rn <= 30""")
def head_per_key(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "value", "ts")
    return L.head_per_key(events, ["event_type"], ["ts", "event_id"], 30).drop("ts")


# --- names ---------------------------------------------------------------------------

@query("crop_catalogue", f"""
SELECT DISTINCT crop FROM (SELECT upper(left(n, 1)) || lower(substr(n, 2)) AS crop FROM (
  SELECT lower(p_name) AS n FROM part UNION ALL SELECT lower(n_name) FROM nation)
  UNION ALL SELECT unnest({vocab.CATALOGUE_CROPS}))""")
def crop_catalogue(spark, folder):
    names = table(spark, folder, "part").select(F.col("p_name").alias("crop"))
    return N.crop_catalogue(names.union(table(spark, folder, "nation").select("n_name")))


UNIT = "[a-z]+"


@query("extract_duration", f"""
SELECT doc_id, try_cast(coalesce(
  nullif(regexp_extract(text, '(\\d+)\\s*(?:-|to)\\s*(\\d+)\\s*(?:{UNIT})', 2, 'i'), ''),
  nullif(regexp_extract(text, '(\\d+)\\s*(?:{UNIT})', 1, 'i'), ''),
  nullif(regexp_extract(text, 'duration\\s*(?:of|is)?\\s*(\\d+)', 1, 'i'), '')) AS BIGINT) AS duration_hint FROM documents""")
def extract_duration(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return N.extract_hints(docs, "text", unit=UNIT).select("doc_id", "duration_hint")


@query("extract_temperature", f"""
SELECT doc_id, try_cast(nullif(regexp_extract(text, '(\\d+)\\s*(?:-|to)\\s*(\\d+)\\s*(?:{UNIT})', 2, 'i'), '') AS DOUBLE)
  AS temperature_hint FROM documents""")
def extract_temperature(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return N.extract_hints(docs, "text", degree=UNIT).select("doc_id", "temperature_hint")


# --- rows added, scalar functions, scaling ----------------------------------------------

@query("augment_failures", """
WITH h AS (SELECT p_type AS crop, p_size::DOUBLE AS temp, p_size - 3.0 AS min_temp, p_size + 3.0 AS max_temp,
                  p_retailprice - 900 AS humidity, p_size * 2.0 AS rainfall, 1 AS result, DATE '2024-06-01' AS date FROM part),
m AS (SELECT crop, avg(temp) AS t, avg(humidity) AS h, avg(rainfall) AS r FROM h GROUP BY 1),
u AS (SELECT crop, temp, min_temp, max_temp, rainfall, humidity, result, date FROM h
  UNION ALL SELECT crop, t + 15, t + 10, t + 20, 0, h / 2, 0, DATE '2025-01-01' FROM m
  UNION ALL SELECT crop, t - 15, t - 20, t - 10, r * 3, 98, 0, DATE '2025-01-01' FROM m)
SELECT crop, round_even(temp, 6) AS temp, round_even(min_temp, 6) AS min_temp, round_even(max_temp, 6) AS max_temp,
       round_even(rainfall, 6) AS rainfall, round_even(humidity, 6) AS humidity, result, date FROM u""")
def augment_failures(spark, folder):
    size = F.col("p_size").cast("double")
    h = table(spark, folder, "part").select(
        F.col("p_type").alias("crop"), size.alias("temp"), (size - 3.0).alias("min_temp"),
        (size + 3.0).alias("max_temp"), (F.col("p_retailprice") - 900).alias("humidity"),
        (size * 2.0).alias("rainfall"), F.lit(1).alias("result"), F.lit("2024-06-01").cast("date").alias("date"),
    )
    return rounded(W.augment_failures(h, ["crop"]), *DAILY)


@query("string_functions", """
SELECT p_partkey, lower(trim(p_name)) AS plain, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS capital,
       replace(p_name, ' ', '_') AS snake, split_part(p_name, ' ', 1) AS first_word,
       contains(p_name, 'ring') OR contains('ring', p_name) AS has_ring FROM part""")
def string_functions(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey",
        exprs.normalise_text("p_name").alias("plain"),
        exprs.capitalise("p_name").alias("capital"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("snake"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first_word"),
        exprs.is_part_of("p_name", F.lit("ring")).alias("has_ring"),
    )


@query("decay_score", """
SELECT vec_id, round_even(exp(-d / 6) * 100, 6) AS per_neighbour, round_even(exp(-d / 3) * 100, 6) AS mean_based
FROM (SELECT vec_id, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS d FROM embeddings)""")
def decay_score(spark, folder):
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    d = F.sqrt(square)
    return table(spark, folder, "embeddings").select(
        "vec_id",
        exprs.half_even(exprs.decay_percent(d, 6.0), 6).alias("per_neighbour"),
        exprs.half_even(exprs.decay_percent(d, 3.0), 6).alias("mean_based"),
    )


@query("round_half_even", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_quantity / 8, 2) AS eighth, round_even(l_discount * 100, 0) AS percent
FROM lineitem""")
def round_half_even(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        exprs.half_even(F.col("l_quantity") / 8).alias("eighth"),
        exprs.half_even(F.col("l_discount") * 100, 0).alias("percent"),
    )


@query("clip_range", """
SELECT event_id, greatest(0.0::DOUBLE, value - 50) AS not_negative, least(greatest(value, 10.0::DOUBLE), 100.0::DOUBLE) AS clipped FROM events""")
def clip_range(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", exprs.clip(F.col("value") - 50, 0.0).alias("not_negative"),
        exprs.clip("value", 10.0, 100.0).alias("clipped"),
    )


@query("date_functions", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS as_text, CAST(o_orderdate AS DATE) + 7 AS a_week_on,
       len(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 9, INTERVAL 1 DAY))::INT AS n_days
FROM orders""")
def date_functions(spark, folder):
    day = F.to_date("o_orderdate")
    return table(spark, folder, "orders").select(
        "o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("as_text"), F.date_add(day, 7).alias("a_week_on"),
        F.size(F.sequence(day, F.date_add(day, 9), F.expr("interval 1 day"))).alias("n_days"),
    )


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


@query("standard_scale", f"""
WITH s AS (SELECT {', '.join(f'avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}' for n in NUMBERS)} FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate,
  {', '.join(f'round_even(({n} - m_{n}) / coalesce(nullif(s_{n}, 0), 1), 6) AS z_{n}' for n in NUMBERS)} FROM lineitem, s""")
def standard_scale(spark, folder):
    df = table(spark, folder, "lineitem").select(*LINE, *NUMBERS).withColumn("l_shipdate", F.to_date("l_shipdate"))
    z = apply_scaler(df, fit_scaler(df, NUMBERS), NUMBERS).drop(*NUMBERS)
    return rounded(z, *[f"z_{n}" for n in NUMBERS])


@query("min_max_scale", f"""
WITH s AS (SELECT {', '.join(f'min({n}) AS a_{n}, max({n}) AS z_{n}' for n in NUMBERS)} FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate,
  {', '.join(f'round_even(({n} - a_{n}) / (z_{n} - a_{n}), 6) AS {n}' for n in NUMBERS)}, CAST(0 AS DOUBLE) AS constant
FROM lineitem, s""")
def min_max_scale_query(spark, folder):
    df = table(spark, folder, "lineitem").select(*LINE, *NUMBERS).withColumn("l_shipdate", F.to_date("l_shipdate"))
    df = df.withColumn("constant", F.lit(7.0))
    return rounded(min_max_scale(df, [*NUMBERS, "constant"]), *NUMBERS)
