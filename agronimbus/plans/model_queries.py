"""Registered queries: neighbours, suitability, planning and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs, vocab
from ..operators import suitability as U
from ..operators.aggregates import daily_resample
from ..operators.neighbours import knn_join
from ..operators.planning import irrigation_schedule, recommend_starts
from ..operators.scaling import apply_scaler, fit_scaler
from ..sources import sinks
from . import fixtures as X
from . import jobs
from .fixtures import FEATURES, table
from .registry import query
from .storage import materialise
from .table_queries import rounded

SITE_DAY = ["site_id", "date"]
Z = [f"z_{f}" for f in FEATURES]
LINE_FEATURES = ["l_quantity", "l_extendedprice"]
H_AND_F = f"h AS ({X.HISTORY}), f AS ({X.FORECAST})"
OK = "ok AS (SELECT h.* FROM h JOIN (SELECT crop, max(result) AS best FROM h GROUP BY 1) USING (crop) WHERE result = 1 OR best = 0)"
OK_ALL = "ok AS (SELECT * FROM h WHERE result = 1 OR (SELECT max(result) FROM h) = 0)"


@query("knn_join", """
SELECT query_id, hist_id, rank, round_even(distance, 6) AS distance FROM (
  SELECT b.vec_id AS query_id, a.vec_id AS hist_id, round_even(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance,
         row_number() OVER (PARTITION BY b.vec_id ORDER BY round_even(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), a.vec_id)::INT AS rank
  FROM embeddings a, embeddings b) WHERE rank <= 5""")
def knn_join_vectors(spark, folder):
    v = table(spark, folder, "embeddings")
    h = v.select(F.col("vec_id").alias("hist_id"), "embedding")
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(knn_join(h, q, ["embedding"], "hist_id", "query_id", 5), "distance")


def _tabular(spark, folder, **blocks):
    h, f = X.history(spark, folder), X.forecast(spark, folder)
    stats = materialise(fit_scaler(h, FEATURES))
    h, f = (apply_scaler(df, stats, FEATURES) for df in (h, f))
    return rounded(knn_join(h, f, Z, "hist_id", SITE_DAY, 5, **blocks), "distance")


TABULAR = f"""
WITH {H_AND_F}, {X.neighbours_sql('h', 'f', SITE_DAY, 5)}
SELECT site_id, date, hist_id, rank::INT AS rank, round_even(distance, 6) AS distance FROM nn"""


@query("knn_join_tabular", TABULAR)
def knn_join_tabular(spark, folder):
    return _tabular(spark, folder)


@query("knn_join_pruned", TABULAR)
def knn_join_pruned(spark, folder):
    """The same with blocks small enough that every step of the pruned join runs."""
    return _tabular(spark, folder, block_rows=250, block_queries=500)


@query("knn_join_hot", """
WITH h AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS hist_id,
                  CASE WHEN l_linenumber < 7 THEN 25 ELSE l_quantity END::DOUBLE AS x, CASE WHEN l_linenumber < 7 THEN 0 ELSE l_tax END::DOUBLE AS y FROM lineitem),
q AS (SELECT DISTINCT l_quantity::DOUBLE AS x FROM lineitem),
d AS (SELECT q.x AS query_id, hist_id, round_even(sqrt((h.x - q.x) * (h.x - q.x) + h.y * h.y), 6) AS distance FROM h, q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, hist_id)::INT AS rank FROM d) WHERE rank <= 5""")
def knn_join_hot(spark, folder):
    """Most lines are one and the same point."""
    lines = table(spark, folder, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate"))
    usual = F.col("l_linenumber") < 7
    h = lines.select(
        key.alias("hist_id"),
        F.when(usual, 25.0).otherwise(F.col("l_quantity").cast("double")).alias("x"),
        F.when(usual, 0.0).otherwise(F.col("l_tax").cast("double")).alias("y"),
    )
    q = lines.select(F.col("l_quantity").cast("double").alias("query_id")).distinct()
    q = q.select("query_id", F.col("query_id").alias("x"), F.lit(0.0).alias("y"))
    return rounded(knn_join(h, q, ["x", "y"], "hist_id", "query_id", 5), "distance")


@query("knn_join_nulls", """
WITH v AS (SELECT vec_id, CASE vec_id % 7 WHEN 0 THEN NULL WHEN 1 THEN list_concat([NULL], embedding::DOUBLE[])
             WHEN 2 THEN list_concat(['nan'::DOUBLE], embedding::DOUBLE[]) WHEN 3 THEN embedding[1:32]::DOUBLE[]
             WHEN 4 THEN []::DOUBLE[] ELSE embedding::DOUBLE[] END AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id % 7 IN (3, 5, 6)),
d AS (SELECT b.vec_id AS query_id, a.vec_id AS hist_id, round_even(list_distance(a.e, b.e), 6) AS distance,
      round_even(list_distance(a.e, b.e), 8) AS fine FROM ok a JOIN ok b ON len(a.e) = len(b.e))
SELECT query_id, hist_id, distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fine, hist_id)::INT AS rank FROM d) WHERE rank <= 3""")
def knn_join_nulls(spark, folder):
    """Null, holey, NaN, short and empty vectors among good ones, on both sides."""
    e, part = F.col("embedding").cast("array<double>"), F.col("vec_id") % 7
    mixed = (
        F.when(part == 0, F.lit(None)).when(part == 1, F.concat(F.array(F.lit(None).cast("double")), e))
        .when(part == 2, F.concat(F.array(F.lit(float("nan"))), e)).when(part == 3, F.slice(e, 1, 32))
        .when(part == 4, F.slice(e, 1, 0)).otherwise(e)
    )
    v = table(spark, folder, "embeddings").select("vec_id", mixed.alias("embedding"))
    h, q = v.withColumnRenamed("vec_id", "hist_id"), v.withColumnRenamed("vec_id", "query_id")
    return rounded(knn_join(h, q, ["embedding"], "hist_id", "query_id", 3), "distance")


def _line_queries(spark, folder):
    """Every lineitem as history, each supplier's mean line as a query."""
    lines = table(spark, folder, "lineitem")
    stats = materialise(fit_scaler(lines, LINE_FEATURES))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate"))
    h = lines.select(key.alias("hist_id"), *LINE_FEATURES)
    q = lines.groupBy("l_suppkey").agg(*[F.avg(f).alias(f) for f in LINE_FEATURES])
    return apply_scaler(h, stats, LINE_FEATURES), apply_scaler(q, stats, LINE_FEATURES)


@query("knn_join_lines", f"""
WITH h AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS hist_id,
                  0 AS result, l_quantity, l_extendedprice FROM lineitem),
q AS (SELECT l_suppkey, avg(l_quantity) AS l_quantity, avg(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1),
{X.neighbours_sql('h', 'q', ['l_suppkey'], 5, features=LINE_FEATURES)}
SELECT l_suppkey, hist_id, rank::INT AS rank, round_even(distance, 6) AS distance FROM nn""")
def knn_join_lines(spark, folder):
    h, q = _line_queries(spark, folder)
    out = knn_join(h, q, [f"z_{f}" for f in LINE_FEATURES], "hist_id", "l_suppkey", 5)
    return rounded(out, "distance")


@query("knn_similarity", f"""
WITH {H_AND_F}, {OK_ALL}, {X.neighbours_sql('ok', 'f', SITE_DAY, 5)}
SELECT site_id, date, hist_id, rank::INT AS rank, round_even(distance, 6) AS distance,
       round_even(exp(-distance / 6) * 100, 2) AS similarity FROM nn""")
def knn_similarity(spark, folder):
    out = U.knn_similarity(X.history(spark, folder), X.forecast(spark, folder), "hist_id", SITE_DAY, FEATURES)
    return rounded(out, "distance")


@query("knn_success_probability", f"""
WITH {H_AND_F}, {X.neighbours_sql('h', 'f', SITE_DAY, 5)}, {X.vote_sql(SITE_DAY)}
SELECT v.site_id, v.date, round_even(p, 6) AS raw_probability, round_even(d, 6) AS mean_distance FROM vote v
JOIN (SELECT site_id, date, avg(distance) AS d FROM nn GROUP BY 1, 2) USING (site_id, date)""")
def knn_success_probability(spark, folder):
    out = U.success_probability(X.history(spark, folder), X.forecast(spark, folder), "hist_id", SITE_DAY, FEATURES)
    return rounded(out, "raw_probability", "mean_distance")


@query("predict_viability", f"""
WITH {H_AND_F}, {X.neighbours_sql('h', 'f', SITE_DAY, 5)}, {X.vote_sql(SITE_DAY)} SELECT * FROM score""")
def predict_viability(spark, folder):
    return U.predict_viability(X.history(spark, folder), X.forecast(spark, folder), "hist_id", SITE_DAY, FEATURES)


def _means(view):
    return f"(SELECT site_id, {', '.join(f'avg({m}) AS {m}' for m in FEATURES)} FROM {view} GROUP BY 1)"


COMPARED = f"""
{H_AND_F}, m AS (SELECT s.*, c.crop FROM {_means('f')} s, (SELECT DISTINCT crop FROM h) c),
{X.neighbours_sql('h', 'm', ['site_id'], 5, by='crop')}, {X.vote_sql(['crop', 'site_id'])},
opt AS (SELECT crop, {', '.join(f'round_even(median({m}), 9) AS optimal_{m}' for m in FEATURES)} FROM h GROUP BY 1),
fm AS (SELECT site_id, {', '.join(f'round_even({m}, 9) AS forecast_{m}' for m in FEATURES)} FROM {_means('f')})"""


def _compared(spark, folder):
    out = U.compare_crops(
        X.history(spark, folder), X.forecast(spark, folder), "hist_id", ["site_id"], FEATURES, FEATURES
    )
    return rounded(out, *[f"{side}_{m}" for side in ("optimal", "forecast") for m in FEATURES], digits=9)


@query("crop_comparison", f"""
WITH {COMPARED} SELECT score.*, opt.* EXCLUDE (crop), fm.* EXCLUDE (site_id),
  row_number() OVER (PARTITION BY site_id ORDER BY similarity_score DESC, crop)::INT AS rank
FROM score JOIN opt USING (crop) JOIN fm USING (site_id)""")
def crop_comparison(spark, folder):
    return _compared(spark, folder)


@query("crop_ranking", f"""
WITH {COMPARED} SELECT crop, rank, count(*) AS n_sites FROM (
  SELECT crop, row_number() OVER (PARTITION BY site_id ORDER BY similarity_score DESC, crop)::INT AS rank FROM score)
GROUP BY 1, 2""")
def crop_ranking(spark, folder):
    return _compared(spark, folder).groupBy("crop", "rank").agg(F.count(F.lit(1)).alias("n_sites"))


@query("export_crop_comparisons", f"""
WITH {COMPARED} SELECT crop AS "Crop", site_id AS "Site Id", similarity_score AS "Similarity Score",
  success_probability AS "Success Probability", risk_level AS "Risk Level",
  row_number() OVER (PARTITION BY site_id ORDER BY similarity_score DESC, crop)::INT AS "Rank",
  '{{' || concat_ws(',', {', '.join(f"""'"{m}":"' || printf('%.4f', round_even(optimal_{m}, 4)) || '"'""" for m in FEATURES)}) || '}}' AS "Optimal Weather",
  '{{' || concat_ws(',', {', '.join(f"""'"{m}":"' || printf('%.4f', round_even(forecast_{m}, 4)) || '"'""" for m in FEATURES)}) || '}}' AS "Forecast Weather"
FROM score JOIN opt USING (crop) JOIN fm USING (site_id)""")
def export_crop_comparisons(spark, folder):
    """Every column of the export, the nested ones as JSON text (numbers as fixed text,
    because Spark and SQL write doubles differently)."""
    flat = _compared(spark, folder)
    weather = {
        f"{side}_weather": F.struct(*[F.format_string("%.4f", exprs.half_even(f"{side}_{m}", 4)).alias(m) for m in FEATURES])
        for side in ("optimal", "forecast")
    }
    return sinks.comparison_export(flat.withColumns(weather).drop(*[f"{s}_{m}" for s in ("optimal", "forecast") for m in FEATURES]))


BEST = f"""
{H_AND_F}, {OK_ALL}, {X.neighbours_sql('ok', 'f', SITE_DAY, 5)},
b AS (SELECT site_id, date, hist_id, distance FROM nn WHERE rank = 1)"""


def _best(spark, folder):
    """Best match per site and day under one id, as the exporter takes it."""
    f = X.forecast(spark, folder).withColumn("query_id", F.concat_ws("/", "site_id", "date"))
    h = X.history(spark, folder)
    return h, f, U.knn_similarity(h, f, "hist_id", "query_id", FEATURES)


@query("export_matched_patterns", f"""
WITH {BEST}
SELECT f.date AS "Forecast Date", 'Unknown' AS "Crop", round_even(f.temp, 6) AS "Forecast Temp", round_even(f.rainfall, 6) AS "Forecast Rain",
  round_even(f.humidity, 6) AS "Forecast Hum", h.date AS "Matched Hist Date", h.temp AS "Matched Hist Temp",
  h.rainfall AS "Matched Hist Rain", round_even(h.humidity, 6) AS "Matched Hist Hum", round_even(distance, 6) AS "Distance",
  round_even(exp(-distance / 6) * 100, 2) AS "Similarity Score"
FROM b JOIN f USING (site_id, date) JOIN h USING (hist_id)""")
def export_matched_patterns(spark, folder):
    h, f, matches = _best(spark, folder)
    short = {"temp": "temp", "rainfall": "rain", "humidity": "hum"}
    out = sinks.matched_patterns(materialise(matches), f, h, "hist_id", "query_id", short)
    out = rounded(out, "forecast_temp", "forecast_rain", "forecast_hum", "matched_hist_hum", "distance")
    return sinks.S.title_headers(out)


@query("nested_matches", f"""
WITH {H_AND_F}, {OK_ALL}, {X.neighbours_sql('ok', 'f', SITE_DAY, 5)}
SELECT site_id || '/' || date AS query_id, count(*)::INT AS n_matched, round_even(min(distance), 6) AS best_distance,
  arg_min(hist_id, rank) AS best_hist, string_agg(hist_id, ',' ORDER BY rank) AS ranked FROM nn GROUP BY 1""")
def nested_matches(spark, folder):
    h, _, matches = _best(spark, folder)
    nested = U.nested_matches(matches, h, "hist_id", "query_id", FEATURES)
    return nested.select(
        "query_id",
        F.size("matched_patterns").alias("n_matched"),
        exprs.half_even("best_match.distance", 6).alias("best_distance"),
        F.col("best_match.hist_id").alias("best_hist"),
        F.array_join(F.transform("matched_patterns", lambda m: m["hist_id"].cast("string")), ",").alias("ranked"),
    )


@query("match_sequence", f"""
WITH {H_AND_F}, {OK}, q AS (SELECT f.*, c.crop FROM f, (SELECT DISTINCT crop FROM h) c),
{X.neighbours_sql('ok', 'q', SITE_DAY, 1, by='crop')}
SELECT nn.crop, site_id, nn.date, hist_id, round_even(distance, 6) AS distance,
       round_even(exp(-distance / 6) * 100, 2) AS similarity,
       h.date AS matched_date, h.temp AS matched_temp, h.rainfall AS matched_rainfall, round_even(h.humidity, 6) AS matched_humidity
FROM nn JOIN h USING (hist_id)""")
def match_sequence(spark, folder):
    out = U.match_sequence(
        X.history(spark, folder), X.forecast(spark, folder), "hist_id", ["site_id"], "date", FEATURES
    )
    return rounded(out, "distance", "matched_humidity")


@query("nested_comparisons", f"""
WITH {COMPARED}, {OK}, q AS (SELECT f.*, c.crop FROM f, (SELECT DISTINCT crop FROM h) c),
sq AS (WITH {X.neighbours_sql('ok', 'q', SITE_DAY, 1, by='crop')} SELECT crop, site_id, date, hist_id FROM nn),
s AS (SELECT sq.crop, site_id, count(*)::INT AS days, string_agg(h.date::VARCHAR, ',' ORDER BY sq.date) AS matched_dates,
             round_even(sum(h.temp), 6) AS matched_temp FROM sq JOIN h USING (hist_id) GROUP BY 1, 2)
SELECT site_id, crop, similarity_score, success_probability, risk_level, days, matched_dates, matched_temp,
       optimal_temp, optimal_rainfall, optimal_humidity, forecast_temp, forecast_rainfall, forecast_humidity
FROM score JOIN opt USING (crop) JOIN fm USING (site_id) JOIN s USING (crop, site_id)""")
def nested_comparisons(spark, folder):
    h, f = X.history(spark, folder), materialise(X.forecast(spark, folder))
    profile = U.crop_profile(h, FEATURES)
    compared = U.compare_crops(h, f, "hist_id", ["site_id"], FEATURES, FEATURES, profile=profile)
    sequence = U.match_sequence(h, f, "hist_id", ["site_id"], "date", FEATURES, profile=profile)
    nested = U.nested_comparisons(compared, sequence, ["site_id", "crop"], FEATURES)
    days = "historical_match_sequence"
    out = nested.select(
        "site_id", "crop", "similarity_score", "success_probability", "risk_level",
        F.size(days).alias("days"),
        F.array_join(F.transform(days, lambda d: d["matched_date"].cast("string")), ",").alias("matched_dates"),
        F.aggregate(days, F.lit(0.0), lambda a, d: a + d["matched_temp"]).alias("matched_temp"),
        *[F.col(f"{side}_weather.{m}").alias(f"{side}_{m}") for side in ("optimal", "forecast") for m in FEATURES],
    )
    out = rounded(out, "matched_temp")
    return rounded(out, *[f"{side}_{m}" for side in ("optimal", "forecast") for m in FEATURES], digits=9)


@query("scaled_pair_series", f"""
WITH {BEST}, s AS (SELECT {', '.join(f'avg({m}) AS a_{m}, stddev_pop({m}) AS d_{m}' for m in FEATURES)} FROM h)
SELECT f.site_id, f.date, hist_id, {', '.join(f'round_even((f.{m} - a_{m}) / d_{m}, 6) AS forecast_{m}' for m in FEATURES)},
  {', '.join(f'round_even((h.{m} - a_{m}) / d_{m}, 6) AS history_{m}' for m in FEATURES)}
FROM b JOIN f USING (site_id, date) JOIN h USING (hist_id), s""")
def scaled_pair_series(spark, folder):
    h, f = X.history(spark, folder), X.forecast(spark, folder)
    best = U.knn_similarity(h, f, "hist_id", SITE_DAY, FEATURES).filter("rank = 1")
    out = U.scaled_pairs(h, f, materialise(best), "hist_id", SITE_DAY, FEATURES)
    return rounded(out, *[f"{s}_{m}" for s in ("forecast", "history") for m in FEATURES])


# --- planning -----------------------------------------------------------------------

@query("start_date_recommendations", f"""
WITH {H_AND_F}, rq AS ({X.REQUESTS}),
w AS (SELECT rq.*, o AS "offset", start_date + o::INT AS window_start FROM rq, (VALUES (0), (7), (14)) v(o)),
m AS (SELECT request_id, w.crop, "offset", window_start, {', '.join(f'avg({m}) AS {m}' for m in FEATURES)}
      FROM w JOIN f ON f.site_id = w.site_id AND f.date BETWEEN window_start AND window_start + duration - 1
      GROUP BY 1, 2, 3, 4, duration HAVING count(*) = duration),
{X.neighbours_sql('h', 'm', ['request_id', '"offset"', 'window_start'], 5, by='crop')},
{X.vote_sql(['crop', 'request_id', '"offset"', 'window_start'])}
SELECT a.request_id, a.crop, b.success_probability AS base_probability, a.window_start AS start_date, a.success_probability,
       row_number() OVER (PARTITION BY a.request_id, a.crop ORDER BY a.success_probability DESC, a.window_start)::INT AS rank
FROM score a JOIN score b ON a.request_id = b.request_id AND b."offset" = 0
WHERE a."offset" > 0 AND a.success_probability > b.success_probability""")
def start_date_recommendations(spark, folder):
    return recommend_starts(
        X.history(spark, folder), X.forecast(spark, folder), X.requests(spark, folder), "hist_id",
        features=FEATURES,
    )


NEEDS = " ".join(f"WHEN '{c}' THEN {v}" for c, v in vocab.WATER_NEED_MM.items())
PLAN_CROPS = ["rice", "wheat", "maize", "cotton", "soybean", "barley"]


@query("irrigation_schedule", f"""
WITH d AS (SELECT site_id, date, temp, rainfall, humidity, CASE WHEN temp > 60 THEN 'high' WHEN temp > 30 THEN 'medium' ELSE 'low' END AS risk,
  CASE {PLAN_CROPS}[(site_id % 6 + 1)::INT] {NEEDS} ELSE 4.5 END::DOUBLE AS need,
  row_number() OVER (PARTITION BY site_id ORDER BY date)::INT AS day FROM ({X.FORECAST})),
v AS (SELECT *, round_even(greatest(0, need - rainfall), 2) AS mm FROM d WHERE day <= 20)
SELECT site_id, day, date,
  CASE WHEN day <= 3 THEN 'Germination & Emergence' WHEN day <= 9 THEN 'Vegetative Growth'
       WHEN day <= 15 THEN 'Flowering & Pollination' ELSE 'Yield Formation & Ripening' END AS stage,
  round_even(temp, 6) AS temperature, round_even(rainfall, 6) AS rainfall, round_even(humidity, 6) AS humidity,
  75.0::DOUBLE AS similarity_score, risk AS risk_level, need > rainfall AS irrigation_needed, mm AS irrigation_volume_mm,
  concat_ws(' | ', CASE WHEN need > rainfall THEN 'Apply ' || regexp_replace(printf('%.2f', mm), '0$', '') || ' mm of targeted irrigation.'
       ELSE '{vocab.NO_IRRIGATION_TEXT}' END,
    CASE risk WHEN 'high' THEN '{vocab.RISK_TEXTS['high']}' WHEN 'medium' THEN '{vocab.RISK_TEXTS['medium']}' END,
    CASE WHEN day IN (7, 21) THEN '{vocab.TASK_DAYS[0][1]}' END, CASE WHEN day IN (12, 26) THEN '{vocab.TASK_DAYS[1][1]}' END,
    CASE WHEN day <= 3 THEN '{vocab.STAGES[0][2]}' WHEN day <= 9 THEN '{vocab.STAGES[1][2]}'
         WHEN day <= 15 THEN '{vocab.STAGES[2][2]}' ELSE '{vocab.STAGES[3][2]}' END) AS actions FROM v""")
def irrigation_schedule_query(spark, folder):
    names = F.array(*[F.lit(c) for c in PLAN_CROPS])
    t = F.col("temp")
    days = X.forecast(spark, folder).select("site_id", "date", "temp", "rainfall", "humidity").withColumns(
        {
            "crop": F.element_at(names, (F.pmod("site_id", F.lit(6)) + 1).cast("int")),
            "risk_level": F.when(t > 60, "HIGH").when(t > 30, "medium").otherwise("low"),
        }
    )
    plan = irrigation_schedule(days, ["site_id"], 20)
    return rounded(plan, "temperature", "rainfall", "humidity").withColumn("actions", F.array_join("actions", " | "))


# --- whole jobs ---------------------------------------------------------------------

SEASON_HISTORY = f"SELECT hist_id, crop, temp, rainfall, humidity FROM ({X.HISTORY})"
STATION = "['economy', 'large', 'medium', 'promo', 'small'][list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)]"
CLASS = """CASE WHEN rainfall > 8 THEN 'rainy' WHEN rainfall > 1.5 THEN 'showers' WHEN temp > 30 AND humidity < 50 THEN 'sunny'
  WHEN humidity > 75 AND rainfall <= 1 THEN 'humid_overcast' WHEN temp < 15 THEN 'cool' ELSE 'temperate' END"""


@query("season_etl", f"""
WITH h AS ({SEASON_HISTORY}),
s AS (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY hist_id) AS rn, count(*) OVER (PARTITION BY crop) AS n FROM h),
t AS (SELECT crop, unnest(range(1, 101)) AS day, n FROM (SELECT DISTINCT crop, least(n, 100) AS n FROM s)),
c AS (SELECT t.crop, day, temp, rainfall, humidity FROM t JOIN s ON s.crop = t.crop AND s.rn =
  CASE WHEN day <= t.n THEN day ELSE t.n - least(10, t.n) + 1 + (day - t.n - 1) % least(10, t.n) END),
e AS (SELECT {STATION} AS crop, CAST(ts AS DATE) AS date, avg(value) AS temp, min(value) AS rainfall,
             avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS humidity FROM events GROUP BY 1, 2),
d AS (SELECT crop, day, DATE '2024-01-01' + (day - 1)::INT AS date FROM t),
w AS (SELECT d.crop, d.day, coalesce(e.temp, l.temp, 25) AS temp, coalesce(e.rainfall, l.rainfall, 0) AS rainfall,
             coalesce(e.humidity, l.humidity, 65) AS humidity
  FROM d LEFT JOIN e USING (crop, date)
  LEFT JOIN (SELECT crop, arg_max(temp, date) AS temp, arg_max(rainfall, date) AS rainfall, arg_max(humidity, date) AS humidity FROM e GROUP BY 1) l
    ON l.crop = d.crop),
need AS (SELECT crop, round_even(avg(rainfall) * 10 / 100, 2) AS need, avg(5 + temp / 20) AS ph FROM c GROUP BY 1)
SELECT side, crop, date, round_even(temp, 2) AS temp, round_even(rainfall, 2) AS rainfall, round_even(humidity, 2) AS humidity,
       round_even(soil_ph, 2) AS soil_ph, need AS water_requirement, 100 AS growth_duration, {CLASS} AS weather_condition, true AS in_order FROM (
  SELECT 'crop' AS side, crop, DATE '2024-01-01' + (day - 1)::INT AS date, temp, rainfall, humidity, 5 + temp / 20 AS soil_ph FROM c
  UNION ALL SELECT 'weather', w.crop, DATE '2024-01-01' + (day - 1)::INT, temp, rainfall, humidity, ph FROM w JOIN need USING (crop))
JOIN need USING (crop)""")
def season_etl(spark, folder):
    h = X.history(spark, folder).select("hist_id", "crop", "temp", "rainfall", "humidity")
    h = h.withColumn("soil_ph", F.lit(5.0) + F.col("temp") / 20)
    types = ["click", "error", "purchase", "signup", "view"]
    station = F.element_at(
        F.array(*[F.lit(c) for c in X.CROPS]),
        F.array_position(F.array(*[F.lit(t) for t in types]), F.col("event_type")).cast("int"),
    )
    events = table(spark, folder, "events").select(
        station.alias("crop"), "ts", "value", F.get_json_object("props", "$.k").cast("double").alias("k")
    )
    how = {
        "temp": ("avg", "value"), "min_temp": ("min", "value"), "max_temp": ("max", "value"),
        "rainfall": ("min", "value"), "humidity": ("avg", "k"),
    }
    weather = daily_resample(events, ["crop"], "ts", how)
    starts = h.select("crop").distinct().withColumn("start_date", F.lit("2024-01-01").cast("date"))
    crop, observed = jobs.season_etl(h, weather, starts, ["hist_id"])
    both = crop.withColumn("side", F.lit("crop")).unionByName(observed.withColumn("side", F.lit("weather")))
    # Derived bounds lie around the mean by a hash that SQL lacks; observed ones around theirs.
    in_order = (F.col("min_temp") <= F.col("temp")) & (F.col("temp") <= F.col("max_temp"))
    return both.withColumn("in_order", in_order).drop("min_temp", "max_temp")


@query("planting_advice", f"""
WITH {H_AND_F.replace('f AS (', 'f0 AS (')}, hp AS (SELECT *, 5 + temp / 20 AS soil_ph FROM h),
rq AS (SELECT request_id, site_id, crop, CASE WHEN request_id % 4 = 0 THEN 6.5 ELSE 5 + request_id % 3 END::DOUBLE AS soil_ph,
              CASE WHEN request_id % 5 = 0 THEN 30 ELSE 12 END AS forecast_days FROM ({X.REQUESTS})),
n AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date) AS rn FROM f0),
a AS (SELECT request_id, rq.crop AS target, {', '.join(f'avg({m}) AS {m}' for m in FEATURES)}, max(soil_ph) AS soil_ph
      FROM rq JOIN n USING (site_id) WHERE rn <= forecast_days GROUP BY 1, 2),
m AS (SELECT DISTINCT a.* EXCLUDE (target), c.crop FROM a, (VALUES ('economy'), ('large'), ('promo'), ('barley')) v(x),
      LATERAL (SELECT unnest([target, x]) AS crop) c),
{X.neighbours_sql('hp', 'm', ['request_id'], 5, by='crop', features=[*FEATURES, 'soil_ph'])}, {X.vote_sql(['crop', 'request_id'])}
SELECT m.crop, m.request_id, similarity_score, success_probability, risk_level,
  CASE WHEN similarity_score IS NULL THEN 'no_history' ELSE 'answered' END AS status,
  CASE WHEN similarity_score >= 85 AND success_probability >= 80 THEN 'yes'
  WHEN similarity_score >= 70 AND success_probability >= 60 THEN 'alternative option like this' ELSE 'no' END AS recommended,
  row_number() OVER (PARTITION BY request_id ORDER BY similarity_score DESC NULLS LAST, m.crop)::INT AS rank
FROM m LEFT JOIN score USING (crop, request_id)""")
def planting_advice(spark, folder):
    h = X.history(spark, folder).withColumn("soil_ph", F.lit(5.0) + F.col("temp") / 20)
    n = F.col("request_id")
    rq = X.requests(spark, folder).withColumns(
        {
            "soil_ph": F.when(n % 4 != 0, (F.lit(5) + n % 3).cast("double")),
            "forecast_days": F.when(n % 5 != 0, F.lit(12)),
        }
    )
    return jobs.planting_advice(
        h, X.forecast(spark, folder), rq, features=[*FEATURES, "soil_ph"], crops=["economy", "large", "promo", "barley"]
    )


DAY_RISK = f"""
dp AS (WITH {X.neighbours_sql('h', 'f', SITE_DAY, 5)}, {X.vote_sql(SITE_DAY)} SELECT * FROM score)"""
BETTER = f"""
better AS (WITH w AS (SELECT rq.*, o AS "offset", start_date + o::INT AS window_start FROM rq, (VALUES (0), (7), (14)) v(o)),
m AS (SELECT request_id, w.crop, "offset", {', '.join(f'avg({m}) AS {m}' for m in FEATURES)}
      FROM w JOIN f ON f.site_id = w.site_id AND f.date BETWEEN window_start AND window_start + duration - 1
      GROUP BY 1, 2, 3, duration HAVING count(*) = duration),
{X.neighbours_sql('h', 'm', ['request_id', '"offset"'], 5, by='crop')}, {X.vote_sql(['crop', 'request_id', '"offset"'])}
SELECT a.request_id, count(*) AS better_starts FROM score a JOIN score b ON a.request_id = b.request_id AND b."offset" = 0
WHERE a."offset" > 0 AND a.success_probability > b.success_probability GROUP BY 1)"""


# One request names a site without a forecast.
ASKED = f"SELECT * FROM ({X.REQUESTS}) UNION ALL SELECT -1, -1, 'promo', DATE '2024-01-05', 10"


def _requests(spark, folder):
    asked = X.requests(spark, folder)
    nowhere = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("request_id"), F.lit(-1).cast("bigint").alias("site_id"), F.lit("promo").alias("crop"),
        F.lit("2024-01-05").cast("date").alias("start_date"), F.lit(10).alias("duration"),
    )
    return jobs.similarity_requests(
        X.history(spark, folder), materialise(X.forecast(spark, folder)), asked.unionByName(nowhere),
        features=FEATURES, measures=FEATURES,
    )


@query("similarity_requests", f"""
WITH {H_AND_F}, rq AS ({ASKED}), {DAY_RISK}, {BETTER},
days AS (SELECT rq.request_id, f.* FROM rq JOIN f ON f.site_id = rq.site_id AND f.date BETWEEN start_date AND start_date + duration - 1),
m AS (SELECT s.*, c.crop FROM (SELECT request_id, {', '.join(f'avg({m}) AS {m}' for m in FEATURES)} FROM days GROUP BY 1) s,
      (SELECT DISTINCT crop FROM h) c),
{X.neighbours_sql('h', 'm', ['request_id'], 5, by='crop')}, {X.vote_sql(['crop', 'request_id'])},
best AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY similarity_score DESC, crop) AS n FROM score)
SELECT rq.request_id, CASE WHEN d.days IS NULL THEN 'no_forecast' WHEN d.days < rq.duration THEN 'partial' ELSE 'answered' END AS status,
       best.crop AS best_crop, similarity_score, success_probability, best.risk_level, d.days, irrigation_mm,
       high_risk_days, coalesce(better_starts, 0) AS better_starts, d.days AS matched_days
FROM rq LEFT JOIN (SELECT * FROM best WHERE n = 1) best USING (request_id) LEFT JOIN (SELECT request_id, count(*) AS days, round_even(sum(round_even(greatest(0, 4.5::DOUBLE - rainfall), 2)), 6) AS irrigation_mm,
                       count(*) FILTER (WHERE risk_level = 'high') AS high_risk_days
                FROM days JOIN dp USING (site_id, date) GROUP BY 1) d USING (request_id)
LEFT JOIN better USING (request_id)""")
def similarity_requests(spark, folder):
    """Every request, answered or not; one summary row each."""
    out = _requests(spark, folder)
    best = out["crop_comparisons"].filter("rank = 1").select(
        "request_id", F.col("crop").alias("best_crop"), "similarity_score", "success_probability", "risk_level"
    )
    plan = out["schedule"].groupBy("request_id").agg(
        F.count(F.lit(1)).alias("days"),
        exprs.half_even(F.sum("irrigation_volume_mm"), 6).alias("irrigation_mm"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk_days"),
    )
    later = out["recommendations"].groupBy("request_id").agg(F.count(F.lit(1)).alias("better_starts"))
    pairs = out["scaled_pairs"].groupBy("request_id").agg(F.count(F.lit(1)).alias("matched_days"))
    joined = out["status"].select("request_id", "status")
    for part in (best, plan, later, pairs):
        joined = joined.join(part, "request_id", "left")
    return joined.fillna({"better_starts": 0})


@query("response_records", f"""
WITH {H_AND_F}, rq AS ({ASKED}), {BETTER},
days AS (SELECT rq.request_id, f.* FROM rq JOIN f ON f.site_id = rq.site_id AND f.date BETWEEN start_date AND start_date + duration - 1),
m AS (SELECT s.*, c.crop FROM (SELECT request_id, {', '.join(f'avg({m}) AS {m}' for m in FEATURES)} FROM days GROUP BY 1) s,
      (SELECT DISTINCT crop FROM h) c),
{X.neighbours_sql('h', 'm', ['request_id'], 5, by='crop')}, {X.vote_sql(['crop', 'request_id'])},
o AS (SELECT request_id, string_agg(crop, ',' ORDER BY similarity_score DESC, crop) AS crops FROM score GROUP BY 1),
d AS (SELECT request_id, count(*)::INT AS days FROM days GROUP BY 1)
SELECT request_id, CASE WHEN days IS NULL THEN 'no_forecast' WHEN days < duration THEN 'partial' ELSE 'answered' END AS status,
       coalesce(days, 0)::INT AS n_days, crops, days AS season_days, days AS matched_days, coalesce(better_starts, 0)::INT AS better_starts
FROM rq LEFT JOIN o USING (request_id) LEFT JOIN d USING (request_id) LEFT JOIN better USING (request_id)""")
def response_records(spark, folder):
    """The nested record of each request, its lists told by order and size."""
    records = jobs.response_records(_requests(spark, folder))
    sized = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return records.select(
        "request_id", "status", F.col("n_days").cast("int").alias("n_days"),
        F.array_join(F.transform("crop_comparisons", lambda c: c["crop"]), ",").alias("crops"),
        sized("schedule").alias("season_days"), sized("scaled_pairs").alias("matched_days"),
        F.coalesce(sized("recommendations"), F.lit(0)).alias("better_starts"),
    )


@query("export_daily_predictions", f"""
WITH {H_AND_F}, {DAY_RISK} SELECT date AS "Date", site_id AS "Site Id", similarity_score AS "Similarity Score",
  success_probability AS "Success Probability", risk_level AS "Risk Level" FROM dp""")
def export_daily_predictions(spark, folder):
    daily = U.predict_viability(X.history(spark, folder), X.forecast(spark, folder), "hist_id", SITE_DAY, FEATURES)
    return sinks.S.title_headers(daily)


@query("batch_comparisons", f"""
WITH h AS ({X.HISTORY}), f AS (SELECT date, {', '.join(f'avg({m}) AS {m}' for m in FEATURES)} FROM ({X.FORECAST}) GROUP BY 1),
m AS (SELECT s.*, c.crop FROM (SELECT 0 AS one, {', '.join(f'avg({m}) AS {m}' for m in FEATURES)} FROM f) s, (SELECT DISTINCT crop FROM h) c),
{X.neighbours_sql('h', 'm', ['one'], 5, by='crop')}, {X.vote_sql(['crop', 'one'])}
SELECT crop, similarity_score, success_probability, risk_level, o.*, round_even(n.temp, 6) AS forecast_temp,
       row_number() OVER (ORDER BY similarity_score DESC, crop)::INT AS rank
FROM score JOIN (SELECT crop AS c, {', '.join(f'round_even(median({m}), 6) AS optimal_{m}' for m in FEATURES)} FROM h GROUP BY 1) o ON c = crop
JOIN (SELECT avg(temp) AS temp FROM f) n ON true""".replace("o.*", ", ".join(f"optimal_{m}" for m in FEATURES)))
def batch_comparisons(spark, folder):
    """The comparisons of the batch run, one row per crop."""
    days = U.forecast_means(X.forecast(spark, folder), FEATURES, ["date"])
    out = jobs.batch_calculation(
        X.history(spark, folder), materialise(days), target_crop="promo", features=FEATURES, crops=X.CROPS
    )["crop_comparisons"]
    names = [f"optimal_{m}" for m in FEATURES]
    return rounded(out.select("crop", "similarity_score", "success_probability", "risk_level", *names, "forecast_temp", "rank"), *names, "forecast_temp")


@query("batch_calculation", f"""
WITH h AS ({X.HISTORY}), f AS (SELECT date, {', '.join(f'avg({m}) AS {m}' for m in FEATURES)} FROM ({X.FORECAST}) GROUP BY 1),
mt AS (WITH {OK_ALL}, {X.neighbours_sql('ok', 'f', ['date'], 5)} SELECT date, hist_id, distance FROM nn WHERE rank = 1),
dp AS (WITH {X.neighbours_sql('h', 'f', ['date'], 5)}, {X.vote_sql(['date'])} SELECT * FROM score)
SELECT date, 'promo' AS crop, similarity_score, success_probability, risk_level, hist_id,
       round_even(exp(-distance / 6) * 100, 2) AS similarity FROM dp JOIN mt USING (date)""")
def batch_calculation(spark, folder):
    """The batch run for one forecast, the mean over all sites."""
    days = U.forecast_means(X.forecast(spark, folder), FEATURES, ["date"])
    out = jobs.batch_calculation(
        X.history(spark, folder), materialise(days), target_crop="promo", features=FEATURES, crops=X.CROPS
    )
    best = out["matches"].filter("rank = 1").select("date", "hist_id", "similarity")
    return out["daily_predictions"].join(best, "date")


def flagship(spark, folder):
    """Every crop's own model against every site's forecast, ranked."""
    return _compared(spark, folder)
