import datetime as dt

import pytest
from pyspark.sql import functions as F

from agronimbus.functions import vocab
from agronimbus.operators import aggregates as A
from agronimbus.operators import names as N
from agronimbus.operators import ordering as O
from agronimbus.operators import planning as P
from agronimbus.operators import season as W

D = dt.date


def day(n):
    return D(2026, 5, 1) + dt.timedelta(days=n - 1)


# --- ordered operators ------------------------------------------------------------

def test_rows_are_numbered_across_blocks(spark, many_blocks):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.lit(None)).alias("k"), (F.lit(9999) - F.col("id")).alias("o"))
    assert O.in_blocks(df, ["k"], ["o"]).select("_block").distinct().count() > 4
    out = O.number_rows(df, ["k"], ["o"], total="n").orderBy("k", "o").collect()
    for k in ("hot", None):
        mine = [r for r in out if r.k == k]
        assert [r.rn for r in sorted(mine, key=lambda r: r.o)] == list(range(1, len(mine) + 1))
        assert {r.n for r in mine} == {len(mine)}


def test_median_of_even_odd_and_repeated_values(rows):
    df = rows([("a", 1.0, 5), ("a", 2.0, None), ("a", 4.0, 7), ("a", 4.0, 6), ("b", 3.0, None)], "c string, x double, y int")
    out = {r.c: (r.x, r.y) for r in O.exact_median(df, ["c"], ["x", "y"]).collect()}
    assert out == {"a": (3.0, 6.0), "b": (3.0, None)}


def test_median_agrees_with_the_built_in_one(spark, many_blocks):
    df = spark.range(3000).select((F.col("id") % 4).alias("k"), (F.xxhash64("id") % 1000).cast("double").alias("x"))
    got = {r.k: r.x for r in O.exact_median(df, ["k"], ["x"]).collect()}
    assert got == {r.k: r.x for r in df.groupBy("k").agg(F.median("x").alias("x")).collect()}


def test_median_of_small_groups_hot_key_and_continuous_values(spark, many_blocks):
    """Every group size up to 40, infinite and widely spread values, a key with most rows."""
    small = spark.range(1, 41).select(F.col("id").cast("string").alias("k"), F.explode(F.sequence(F.lit(1), F.col("id").cast("int"))).alias("i"))
    hot = spark.range(60_000).select(F.when(F.col("id") % 6 > 0, "hot").alias("k"), F.col("id").cast("int").alias("i"))
    x = F.when(F.col("i") % 11 == 0, F.lit(float("-inf"))).otherwise(F.pow(F.lit(10.0), F.xxhash64("k", "i") % 40) * F.xxhash64("i"))
    df = small.unionByName(hot).withColumn("x", x)
    want = {r.k: r.x for r in df.groupBy("k").agg(F.median("x").alias("x")).collect()}
    assert len(want) == 42 and {r.k: r.x for r in O.exact_median(df, ["k"], ["x"]).collect()} == want
    assert {r.k: r.x for r in O.exact_median(df, ["k"], ["x"], accuracy=100).collect()} == want


def test_median_sorts_only_what_lies_around_it(spark, many_blocks, monkeypatch):
    seen = []
    plain = O.running_total
    monkeypatch.setattr(O, "running_total", lambda df, *a: seen.append(df.count()) or plain(df, *a))
    df = spark.range(200_000).select(F.lit(1).alias("k"), (F.xxhash64("id") * 1.0).alias("x"))
    got = O.exact_median(df, ["k"], ["x"], accuracy=1_000).first().x
    assert got == df.agg(F.median("x")).first()[0]
    assert seen[0] <= 200_000 * 8 / 1_000


def test_first_n_per_key_with_number_or_column(rows):
    df = rows([(k, i, n) for k, n in (("a", 2), ("b", 9)) for i in range(5)], "k string, o int, n int")
    assert sorted((r.k, r.o) for r in O.first_n(df, ["k"], ["o"], 1).collect()) == [("a", 0), ("b", 0)]
    assert sorted((r.k, r.o, r["rank"]) for r in O.first_n(df, ["k"], ["o"], "n").collect()) == (
        [("a", 0, 1), ("a", 1, 2)] + [("b", i, i + 1) for i in range(5)]
    )


def test_join_without_keys_is_refused(rows):
    with pytest.raises(ValueError):
        O.match_on(rows([(1,)], "a int"), rows([(1,)], "a int"), [])


# --- season -------------------------------------------------------------------------

def test_failure_rows_come_from_the_means_after_cleaning(rows):
    df = rows([("rice", day(1), 20.0, 10.0, 60.0, 1), ("rice", day(2), 30.0, 20.0, 80.0, 1)],
              "crop string, date date, temp double, rainfall double, humidity double, result int")
    out = W.augment_failures(df, ["crop"]).filter("result = 0").orderBy("temp").collect()
    got = [(r.temp, r.min_temp, r.max_temp, r.rainfall, r.humidity, r.date) for r in out]
    assert got == [(10.0, 5.0, 15.0, 45.0, 98.0, D(2025, 1, 1)), (40.0, 35.0, 45.0, 0.0, 35.0, D(2025, 1, 1))]


def test_padding_repeats_the_last_ten_rows(rows):
    df = rows([("a", i, 5) for i in range(1, 13)] + [("b", 1, 5)], "crop string, n int, d int")
    out = W.pad_season(df, ["crop"], ["n"], 25)
    a = [r.n for r in out.filter("crop = 'a'").orderBy("season_day").collect()]
    assert a == list(range(1, 13)) + list(range(3, 13)) + [3, 4, 5]
    assert [r.n for r in out.filter("crop = 'b'").collect()] == [1] * 25
    cut = W.pad_season(df, ["crop"], ["n"], "d")
    assert cut.groupBy("crop").count().filter("count <> 5").count() == 0
    lengths = rows([("a", i, 3) for i in range(9)] + [("b", i, 7) for i in range(9)] + [("c", 0, None)], "crop string, n int, d int")
    sized = {r.crop: r["count"] for r in W.pad_season(lengths, ["crop"], ["n"], "d").groupBy("crop").count().collect()}
    assert sized == {"a": 3, "b": 7}


def test_padding_to_a_column_cuts_each_key_before_the_shuffle(rows, monkeypatch):
    seen = []
    monkeypatch.setattr(W, "materialise", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    W.pad_season(rows([("a", 1, 5), ("b", 2, 3)], "crop string, n int, d int"), ["crop"], ["n"], "d")
    assert "WindowGroupLimit" in seen[0]


def test_bounds_depend_on_the_key_only(spark):
    df = spark.range(200).withColumn("temp", F.lit(20.0))
    a = W.derive_bounds(df.repartition(1), ["id"]).orderBy("id").collect()
    assert a == W.derive_bounds(df.repartition(9), ["id"]).orderBy("id").collect()
    assert all(2 <= 20 - r.min_temp <= 5 and 2 <= r.max_temp - 20 <= 5 for r in a)
    assert len({r.min_temp for r in a}) > 100
    given = df.withColumn("min_temp", F.lit(1.0))
    assert W.derive_bounds(given, ["id"]).select("min_temp").distinct().count() == 1


def test_redating_by_day_and_by_hour(spark, many_blocks):
    df = spark.range(50).withColumn("k", F.lit("x"))
    days = [r.date for r in W.redate(df, ["k"], ["id"], "2026-05-01").orderBy("id").collect()]
    assert days == [day(n) for n in range(1, 51)]
    hours = [r.date for r in W.redate(df, ["k"], ["id"], "2026-05-01", per_day=24).orderBy("id").collect()]
    assert hours == [day(1)] * 24 + [day(2)] * 24 + [day(3)] * 2


def test_water_requirement(rows):
    df = rows([("a", 1.0, 100), ("a", 2.0, 100)], "crop string, rainfall double, d int")
    assert A.water_requirement(df, ["crop"], "d").first().water_requirement == 0.15


def test_value_counts_most_frequent_first(rows):
    out = A.value_counts(rows([(1,), (0,), (1,)], "result int"), "result").collect()
    assert [(r.result, r.n) for r in out] == [(1, 2), (0, 1)]


# --- schedule --------------------------------------------------------------------------

def test_ten_day_wheat_schedule_without_weather(rows):
    df = rows([("s", "Wheat ", day(n)) for n in range(1, 31)], "site_id string, crop string, date date")
    out = P.irrigation_schedule(df, ["site_id"], 10).orderBy("day").collect()
    assert len(out) == 10
    names = [s[1] for s in vocab.STAGES]
    assert [names.index(r.stage) for r in out] == [0, 1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert {(r.temperature, r.rainfall, r.humidity, r.similarity_score, r.risk_level) for r in out} == {(25.0, 0.0, 60.0, 75.0, "medium")}
    assert {r.irrigation_volume_mm for r in out} == {4.2}
    assert out[0].actions == ["Apply 4.2 mm of targeted irrigation.", vocab.RISK_TEXTS["medium"], vocab.STAGES[0][2]]
    assert out[6].actions[2] == vocab.TASK_DAYS[0][1]


def test_rain_reduces_irrigation_and_missing_rain_does_not(rows):
    df = rows([("s", "rice", day(1), 3.0, "HIGH"), ("s", "rice", day(2), 8.0, "low"), ("s", "rice", day(3), None, None)],
              "site_id string, crop string, date date, rainfall double, risk_level string")
    out = P.irrigation_schedule(df, ["site_id"], 100).orderBy("day").collect()
    assert [(r.irrigation_needed, r.irrigation_volume_mm) for r in out] == [(True, 5.0), (False, 0.0), (True, 8.0)]
    assert [a.split()[0] for a in out[0].actions] == ["Apply", "WARNING:", "Ensure"]
    assert out[1].actions == [vocab.NO_IRRIGATION_TEXT, vocab.STAGES[0][2]]
    assert out[2].actions[0] == "Apply 8.0 mm of targeted irrigation."


def test_unknown_crops_need_the_default(rows):
    out = P.lookup_with_default(rows([("Rice",), ("kale",), (None,)], "c string"), vocab.WATER_NEED_MM, "c", "n", 4.5)
    assert [r.n for r in out.collect()] == [8.0, 4.5, 4.5]


def test_only_strictly_better_later_starts_are_recommended(rows):
    history = rows([(1, "rice", 10.0, 1), (2, "rice", 12.0, 1), (3, "rice", 30.0, 0)], "hid long, crop string, temp double, result int")
    temps = [28.0] * 7 + [11.0] * 7 + [28.0] * 14
    forecast = rows([("s", day(i + 1), t) for i, t in enumerate(temps)], "site_id string, date date, temp double")
    requests = rows(
        [("r1", "s", "rice", day(1), 7), ("r2", "s", "maize", day(1), 7), ("r3", "s", "rice", day(8), 7), ("r4", "s", "rice", None, 7)],
        "request_id string, site_id string, crop string, start_date date, duration int",
    )
    out = P.recommend_starts(history, forecast, requests, "hid", features=["temp"], k=2).collect()
    assert [(r.request_id, r.start_date, r["rank"]) for r in out] == [("r1", day(8), 1)]
    assert out[0].success_probability > out[0].base_probability


def test_only_whole_windows_are_compared(rows):
    history = rows([(1, "rice", 10.0, 1), (2, "rice", 30.0, 0)], "hid long, crop string, temp double, result int")
    temps = [29.0] * 7 + [11.0] * 9  # the window from day 15 has two days, the whole one from day 8 seven
    forecast = rows([("s", day(i + 1), t) for i, t in enumerate(temps)] + [("t", day(2), 11.0)], "site_id string, date date, temp double")
    requests = rows(
        [("r1", "s", "rice", day(1), 7), ("r2", "s", "rice", day(1), 100), ("r3", "t", "rice", day(1), 1)],
        "request_id string, site_id string, crop string, start_date date, duration int",
    )
    windows = P.window_means(P.start_windows(requests), forecast, ["site_id"], ["temp"])
    assert sorted((r.request_id, r.offset, r.n_days) for r in windows.collect()) == [("r1", 0, 7), ("r1", 7, 7)]
    every = P.window_means(P.start_windows(requests), forecast, ["site_id"], ["temp"], whole=False)
    assert {(r.request_id, r.offset): r.n_days for r in every.collect()} == {
        ("r1", 0): 7, ("r1", 7): 7, ("r1", 14): 2, ("r2", 0): 16, ("r2", 7): 9, ("r2", 14): 2,
    }
    out = P.recommend_starts(history, forecast, requests, "hid", features=["temp"], k=1).collect()
    assert [(r.request_id, r.start_date) for r in out] == [("r1", day(8))]


# --- names -------------------------------------------------------------------------------

def test_crop_resolution_tiers(rows):
    crops = rows([(1, "maize"), (2, "rice"), (3, "kidneybeans"), (4, "beans")], "pos int, crop string")
    asked = rows([("Rice ",), ("Paddy",), ("red beans",), ("kidney",), ("xyz",), ("sorghum",), ("kidneybeans mix",), (None,)], "requested string")
    out = {r.requested: (r.resolved, r.tier) for r in N.resolve_crop(asked, crops).collect()}
    assert out == {
        "Rice ": ("rice", "exact"), "Paddy": ("rice", "synonym"), "red beans": ("beans", "partial"),
        "kidney": ("kidneybeans", "partial"), "xyz": (None, "none"), "sorghum": (None, "none"),
        "kidneybeans mix": ("kidneybeans", "partial"), None: (None, "none"),
    }
    first = N.resolve_crop(asked, crops.filter("pos > 2").union(crops.filter("pos < 0")), position="pos", mode="first")
    assert {r.requested: r.resolved for r in first.collect()}["kidneybeans mix"] == "kidneybeans"
    turned = N.resolve_crop(asked, crops.withColumn("pos", -F.col("pos")), position="pos", mode="first")
    assert {r.requested: r.resolved for r in turned.collect()}["kidneybeans mix"] == "beans"
    with pytest.raises(ValueError):
        N.resolve_crop(asked, crops, mode="first")


def test_long_names_and_empty_ones_are_resolved(rows):
    import random

    rng = random.Random(1)
    long = ["".join(rng.choice("abcdef") for _ in range(1_000)) for _ in range(8)]
    crops = rows([(x[100:110],) for x in long[:4]] + [("zz",)], "crop string")
    asked = rows([(x,) for x in long] + [("",), ("z",), (long[0][100:110],)], "requested string")
    out = {r.requested: (r.resolved, r.tier) for r in N.resolve_crop(asked, crops).collect()}
    for x in long[:4]:
        assert out[x] == (x[100:110], "partial")
    assert out[long[5]] == (None, "none") and out["z"] == ("zz", "partial") and out[long[0][100:110]][1] == "exact"
    assert out[""][1] == "partial"


def test_contained_names_equal_brute_force(spark):
    import random

    rng = random.Random(7)
    name = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    short = {name(rng.randint(0, 7)) for _ in range(150)} | {"", "a", "zz"}
    long = {name(rng.randint(0, 30)) for _ in range(150)} | {"", "a"}
    pairs = N.contained_names(
        spark.createDataFrame([(x,) for x in short], "a string"), "a", spark.createDataFrame([(x,) for x in long], "b string"), "b"
    )
    found = [tuple(r) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == {(x, y) for x in short for y in long if x in y}


def test_long_names_are_filed_once_per_letter(spark):
    import random

    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefgh") for _ in range(1_000)) for _ in range(40)]
    df = spark.createDataFrame([(x,) for x in names], "a string")
    assert N._pieces(df, "a", [N.PIECE]).count() <= 40 * 998
    # Names as long as all of the other side ask under one piece each.
    found = N.contained_names(df.withColumnRenamed("a", "b"), "b", df, "a")
    assert sorted(tuple(r) for r in found.collect()) == sorted((x, x) for x in names)


def test_catalogue_is_sorted_and_has_no_copies(rows):
    out = [r.crop for r in N.crop_catalogue(rows([("RICE",), (" rice",), ("zucchini",)], "crop string")).collect()]
    assert out == sorted(set(out)) and "Zucchini" in out and out.count("Rice") == 1
    assert set(vocab.CATALOGUE_CROPS) <= set(out)


HINTS = [
    ("grows in 90-120 days at 15 to 25 °C", 120, 25.0),
    ("ripe after 100 Days", 100, None),
    ("a duration of 80 and 20 °C", 80, None),
    ("45 days, later 60 to 75 days; 18-30C", 75, 30.0),
    ("no hint", None, None),
    (None, None, None),
]


def test_hints(rows):
    out = N.extract_hints(rows([(t,) for t, _, _ in HINTS], "t string"), "t").collect()
    assert [(r.duration_hint, r.temperature_hint) for r in out] == [(d, t) for _, d, t in HINTS]


def test_window_means_by_running_totals_equal_brute_force(spark, rows):
    import datetime
    import math
    import random

    rng, first = random.Random(3), datetime.date(2026, 1, 1)
    days = [(s, first + datetime.timedelta(i), rng.choice([None, float("nan"), 1e15, rng.uniform(-50, 50)] + [rng.uniform(-50, 50)] * 30), rng.uniform(0, 9))
            for s in range(4) for i in range(120) if rng.random() > 0.02]
    asked = [(i, rng.randrange(5), first + datetime.timedelta(rng.randrange(-3, 118)), rng.choice([1, 2, 7, 30])) for i in range(400)]
    asked += [(1000, 0, asked[0][2], 0), (1001, 0, asked[0][2], None)]
    given = rows(asked, "request_id int, site_id int, window_start date, duration int")
    means = P.window_means(given, rows(days, "site_id int, date date, temp double, rainfall double"), ["site_id"], ["temp", "rainfall"])
    plan = means._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    known, wanted = {(s, d): (t, r) for s, d, t, r in days}, {}
    for i, s, d, n in asked:
        window = [known.get((s, d + datetime.timedelta(j))) for j in range(n or 0)]
        if window and all(window):
            wanted[i] = [[x for x in v if x is not None] for v in zip(*window)]
    found = {r.request_id: r for r in means.collect()}
    assert found.keys() == wanted.keys() and len(found) > 50
    for i, parts in wanted.items():
        assert found[i].n_days == asked[i][3]
        for got, values in zip((found[i].temp, found[i].rainfall), parts):
            if not values or any(map(math.isnan, values)):
                assert got is None if not values else math.isnan(got)
            else:
                assert math.isclose(got, math.fsum(values) / len(values), rel_tol=1e-12, abs_tol=1e-13)
