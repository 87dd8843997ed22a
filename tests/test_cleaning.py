import datetime as dt

import pytest
from pyspark.sql import functions as F

from agronimbus.functions import exprs
from agronimbus.functions.vocab import FEATURES, MEASURE_DEFAULTS
from agronimbus.operators import schema as S
from agronimbus.operators import timeline as L

D = dt.date
DAYS = "site string, date date, event int, temp double, crop string"


def day(n):
    return D(2026, 5, n)


def test_demo_table_without_dates_or_ph(rows):
    """A table that lacks soil_ph and bounds is cleaned on what it has."""
    df = rows(
        [(1, 20.5, 1.2, 80, "Rice"), (2, None, 0.0, 75, " RICE "), (3, 22.1, None, 82, "wheat")],
        "row_no int, Temperature double, rainfall double, humidity long, ` CROP` string",
    )
    out = L.clean(df, [], order="row_no").orderBy("row_no").collect()
    assert [r.temp for r in out] == pytest.approx([20.5, 21.3, 22.1])
    assert [r.rainfall for r in out] == [1.2, 0.0, 0.0]
    assert [r.crop for r in out] == ["rice", "rice", "wheat"]
    assert "soil_ph" not in out[0].asDict()


def test_five_features_pass_unchanged(rows):
    data = [(25.0, 20.0, 30.0, 0.0, 60.0), (26.0, 21.0, 31.0, 5.0, 70.0), (27.0, 22.0, 32.0, 0.0, 65.0)]
    df = rows([(i, *v) for i, v in enumerate(data)], "n int, " + ", ".join(f"{f} double" for f in FEATURES))
    out = L.clean(df, [], order="n").orderBy("n").select(*FEATURES).collect()
    assert [tuple(r) for r in out] == data


def test_gaps_sentinels_and_duplicates(rows):
    df = rows(
        [
            ("a", "2026-05-01", 2, "-999.0", "x"), ("a", "2026-05-01", 3, "10", None), ("a", "2026-05-04", 1, "16", "y"),
            ("a", "2026-05-06", 1, "bad", None), ("b", "2026-05-02", 1, "nan", "q"),
        ],
        "site string, Date string, n int, T2M string, Weather_Condition string",
    )
    out = L.clean(df, ["site"], order="n").orderBy("site", "date").collect()
    assert [(r.site, r.date.day, r.temp) for r in out] == [
        ("a", 1, 10.0), ("a", 2, 12.0), ("a", 3, 14.0), ("a", 4, 16.0), ("a", 5, 16.0), ("a", 6, 16.0), ("b", 2, 25.0),
    ]
    assert [r.weather_condition for r in out] == ["x", "x", "x", "y", "y", "y", "q"]


def test_days_are_kept_apart_by_key_or_merged_without_one(rows):
    df = rows([("rice", day(1), 1, 5.0, "rice"), ("wheat", day(1), 2, 9.0, "wheat")], DAYS)
    assert L.clean(df, ["site"], order="event").count() == 2
    merged = L.clean(df.drop("site"), [], order="event").collect()
    assert [(r.temp, r.crop) for r in merged] == [(5.0, "rice")]


def test_result_is_never_filled(rows):
    df = rows([("a", day(1), 1, 5.0, 0), ("a", day(4), 2, 8.0, 1)], "site string, date date, event int, temp double, result int")
    out = L.clean(df, ["site"], order="event").orderBy("date").collect()
    assert [r.result for r in out] == [0, None, None, 1]
    assert [r.temp for r in out] == [5.0, 6.0, 7.0, 8.0]


def test_cleaning_twice_changes_nothing_and_leaves_no_gaps(spark, rows):
    df = rows(
        [("a", day(d), i, t, c) for i, (d, t, c) in enumerate([(1, None, "X "), (3, 4.0, None), (9, -9999.0, "y"), (9, 2.0, "z")])],
        DAYS,
    )
    once = L.clean(df, ["site"], order="event")
    twice = L.clean(once.withColumn("event", F.lit(1)), ["site"], order="event")
    a = sorted(map(tuple, once.select("site", "date", "temp", "crop").collect()))
    assert a == sorted(map(tuple, twice.select("site", "date", "temp", "crop").collect()))
    assert [x[1] for x in a] == [day(d) for d in range(1, 10)]
    assert all(x[2] is not None for x in a)


@pytest.mark.parametrize("parts", [1, 7])
def test_partitioning_does_not_change_the_series(rows, parts):
    df = rows([("a" if i % 3 else "b", day(1 + i % 20), i, float(i) if i % 4 else None, "c") for i in range(90)], DAYS)
    got = L.clean(df.repartition(parts), ["site"], order="event")
    want = L.clean(df, ["site"], order="event")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_interpolation_by_position_with_nearest_ends(rows):
    df = rows([(i, x) for i, x in enumerate([None, 1.0, None, None, 4.0, None])], "n int, x double")
    out = L.interpolate(df, [], "n", ["x"]).orderBy("n").collect()
    assert [r.x for r in out] == [1, 1, 2, 3, 4, 4]


def test_long_series_are_filled_across_blocks(spark, many_blocks):
    df = spark.range(4000).select(
        (F.col("id") % 2).alias("k"), "id", F.when(F.xxhash64("id") % 700 == 0, F.col("id") * 1.5).alias("x"),
        F.when(F.xxhash64("id") % 900 == 1, F.col("id").cast("string")).alias("t"),
    )
    cut = L.settle(df, ["k"], "id", ["x"], ["t"], daily=False)
    whole = L.settle(df, ["k"], "id", ["x"], ["t"], daily=True)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))
    assert cut.filter("x is null or t is null").count() == 0


def test_fill_goes_forward_then_back(rows):
    df = rows([(i, x) for i, x in enumerate([None, "a", None, "b", None])], "n int, x string")
    assert [r.x for r in L.fill_forward_back(df, [], "n", ["x"]).orderBy("n").collect()] == ["a", "a", "a", "b", "b"]


def test_defaults_only_where_nothing_is_known(rows):
    df = rows([(None, None, 3.0)], "temp double, soil_ph double, rainfall double")
    assert tuple(L.fill_defaults(df).first()) == (MEASURE_DEFAULTS["temp"], MEASURE_DEFAULTS["soil_ph"], 3.0)


def test_first_non_null_follows_the_order_column(rows):
    df = rows([("a", day(1), 3, 1.0, "late"), ("a", day(1), 1, None, "early"), ("a", day(1), 2, 7.0, None)], DAYS)
    out = L.first_per_day(df, ["site"], "date", "event").first()
    assert (out.temp, out.crop) == (7.0, "early")


def test_shorter_and_longer_series_take_the_reference_length(rows):
    ref = rows([("a", day(d)) for d in (1, 2, 3)] + [("b", day(d)) for d in (5, 6)], "site string, date date")
    df = rows([("a", day(2), 1.0)] + [("b", day(d), 2.0) for d in (1, 2, 3)], "site string, date date, temp double")
    out = L.equalise_length(df, ref, ["site"], "date").orderBy("site", "date").collect()
    assert [(r.site, r.date.day, r.temp) for r in out] == [("a", 1, None), ("a", 2, 1.0), ("a", 3, None), ("b", 1, 2.0), ("b", 2, 2.0)]
    one = L.equalise_length(df.filter("site = 'b'").drop("site"), ref.filter("site = 'b'").drop("site"), [], "date")
    assert one.count() == 2


def test_headers_collide_loudly(rows):
    with pytest.raises(ValueError, match="temp"):
        S.apply_aliases(S.plain_headers(rows([(1.0, 2.0)], "Temperature double, T2M double")))


def test_conform_adds_missing_columns_in_order(rows):
    out = S.conform(rows([("Rice", 7)], "Label string, Temperature int"), S.CROP_HISTORY, defaults={"result": 1})
    assert out.columns == S.CROP_HISTORY.names
    r = out.first()
    assert (r.crop, r.temp, r.rainfall, r.result) == ("Rice", 7.0, None, 1)
    S.require_same_schema(out, out)
    with pytest.raises(ValueError, match="schema mismatch"):
        S.require_same_schema(out, out.drop("result"))


def test_numbers_texts_dates(rows):
    df = rows([("12.5", " Basmati RICE\t", "20260501", "2026-05-01 03:00:00", 0.125)], "n string, t string, c string, d string, x double")
    r = df.select(
        exprs.to_number("n").alias("n"), exprs.to_number(F.lit("NaN")).alias("nan"), exprs.normalise_text("t").alias("t"),
        exprs.capitalise(exprs.normalise_text("t")).alias("cap"), exprs.compact_date("c").alias("c"),
        exprs.leading_date("d").alias("d"), exprs.half_even("x").alias("x"), exprs.half_even(F.lit(2.675)).alias("y"),
        exprs.clip(F.lit(None).cast("double"), 0.0).alias("none"), exprs.truthy_or(F.lit(0), 100).alias("zero"),
    ).first()
    assert (r.n, r.nan, r.t, r.cap) == (12.5, None, "basmati rice", "Basmati rice")
    assert (r.c, r.d, r.x, r.y, r.none, r.zero) == (D(2026, 5, 1), D(2026, 5, 1), 0.12, 2.68, None, 100)


# Quoted rows: temp, rainfall, humidity, class.
GOLDEN_WEATHER = [
    (26.49, 8.17, 51.8, "rainy"), (24.59, 2.52, 83.31, "showers"), (31.1, 2.37, 61.85, "showers"), (20.88, 202.94, 82.0, "rainy"),
    (29.57, 1.1, 60.31, "temperate"), (30.88, 1.08, 64.43, "temperate"), (29.88, 8.09, 73.83, "rainy"),
]


def test_golden_weather_classes(rows):
    df = rows(
        GOLDEN_WEATHER
        + [(30.1, 1.5, 49.9, "sunny"), (30.0, 0.0, 49.0, "temperate"), (20.0, 1.0, 75.1, "humid_overcast"),
           (20.0, 1.1, 80.0, "temperate"), (14.9, 0.0, 75.0, "cool"), (None, None, None, "temperate")],
        "temp double, rainfall double, humidity double, label string",
    )
    assert df.filter(exprs.weather_condition() != F.col("label")).count() == 0


def test_sentinel_rows_are_cleaned_before_they_are_classified(rows):
    df = rows([("rice", "2026-05-16", 31.0, 0.2, 45.0), ("rice", "2026-05-17", -999.0, -999.0, -999.0)],
              "crop string, date string, temp double, rainfall double, humidity double")
    out = L.clean(df, ["crop"]).withColumn("w", exprs.weather_condition()).orderBy("date").collect()
    assert [r.w for r in out] == ["sunny", "sunny"]
