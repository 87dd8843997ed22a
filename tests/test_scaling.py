import math

import pytest
from pyspark.sql import functions as F

from agronimbus.functions.vocab import FEATURES
from agronimbus.operators.scaling import apply_scaler, attach_group_means, fit_scaler, min_max_scale

SCALE = "temp double, min_temp double, max_temp double, rainfall double, humidity double"
THREE = [(20.0, 15.0, 25.0, 100.0, 80.0), (25.0, 20.0, 30.0, 150.0, 85.0), (30.0, 25.0, 35.0, 200.0, 90.0)]


def test_each_feature_has_mean_zero_and_population_deviation_one(rows):
    df = rows(THREE, SCALE)
    out = apply_scaler(df, fit_scaler(df, FEATURES), FEATURES).orderBy("temp").collect()
    for f in FEATURES:
        z = [r[f"z_{f}"] for r in out]
        assert z == pytest.approx([-1.224745, 0, 1.224745], abs=1e-6)


def test_unparsable_values_count_as_zero_before_scaling(rows):
    df = rows([("20.0", 1.0), ("invalid", 2.0), (None, 3.0), ("nan", 4.0)], "temp string, rainfall double")
    stats = fit_scaler(df, ["temp", "rainfall"])
    assert stats.first()["temp__mean"] == pytest.approx(5.0)
    out = apply_scaler(df, stats, ["temp", "rainfall"]).collect()
    assert all(not math.isnan(r["z_temp"]) for r in out)


def test_transform_before_fit_raises(rows):
    df = rows(THREE, SCALE)
    with pytest.raises(ValueError, match="has not been fitted yet"):
        apply_scaler(df, df, FEATURES)


def test_missing_features_are_named_up_front(rows):
    with pytest.raises(ValueError, match="soil_ph"):
        fit_scaler(rows(THREE, SCALE), [*FEATURES, "soil_ph"])


def test_constant_feature_divides_by_one(rows):
    df = rows([(3.0,), (3.0,)], "temp double")
    assert [r["z_temp"] for r in apply_scaler(df, fit_scaler(df, ["temp"]), ["temp"]).collect()] == [0.0, 0.0]


def test_groups_have_their_own_statistics(rows):
    df = rows([("a", 1.0), ("a", 3.0), ("b", 10.0), ("b", 30.0)], "crop string, temp double")
    out = apply_scaler(df, fit_scaler(df, ["temp"], ["crop"]), ["temp"], ["crop"])
    assert sorted(r["z_temp"] for r in out.collect()) == [-1.0, -1.0, 1.0, 1.0]


def test_min_max_takes_all_numbers_and_constants_become_zero(rows):
    df = rows([(1, 5.0, "x"), (3, 5.0, "y"), (2, 5.0, "z")], "a int, b double, c string")
    out = min_max_scale(df).orderBy("c").collect()
    assert [(r.a, r.b, r.c) for r in out] == [(0.0, 0.0, "x"), (1.0, 0.0, "y"), (0.5, 0.0, "z")]


def test_group_means_follow_the_row(rows):
    df = rows([("a", 1.0), ("a", 3.0), (None, 7.0)], "crop string, soil_ph double")
    out = attach_group_means(df, ["soil_ph"], ["crop"]).orderBy("soil_ph").collect()
    assert [r.soil_ph_mean for r in out] == [2.0, 2.0, 7.0]
    whole = attach_group_means(df, ["soil_ph"]).agg(F.max("soil_ph_mean")).first()[0]
    assert whole == pytest.approx(11 / 3)
