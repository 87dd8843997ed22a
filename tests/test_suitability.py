import math

import pytest
from pyspark.sql import functions as F

from agronimbus.functions import exprs
from agronimbus.functions.vocab import FEATURES
from agronimbus.operators import suitability as U

HIST = "hist_id long, date string, crop string, temp double, min_temp double, max_temp double, rainfall double, humidity double, result int"
FIVE = [
    (1, "2025-01-01", "rice", 28.0, 24.0, 32.0, 150.0, 80.0, 1),
    (2, "2025-01-02", "rice", 30.0, 26.0, 34.0, 180.0, 85.0, 1),
    (3, "2025-01-03", "wheat", 20.0, 15.0, 25.0, 50.0, 60.0, 1),
    (4, "2025-01-04", "wheat", 22.0, 17.0, 27.0, 60.0, 65.0, 1),
    (5, "2025-01-05", "rice", 29.0, 25.0, 33.0, 160.0, 82.0, 0),
]
ASK = "site_id string, date string, temp double, min_temp double, max_temp double, rainfall double, humidity double"


@pytest.fixture(scope="module")
def history(spark):
    return spark.createDataFrame(FIVE, HIST)


@pytest.fixture(scope="module")
def forecast(spark):
    return spark.createDataFrame([("s", "2026-05-01", 29.0, 25.0, 33.0, 155.0, 81.0)], ASK)


def expected(history, query, k):
    """The predictor written out for one query."""
    n = len(history)
    mean = [sum(h[3 + i] for h in history) / n for i in range(5)]
    sd = [math.sqrt(sum((h[3 + i] - mean[i]) ** 2 for h in history) / n) or 1.0 for i in range(5)]
    d = sorted(
        (math.sqrt(sum(((h[3 + i] - query[i]) / sd[i]) ** 2 for i in range(5))), h[0], h[8]) for h in history
    )[:k]
    sim = 100 * math.exp(-sum(x[0] for x in d) / len(d) / 3)
    if d[0][0] == 0:
        p = sum(y for x, _, y in d if x == 0) / sum(1 for x, _, _ in d if x == 0)
    else:
        p = sum(y / x for x, _, y in d) / sum(1 / x for x, _, _ in d)
    return sim, sim / 100 * p


def test_viability_follows_the_formulas(history, forecast):
    out = U.predict_viability(history, forecast, "hist_id", "date", k=2).first()
    sim, prob = expected(FIVE, (29.0, 25.0, 33.0, 155.0, 81.0), 2)
    assert out.similarity_score == pytest.approx(round(sim, 2))
    assert out.success_probability == pytest.approx(round(100 * prob, 2))
    assert out.risk_level in ("low", "medium", "high")


def test_zero_distance_neighbours_decide_alone(spark, history):
    exact = spark.createDataFrame([("s", "d", 29.0, 25.0, 33.0, 160.0, 82.0)], ASK)
    out = U.success_probability(history, exact, "hist_id", "date", k=3).first()
    assert out.raw_probability == 0.0
    good = spark.createDataFrame([("s", "d", 28.0, 24.0, 32.0, 150.0, 80.0)], ASK)
    assert U.success_probability(history, good, "hist_id", "date", k=3).first().raw_probability == 1.0


def test_one_class_only(spark, history, forecast):
    wheat = history.filter("crop = 'wheat'")
    assert U.success_probability(wheat, forecast, "hist_id", "date").first().raw_probability == 1.0
    failed = wheat.withColumn("result", F.lit(0))
    assert U.success_probability(failed, forecast, "hist_id", "date").first().raw_probability == 0.0


def test_k_is_cut_to_the_number_of_rows(history, forecast):
    got = U.predict_viability(history, forecast, "hist_id", "date", k=50).first()
    sim, _ = expected(FIVE, (29.0, 25.0, 33.0, 155.0, 81.0), 5)
    assert got.similarity_score == pytest.approx(round(sim, 2))


def test_matcher_uses_successful_rows_and_its_own_decay(spark, history, forecast):
    out = U.knn_similarity(history, forecast, "hist_id", "date", k=2).orderBy("rank").collect()
    assert len(out) == 2 and 5 not in [r.hist_id for r in out]
    for r in out:
        assert 0 < r.similarity <= 100
        assert r.similarity == pytest.approx(round(100 * math.exp(-r.distance / 6), 2))


def test_matcher_falls_back_to_all_rows_without_a_success(history, forecast):
    failed = history.withColumn("result", F.lit(0))
    assert U.knn_similarity(failed, forecast, "hist_id", "date", k=5).count() == 5
    assert U.knn_similarity(history.drop("result"), forecast, "hist_id", "date", k=5).count() == 5
    by_crop = U.success_or_all(history.withColumn("result", F.expr("if(crop = 'rice', 0, result)")), ["crop"])
    assert by_crop.count() == 5


def test_comparison_ranks_crops_with_their_own_models(history, forecast):
    out = U.compare_crops(history, forecast, "hist_id", ["site_id"], crops=["Rice", "wheat ", "maize"]).orderBy("rank").collect()
    assert [r.crop for r in out] == ["rice", "wheat"]  # maize has no history
    for r in out:
        mine = [h for h in FIVE if h[2] == r.crop]
        sim, prob = expected(mine, (29.0, 25.0, 33.0, 155.0, 81.0), 5)
        assert r.similarity_score == pytest.approx(round(sim, 2))
        assert r.success_probability == pytest.approx(round(100 * prob, 2))
    assert out[0].similarity_score >= out[1].similarity_score
    rice = next(r for r in out if r.crop == "rice")
    assert (rice.optimal_temp, rice.optimal_humidity, rice.optimal_rainfall) == (29.0, 82.0, 160.0)
    assert rice.forecast_rainfall == 155.0


def test_comparison_without_sites_is_one_forecast(history, forecast):
    one = U.compare_crops(history, forecast, "hist_id", []).orderBy("rank").collect()
    assert [r.crop for r in one] == ["rice", "wheat"] and "site_id" not in one[0].asDict()


def test_equal_scores_rank_by_name(spark, history, forecast):
    twins = history.filter("crop = 'rice'")
    twins = twins.unionByName(twins.withColumn("crop", F.lit("barley"))).unionByName(twins.withColumn("crop", F.lit("sorghum")))
    out = U.compare_crops(twins, forecast, "hist_id", ["site_id"]).orderBy("rank").collect()
    assert [r.crop for r in out] == ["barley", "rice", "sorghum"] and len({r.similarity_score for r in out}) == 1


def test_match_sequence_takes_the_best_successful_row_per_day(spark, history):
    days = spark.createDataFrame(
        [("s", "d1", 28.0, 24.0, 32.0, 150.0, 80.0), ("s", "d2", 30.0, 26.0, 34.0, 180.0, 85.0)], ASK
    )
    out = U.match_sequence(history, days, "hist_id", ["site_id"]).collect()
    got = {(r.crop, r.date): (r.hist_id, r.similarity) for r in out}
    assert got[("rice", "d1")] == (1, 100.0) and got[("rice", "d2")] == (2, 100.0)
    assert len(got) == 4 and got[("wheat", "d2")][0] == 4


def test_nested_view_has_ranked_matches_and_the_best(history, forecast):
    found = U.knn_similarity(history, forecast, "hist_id", "date", k=3)
    out = U.nested_matches(found, history, "hist_id", "date", FEATURES).first()
    assert [m["rank"] for m in out.matched_patterns] == [1, 2, 3]
    assert out.best_match.hist_id == out.matched_patterns[0].hist_id


def test_matches_are_nested_in_tasks_of_bounded_rows(history, rows, monkeypatch):
    import re

    from agronimbus.operators import neighbours as N

    monkeypatch.setattr(N, "TASK_ROWS", 10)
    ids = [r.hist_id for r in history.select("hist_id").limit(3).collect()]
    found = [(day, hid, 1 + at, float(at), 90.0) for day in range(40) for at, hid in enumerate(ids)]
    matches = rows(found, "day int, hist_id long, rank int, distance double, similarity double").coalesce(1)
    nested = U.nested_matches(matches, history, "hist_id", "day", FEATURES)
    got = {r.day: [m.hist_id for m in r.matched_patterns] for r in nested.collect()}
    assert got == {day: ids for day in range(40)}
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(day[^\n]*, 12\), REPARTITION_BY_NUM", plan)


def test_scaled_pairs_share_one_scaler(history, forecast):
    found = U.knn_similarity(history, forecast, "hist_id", "date", k=1)
    out = U.scaled_pairs(history, forecast, found, "hist_id", "date").first()
    assert out.forecast_temp == pytest.approx((29 - 25.8) / math.sqrt(sum((x - 25.8) ** 2 for x in (28, 30, 20, 22, 29)) / 5))
    assert "history_humidity" in out.asDict()


def test_probability_is_compared_in_percent_by_default(rows):
    df = rows([(90.0, 0.8), (90.0, 0.7), (70.0, 0.99), (67.9, 1.0)], "s double, p double")
    got = df.select(exprs.risk_level("s", "p").alias("a"), exprs.risk_level("s", "p", "fraction").alias("b")).collect()
    assert [r.a for r in got] == ["low", "medium", "medium", "high"]
    assert [r.b for r in got] == ["medium", "medium", "medium", "high"]
    with pytest.raises(ValueError):
        exprs.risk_level("s", "p", "ratio")


# Quoted results of earlier runs: distance and score.
GOLDEN_DECAY = [(1.6315805726462214, 76.19), (1.4289993179909495, 78.81)]
# Quoted results: similarity, success probability (percent), class.
GOLDEN_RISK = [(55.84, 55.84, "high"), (58.38, 58.38, "high"), (30.61, 30.61, "high"), (30.04, 30.04, "high")]


def test_golden_scores(rows):
    got = rows(GOLDEN_DECAY, "d double, s double").select(U.match_similarity("d").alias("x"), "s").collect()
    assert all(r.x == r.s for r in got)
    got = rows(GOLDEN_RISK, "s double, p double, k string").select(exprs.risk_level("s", F.col("p") / 100).alias("x"), "k")
    assert all(r.x == r.k for r in got.collect())
