"""Similarity, success probability, risk, crop comparison and ranking.

Two models with different scalers and decay constants:
* the matcher scales by successful rows and decays with exp(-d / 6) per neighbour;
* the predictor scales by all rows and decays with exp(-mean d / 3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs, vocab
from ..plans.storage import materialise
from .neighbours import dealt_by_rows, knn_join
from .ordering import exact_median, match_on
from .scaling import apply_scaler, fit_scaler, scaler_aggregates

MATCH_DECAY = 6.0
PREDICT_DECAY = 3.0


def _z(features):
    return [f"z_{f}" for f in features]


def success_or_all(history: DataFrame, by: list[str] | None = None, label: str = "result") -> DataFrame:
    """Successful rows; a group without any keeps all its rows."""
    if label not in history.columns:
        return history
    seen = F.coalesce(F.max(F.col(label).cast("int")), F.lit(0)) >= 1
    if by:
        flags = materialise(history.groupBy(*by).agg(seen.alias("_any")))
        marked = match_on(history, flags, by)
        return marked.filter(~F.col("_any") | (F.col(label) == 1)).drop("_any")
    found = materialise(history.agg(seen.alias("_any"))).scalar()
    return history.filter(~found | (F.col(label) == 1))


def knn_similarity(
    history: DataFrame,
    queries: DataFrame,
    hist_id: str,
    query_id: str | list[str],
    features: list[str] = vocab.FEATURES,
    k: int = 5,
    by: list[str] | None = None,
    **blocks,
) -> DataFrame:
    """k most similar successful rows per query, with similarity in percent."""
    patterns = success_or_all(history, by)
    stats = materialise(fit_scaler(patterns, features, by))
    found = knn_join(
        apply_scaler(patterns, stats, features, by),
        apply_scaler(queries, stats, features, by),
        _z(features), hist_id, query_id, k, by, **blocks,
    )
    return found.withColumn("similarity", match_similarity())


def match_similarity(distance="distance"):
    return exprs.half_even(exprs.decay_percent(distance, MATCH_DECAY))


def vote(neighbours: DataFrame, keys: list[str], label: str = "result") -> DataFrame:
    """Distance-weighted share of successes and the mean distance, per query.

    Neighbours at distance zero, when there are any, decide alone.
    """
    d, y = F.col("distance"), F.col(label).cast("double")
    zeros = F.sum(F.when(d == 0, 1.0).otherwise(0.0))
    zero_hits = F.sum(F.when(d == 0, y).otherwise(0.0))
    weight = F.lit(1.0) / F.nullif(d, F.lit(0.0))
    p = F.when(zeros > 0, zero_hits / F.nullif(zeros, F.lit(0.0))).otherwise(
        F.sum(weight * y) / F.sum(weight)
    )
    return neighbours.groupBy(*keys).agg(
        p.alias("raw_probability"), F.avg(d).alias("mean_distance")
    )


def viability(votes: DataFrame, prob_scale: str = "percent") -> DataFrame:
    """Rounded similarity and probability and the risk class of each voted query."""
    sim = exprs.decay_percent("mean_distance", PREDICT_DECAY)
    prob = sim / 100.0 * F.col("raw_probability")
    return votes.withColumns(
        {
            "similarity_score": exprs.half_even(sim),
            "success_probability": exprs.half_even(prob * 100.0),
            "risk_level": exprs.risk_level(sim, prob, prob_scale),
        }
    ).drop("raw_probability", "mean_distance")


def success_probability(
    history: DataFrame,
    queries: DataFrame,
    hist_id: str,
    query_id: str | list[str],
    features: list[str] = vocab.FEATURES,
    k: int = 5,
    by: list[str] | None = None,
    label: str = "result",
    stats: DataFrame | None = None,
    **blocks,
) -> DataFrame:
    """The predictor's vote per query: raw probability and mean distance."""
    if stats is None:
        stats = materialise(fit_scaler(history, features, by))
    ids = [query_id] if isinstance(query_id, str) else query_id
    found = knn_join(
        apply_scaler(history, stats, features, by),
        apply_scaler(queries, stats, features, by),
        _z(features), hist_id, ids, k, by, payload=[label], **blocks,
    )
    return vote(found, [*(by or []), *ids], label)


def predict_viability(
    history: DataFrame,
    queries: DataFrame,
    hist_id: str,
    query_id: str | list[str],
    features: list[str] = vocab.FEATURES,
    k: int = 5,
    by: list[str] | None = None,
    prob_scale: str = "percent",
    **blocks,
) -> DataFrame:
    """Similarity, success probability and risk per query row."""
    votes = success_probability(history, queries, hist_id, query_id, features, k, by, **blocks)
    return viability(votes, prob_scale)


def crop_profile(history: DataFrame, features: list[str], crop: str = "crop", label: str = "result") -> DataFrame:
    """One materialised row per crop: scaler statistics over all rows (``__mean``)
    and over the matcher's rows (``__mean_ok``), and whether any row succeeded."""
    hit = F.col(label) == 1
    stats = history.groupBy(crop).agg(
        *scaler_aggregates(features),
        *scaler_aggregates(features, hit, "_ok"),
        (F.coalesce(F.max(F.col(label).cast("int")), F.lit(0)) >= 1).alias("any_success"),
    )
    fallback = {
        f"{f}__{s}_ok": F.when(F.col("any_success"), F.col(f"{f}__{s}_ok")).otherwise(F.col(f"{f}__{s}"))
        for f in features
        for s in ("mean", "sd")
    }
    return materialise(stats.withColumns(fallback))


def forecast_means(forecast: DataFrame, measures: list[str], keys: list[str] | None = None) -> DataFrame:
    return forecast.groupBy(*(keys or [])).agg(*[F.avg(m).alias(m) for m in measures])


def candidate_table(queries: DataFrame, profile: DataFrame, crops, keys: list[str], crop: str = "crop") -> DataFrame:
    """The (keys, crop) pairs to compare, as a table to join with.

    ``crops`` is such a table, a list of names, or None for every crop with history.
    The last two mean every key with every crop; that product is what was asked for,
    and only keys and names enter it.
    """
    if isinstance(crops, DataFrame):
        return crops.select(*keys, crop).distinct()
    names = profile.select(crop)
    if crops is not None:
        names = names.filter(F.col(crop).isin([c.strip().lower() for c in crops]))
    return materialise(queries.select(*keys).distinct().crossJoin(names))


def compare_crops(
    history: DataFrame,
    forecast: DataFrame,
    hist_id: str,
    sites: list[str],
    features: list[str] = vocab.FEATURES,
    measures: list[str] | None = None,
    crops: list[str] | None = None,
    k: int = 5,
    crop: str = "crop",
    prob_scale: str = "percent",
    profile: DataFrame | None = None,
    **blocks,
) -> DataFrame:
    """All sites and crops in one job: each site's mean forecast against each
    crop's own model, with the crop's medians, ranked by similarity.

    ``crops``: see candidate_table; crops without history have no model and no row. A
    crop without any reading of a measure stays, its median empty. ``measures`` are
    the columns reported as ``optimal_*`` (medians of history) and ``forecast_*`` (means).
    """
    if not sites:  # one forecast for all
        whole = compare_crops(
            history, forecast.withColumn("_site", F.lit(0)), hist_id, ["_site"], features, measures,
            crops, k, crop, prob_scale, profile, **blocks,
        )
        return whole.drop("_site")
    measures = measures or [m for m in ("temp", "humidity", "rainfall") if m in features]
    profile = crop_profile(history, features, crop) if profile is None else profile
    means = materialise(forecast_means(forecast, list(dict.fromkeys([*features, *measures])), sites))
    asked = means.join(candidate_table(means, profile, crops, sites, crop), sites)
    votes = success_probability(
        history, asked, hist_id, sites, features, k, [crop], stats=profile, **blocks
    )
    return ranked_comparison(history, means, viability(votes, prob_scale), sites, measures, crop)


def ranked_comparison(
    history: DataFrame, means: DataFrame, scored: DataFrame, sites: list[str], measures: list[str], crop: str = "crop"
) -> DataFrame:
    """Scored (site, crop) pairs with the crop's medians and the site's means, ranked."""
    optimal = exact_median(history, [crop], measures).select(
        crop, *[F.col(m).alias(f"optimal_{m}") for m in measures]
    )
    named = means.select(*sites, *[F.col(m).alias(f"forecast_{m}") for m in measures])
    best_first = Window.partitionBy(*sites).orderBy(F.desc("similarity_score"), F.col(crop))
    return (
        scored.join(optimal, [crop], "left").join(named, sites)
        .withColumn("rank", F.row_number().over(best_first))
    )


def match_sequence(
    history: DataFrame,
    forecast: DataFrame,
    hist_id: str,
    sites: list[str],
    date: str = "date",
    features: list[str] = vocab.FEATURES,
    crops: list[str] | None = None,
    crop: str = "crop",
    profile: DataFrame | None = None,
    shown: list[str] | None = None,
    **blocks,
) -> DataFrame:
    """Best successful history row per (site, crop, forecast day), with its values.

    ``shown`` (default: the date, if history has one, and the features) names the
    columns of the matched row that come along as ``matched_*``. A forecast that names
    its crop is matched with that crop only; for ``crops`` see candidate_table.
    """
    profile = crop_profile(history, features, crop) if profile is None else profile
    asked = forecast
    if crop not in forecast.columns:
        asked = forecast.join(candidate_table(forecast, profile, crops, sites, crop), sites)
    shown = [c for c in (date, *features) if c in history.columns] if shown is None else shown
    patterns = successful_patterns(history, profile, features, shown, crop)
    found = knn_join(
        patterns,
        apply_scaler(asked, profile, features, [crop], mark="_ok"),
        _z(features), hist_id, [*sites, date], 1, [crop], payload=[f"matched_{c}" for c in shown], **blocks,
    )
    return found.withColumn("similarity", match_similarity()).drop("rank")


def successful_patterns(
    history: DataFrame, profile: DataFrame, features: list[str], shown: list[str], crop: str = "crop"
) -> DataFrame:
    """Each crop's successful rows (all, where none is), scaled by them, with their
    ``shown`` columns once more as ``matched_*``."""
    # One join with the profile: the mark of success comes along with the scales.
    rows = history.join(profile, [crop]).filter(~F.col("any_success") | (F.col("result") == 1))
    patterns = rows.select(*history.columns, *[F.col(c).alias(f"matched_{c}") for c in shown])
    return apply_scaler(patterns, profile, features, [crop], mark="_ok")


def search_models(
    models: dict[str, DataFrame],
    questions: dict[str, tuple[str, DataFrame, list[str]]],
    features: list[str],
    hist_id: str,
    k: int = 5,
    crop: str = "crop",
    payload: list[str] | None = None,
    **blocks,
) -> dict[str, DataFrame]:
    """Neighbours of several sets of questions in several models of history, by one search.

    ``models``: name -> scaled history; one without the column ``crop`` is a single
    group. ``questions``: name -> (model, scaled questions, their id columns). All
    points are written, sampled and cut into blocks once, whatever the number of
    models and sets. Returns (crop, id columns, hist_id, payload, rank, distance) for
    each set; ``payload`` columns that a model lacks are empty.
    """
    z, payload = _z(features), payload or []
    grouped = {name: crop in df.columns for name, df in models.items()}

    def stack(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out

    points = stack([
        df.select(F.lit(name).alias("_model"), *[c for c in (crop, hist_id, *z, *payload) if c in df.columns])
        for name, df in models.items()
    ])
    asked = stack([
        df.select(F.lit(model).alias("_model"), F.lit(name).alias("_set"), *[crop] * grouped[model], *ids, *z)
        for name, (model, df, ids) in questions.items()
    ])
    all_ids = list(dict.fromkeys(i for _, _, ids in questions.values() for i in ids))
    by = ["_model", *[crop] * any(grouped.values())]
    found = materialise(knn_join(points, asked, z, hist_id, ["_set", *all_ids], k, by, payload, **blocks))
    return {
        name: found.filter(F.col("_set") == name).select(*[crop] * grouped[model], *ids, hist_id, *payload, "rank", "distance")
        for name, (model, _, ids) in questions.items()
    }


def nested_comparisons(
    compared: DataFrame, sequence: DataFrame, keys: list[str], measures: list[str], date: str = "date"
) -> DataFrame:
    """Comparisons in their nested form: optimal and forecast weather as structs and
    the match sequence as an array with one entry per forecast day."""
    at = [c for c in sequence.columns if c not in (*keys, date)]
    days = sequence.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(date, *at))).alias("historical_match_sequence")
    )
    weather = {
        f"{side}_weather": F.struct(*[F.col(f"{side}_{m}").alias(m) for m in measures])
        for side in ("optimal", "forecast")
    }
    flat = [f"{side}_{m}" for side in ("optimal", "forecast") for m in measures]
    return compared.withColumns(weather).drop(*flat).join(days, keys, "left")


def scaled_pairs(
    history: DataFrame,
    forecast: DataFrame,
    matches: DataFrame,
    hist_id: str,
    query_id: str | list[str],
    features: list[str] = vocab.FEATURES,
) -> DataFrame:
    """Forecast rows next to their matched rows, both scaled by all history."""
    ids = [query_id] if isinstance(query_id, str) else query_id
    stats = fit_scaler(history, features)
    ahead = apply_scaler(forecast, stats, features, prefix="forecast_")
    back = apply_scaler(history, stats, features, prefix="history_")
    pairs = matches.select(*ids, hist_id)
    pairs = pairs.join(ahead.select(*ids, *[f"forecast_{f}" for f in features]), ids)
    return pairs.join(back.select(hist_id, *[f"history_{f}" for f in features]), [hist_id])


def nested_matches(
    matches: DataFrame, history: DataFrame, hist_id: str, query_id: str | list[str], measures: list[str]
) -> DataFrame:
    """One row per query: its ranked matches as an array (k entries) and the best."""
    ids = [query_id] if isinstance(query_id, str) else query_id
    matches = materialise(matches)
    rows = matches.join(history.select(hist_id, *measures), [hist_id])
    entry = F.struct("rank", hist_id, "distance", "similarity", *measures)
    return (
        dealt_by_rows(rows, matches.count(), *ids).groupBy(*ids)
        .agg(F.sort_array(F.collect_list(entry)).alias("matched_patterns"))
        .withColumn("best_match", F.element_at("matched_patterns", 1))
    )
