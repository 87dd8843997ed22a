"""Whole jobs over tables of sites and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs, vocab
from ..operators import schema as S
from ..operators.aggregates import water_requirement
from ..operators.planning import better_starts, irrigation_schedule, start_windows, window_means
from ..operators.scaling import apply_scaler, fit_scaler
from ..operators.season import derive_bounds, pad_season
from ..operators.suitability import (
    candidate_table,
    compare_crops,
    crop_profile,
    forecast_means,
    knn_similarity,
    match_similarity,
    predict_viability,
    ranked_comparison,
    scaled_pairs,
    search_models,
    successful_patterns,
    viability,
    vote,
)
from ..operators.timeline import clean, clean_rows, complete, equalise_length
from ..sources import sinks
from .storage import materialise


def season_etl(
    history: DataFrame,
    weather: DataFrame,
    starts: DataFrame,
    order: list[str],
    durations: DataFrame | None = None,
    low: float = 2.5,
    high: float = 4.5,
) -> tuple[DataFrame, DataFrame]:
    """Aligned season tables (crop, weather) with the same schema and dates.

    ``history``: crop, temp, rainfall, humidity, soil_ph and the order columns;
    ``weather``: crop, date and measures, one row per crop and day or more;
    ``starts``: crop, start_date; ``durations``: crop, growth_duration.
    """
    length = F.lit(vocab.DEFAULT_DURATION).cast("int")
    if durations is None:
        sized = history.withColumn("growth_duration", length)
    else:
        hint = durations.select("crop", exprs.truthy_or("growth_duration", vocab.DEFAULT_DURATION).cast("int").alias("growth_duration"))
        sized = history.join(materialise(hint), ["crop"], "left").withColumn(
            "growth_duration", F.coalesce("growth_duration", length)
        )
    season = pad_season(sized, ["crop"], order, "growth_duration")
    season = derive_bounds(season, ["crop", "season_day"], low, high)
    season = season.join(starts, ["crop"]).withColumn(
        "date", F.date_add("start_date", F.col("season_day") - 1)
    )
    season = materialise(season.drop("season_day", "start_date", *order))
    season = season.join(water_requirement(season, ["crop"], "growth_duration"), ["crop"])
    # One row a day by construction, so the days need no merging and have no gaps.
    crop = materialise(complete(clean_rows(season, []), ["crop"], "date"))

    means = crop.groupBy("crop").agg(
        F.avg("soil_ph").alias("soil_ph"),
        F.avg("water_requirement").alias("water_requirement"),
        F.max("growth_duration").alias("growth_duration"),
    )
    kept = [c for c in weather.columns if c not in ("soil_ph", "water_requirement", "growth_duration")]
    observed = materialise(clean(weather.select(*kept).join(means.select("crop"), ["crop"]), ["crop"]))
    aligned = complete(equalise_length(observed, crop, ["crop"], "date"), ["crop"], "date")
    # Attached last, so that a crop without any weather has them too.
    aligned = aligned.join(means, ["crop"])
    return _finish(crop), _finish(aligned)


def _finish(df: DataFrame) -> DataFrame:
    """Classify before rounding, then the common schema."""
    df = df.withColumn("weather_condition", exprs.weather_condition())
    df = S.ensure_columns(df, S.SEASON_DAILY)
    rounded = [*vocab.MEASURES, "water_requirement"]
    return df.withColumns({c: exprs.half_even(c) for c in rounded})


def batch_calculation(
    history: DataFrame,
    forecast: DataFrame,
    hist_id: str = "hist_id",
    target_crop: str = "wheat",
    features: list[str] = vocab.FEATURES,
    crops: list[str] | None = vocab.BATCH_CROPS,
    folder: str | None = None,
    **blocks,
) -> dict[str, DataFrame]:
    """Match, predict and compare cleaned tables; export and log when a folder is given."""
    matches = materialise(knn_similarity(history, forecast, hist_id, "date", features, **blocks))
    daily = predict_viability(history, forecast, hist_id, "date", features, **blocks).withColumn(
        "crop", F.lit(target_crop)
    )
    daily = materialise(daily.select("date", "crop", "similarity_score", "success_probability", "risk_level"))
    compared = materialise(compare_crops(history, forecast, hist_id, [], features, crops=crops, **blocks))
    out = {"matches": matches, "daily_predictions": daily, "crop_comparisons": compared}
    if folder:
        short = {"temp": "temp", "rainfall": "rain", "humidity": "hum"}
        patterns = sinks.matched_patterns(
            matches, forecast, history, hist_id, "date",
            {m: n for m, n in short.items() if m in features}, crop=target_crop,
        )
        files = {
            "similarity_results": sinks.export_similarity_results(compared, folder),
            "matched_patterns": sinks.export_matched_patterns(patterns, folder),
            "future_predictions": sinks.export_future_predictions(daily, folder),
        }
        # Both tables are summaries: one row per crop, one per forecast day.
        record = compared.agg(F.collect_list(F.struct(*compared.columns)).alias("crops_comparisons"))
        summary = daily.agg(F.sort_array(F.collect_list(F.struct(*daily.columns))).alias("s")).scalar()
        record = record.withColumns(
            {
                "target_crop": F.lit(target_crop),
                "daily_forecast_summary": summary,
                "results_files": F.struct(*[F.lit(v).alias(k) for k, v in files.items()]),
            }
        )
        sinks.append_runs(record, f"{folder}/similarity_analysis_runs")
    return out


def similarity_requests(
    history: DataFrame,
    forecast: DataFrame,
    requests: DataFrame,
    hist_id: str = "hist_id",
    features: list[str] = vocab.FEATURES,
    measures: list[str] | None = None,
    crops: list[str] | None = None,
    durations: DataFrame | None = None,
    **blocks,
) -> dict[str, DataFrame]:
    """Answer a table of requests: request_id, site_id, crop, start_date, duration.

    ``forecast``: one row per site_id and date. A request compares all crops over
    its own window, looks for better start dates and plans its season; all four kinds
    of questions are answered by one search. The season's
    length is the request's own ``duration`` (the column may be missing), else the
    crop's growth_duration in ``durations`` (crop, growth_duration; without it the
    history's own column, if it has one), else the default.

    ``status`` has one row per request: ``answered``, ``partial`` (the forecast lacks
    days of the window; the comparison covers ``n_days``), ``no_forecast``, or
    ``no_history`` (its own crop was never seen: others are compared, but nothing is
    predicted for it).
    """
    requests = requests.withColumn("crop", exprs.normalise_text("crop"))
    own = F.col("duration") if "duration" in requests.columns else F.lit(None).cast("int")
    if durations is None and "growth_duration" in history.columns:
        durations = history
    if durations is not None:
        known = durations.groupBy(exprs.normalise_text("crop").alias("crop")).agg(F.max("growth_duration").cast("int").alias("_season"))
        requests = requests.join(known, ["crop"], "left")
        own = F.coalesce(own, F.when(F.col("_season") > 0, F.col("_season")))
    requests = requests.withColumn("duration", F.coalesce(own, F.lit(vocab.DEFAULT_DURATION)).cast("int")).drop("_season")
    requests = materialise(requests)
    profile = crop_profile(history, features)
    first = forecast.groupBy("site_id").agg(F.min("date").alias("_first"))
    begun = requests.join(first, ["site_id"]).withColumn("_from", F.coalesce("start_date", "_first"))
    days = begun.withColumn(
        "date", F.explode(F.sequence("_from", F.date_add("_from", (F.col("duration") - 1).cast("int"))))
    ).select("request_id", "site_id", F.col("crop").alias("target_crop"), "duration", "date")
    days = materialise(days.join(forecast, ["site_id", "date"]))
    covered = days.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_days"))
    grown = profile.select(F.col("crop").alias("_crop"))
    n_days = F.coalesce("n_days", F.lit(0))
    status = (
        F.when(n_days == 0, "no_forecast").when(F.col("_crop").isNull(), "no_history")
        .when(n_days < F.col("duration"), "partial").otherwise("answered")
    )
    status = (
        requests.join(covered, ["request_id"], "left").join(grown, F.col("crop") == F.col("_crop"), "left")
        .select("request_id", status.alias("status"), n_days.alias("n_days"), "duration")
    )
    measures = measures or [m for m in ("temp", "humidity", "rainfall") if m in features]
    means = materialise(forecast_means(days, list(dict.fromkeys([*features, *measures])), ["request_id"]))
    offered = means.join(candidate_table(means, profile, crops, ["request_id"]), ["request_id"])
    windows = window_means(
        start_windows(requests.filter(F.col("start_date").isNotNull())), forecast, ["site_id"], features
    )
    target = days.withColumnRenamed("target_crop", "crop")
    whole = materialise(fit_scaler(history, features))
    shown = [c for c in ("date", *features) if c in history.columns]
    day, window, pair = ["request_id", "date"], ["request_id", "offset", "window_start"], ["request_id"]
    found = search_models(
        {
            "crop": apply_scaler(history, profile, features, ["crop"]),
            "all": apply_scaler(history.drop("crop"), whole, features),
            "successes": successful_patterns(history, profile, features, shown),
        },
        {
            "pairs": ("crop", apply_scaler(offered, profile, features, ["crop"]), pair),
            "windows": ("crop", apply_scaler(windows, profile, features, ["crop"]), window),
            "days": ("all", apply_scaler(target, whole, features), day),
            "matches": ("successes", apply_scaler(target, profile, features, ["crop"], mark="_ok"), day),
        },
        features, hist_id, payload=["result", *[f"matched_{c}" for c in shown]], **blocks,
    )
    scored = viability(vote(found["pairs"], ["crop", *pair]))
    compared = materialise(ranked_comparison(history, means, scored, ["request_id"], measures))
    starts = better_starts(viability(vote(found["windows"], ["crop", *window])))
    daily = viability(vote(found["days"], day))
    plan = irrigation_schedule(target.join(daily, day, "left"), ["request_id"], "duration")
    sequence = found["matches"].filter("rank = 1").drop("rank", "result").withColumn("similarity", match_similarity())
    pairs = scaled_pairs(history, target, sequence, hist_id, ["request_id", "date"], features)
    return {
        "status": status,
        "crop_comparisons": compared,
        "recommendations": starts,
        "schedule": plan,
        "match_sequence": sequence,
        "scaled_pairs": pairs,
    }


def response_records(answers: dict[str, DataFrame]) -> DataFrame:
    """One nested row per request, answered or not. Its lists hold a row per crop,
    season day or start offset, so their length does not grow with the data. Better
    starts come most probable first."""
    parts = {
        "crop_comparisons": ["rank", "crop"],
        "schedule": ["day"],
        "recommendations": ["rank"],
        "scaled_pairs": ["date"],
    }
    out = answers["status"]
    for name, first in parts.items():
        df = answers[name]
        rest = [c for c in df.columns if c not in ("request_id", *first)]
        part = df.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct(*first, *rest))).alias(name))
        out = out.join(part, ["request_id"], "left")
    return out


def planting_advice(
    history: DataFrame,
    forecast: DataFrame,
    requests: DataFrame,
    hist_id: str = "hist_id",
    features: list[str] | None = None,
    measures: list[str] | None = None,
    crops: list[str] = vocab.ADVICE_CROPS,
    k: int = 5,
    **blocks,
) -> DataFrame:
    """Advice per request and crop from the grower's inputs; empty fields get defaults.

    The soil reading is a feature of the query; history must carry ``soil_ph``. A
    request has a row for each crop offered: where its site has no forecast or the
    crop no history, the scores are empty, ``status`` says why and ``recommended`` is no.
    """
    features = features or [*vocab.FEATURES, "soil_ph"]
    defaults = {c: v for c, v in vocab.ADVICE_DEFAULTS.items() if c in requests.columns}
    requests = requests.withColumns({c: exprs.truthy_or(c, v) for c, v in defaults.items()})
    requests = materialise(requests.withColumn("crop", exprs.normalise_text("crop")))
    weather = [f for f in features if f != "soil_ph"]
    # Mean of a site's first n days for every n; a request picks its n.
    by_day = Window.partitionBy("site_id").orderBy("date")
    upto = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    means = materialise(
        forecast.select(
            "site_id",
            F.row_number().over(by_day).alias("_day"),
            *[F.avg(f).over(upto).alias(f) for f in weather],
        )
    )
    known = means.groupBy("site_id").agg(F.max("_day").alias("_last"))
    placed = requests.join(known, ["site_id"]).withColumn("_day", F.least("forecast_days", "_last"))
    means = materialise(placed.join(means, ["site_id", "_day"]).select("request_id", *weather, "soil_ph"))
    listed = F.array_distinct(F.array_compact(F.array(F.col("crop"), *[F.lit(c) for c in crops])))
    offered = requests.select("request_id", F.explode(listed).alias("crop"))
    scored = predict_viability(history, means.join(offered, ["request_id"]), hist_id, "request_id", features, k, ["crop"], **blocks)
    seen = means.select("request_id", F.lit(True).alias("_seen"))
    scored = offered.join(scored, ["request_id", "crop"], "left").join(seen, ["request_id"], "left")
    status = F.when(F.col("_seen").isNull(), "no_forecast").when(F.col("similarity_score").isNull(), "no_history").otherwise("answered")
    best_first = Window.partitionBy("request_id").orderBy(F.desc_nulls_last("similarity_score"), "crop")
    return scored.withColumns(
        {
            "status": status,
            "recommended": F.coalesce(exprs.recommendation("similarity_score", "success_probability"), F.lit("no")),
            "rank": F.row_number().over(best_first),
        }
    ).drop("_seen")
