"""Season schedule and better start dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs, vocab
from .season import season_day
from .suitability import predict_viability


def lookup_with_default(df: DataFrame, table: dict, key: str, out: str, default) -> DataFrame:
    """A fixed word list as a literal map: no join at all."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), exprs.normalise_text(key))
    return df.withColumn(out, F.coalesce(found, F.lit(default)))


def join_lookup(df: DataFrame, table: DataFrame, on: list[str], column: str, default) -> DataFrame:
    """The same for a table: left join, missing becomes the default."""
    found = df.join(table.select(*on, column), on, "left")
    return found.withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def irrigation_volume(need, rainfall):
    """Rounded deficit in millimetres; missing rain counts as none."""
    deficit = F.greatest(F.lit(0.0), need - F.coalesce(rainfall, F.lit(0.0)))
    return exprs.half_even(deficit)


def irrigation_schedule(
    days: DataFrame, keys: list[str], duration, crop: str = "crop", date: str = "date"
) -> DataFrame:
    """One row per key and season day with stage, water deficit and actions.

    ``days`` joins forecast and predictions on (key, date): one row a day with
    whichever of temp, rainfall, humidity, similarity_score and risk_level exist.
    """
    length = F.lit(duration) if isinstance(duration, int) else F.col(duration)
    for name, default in vocab.SCHEDULE_DEFAULTS.items():
        known = F.col(name) if name in days.columns else F.lit(None).cast("string" if isinstance(default, str) else "double")
        days = days.withColumn(name, F.coalesce(known, F.lit(default)))
    days = days.withColumn("risk_level", F.lower("risk_level"))
    days = lookup_with_default(days, vocab.WATER_NEED_MM, crop, "_need", vocab.DEFAULT_WATER_NEED_MM)
    deficit = F.greatest(F.lit(0.0), F.col("_need") - F.col("rainfall"))
    plan = season_day(days, keys, date).filter(F.col("day") <= length)
    plan = plan.withColumns(
        {
            "stage": exprs.growth_stage("day", length),
            "irrigation_needed": deficit > 0,
            "irrigation_volume_mm": irrigation_volume(F.col("_need"), F.col("rainfall")),
        }
    )
    # Needed follows the unrounded deficit; so does the first action.
    return plan.withColumn(
        "actions",
        exprs.daily_actions(
            "day", length, "irrigation_volume_mm", "risk_level", needed="irrigation_needed"
        ),
    ).select(
        *keys, "day", date, "stage", F.col("temp").alias("temperature"), "rainfall", "humidity",
        "similarity_score", "risk_level", "irrigation_needed", "irrigation_volume_mm", "actions",
    )


def start_windows(requests: DataFrame, offsets=(0, 7, 14), start: str = "start_date") -> DataFrame:
    """One row per request and offset with the window's first day."""
    asked = requests.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets])))
    return asked.withColumn("window_start", F.date_add(F.col(start), F.col("offset")))


def window_means(
    asked: DataFrame, forecast: DataFrame, sites: list[str], measures: list[str],
    duration: str = "duration", date: str = "date", whole: bool = True,
) -> DataFrame:
    """Mean forecast over ``duration`` days from ``window_start``, and ``n_days``.

    Only whole windows are compared: one of which the forecast lacks a day has no row.
    A site's running totals are looked up at the window's first and last day, so a
    window costs two lookups however long it is; it is whole if as many days lie
    between the two as it has. ``whole=False`` keeps the others, averaged over the days
    known; these list their days. Windows are made distinct first, so however many
    requests ask for the same one, it is averaged once. ``forecast`` has one row per
    site and day; nulls of a measure are left out of its mean, and a window with a NaN or
    infinite value has the mean NaN.
    """
    window = [*sites, "window_start", duration]
    windows = asked.select(*window).distinct()
    last = F.date_add("window_start", (F.col(duration) - 1).cast("int"))
    if not whole:
        days = windows.withColumn(date, F.explode(F.sequence("window_start", last)))
        means = days.join(forecast, [*sites, date]).groupBy(*window).agg(
            F.count(F.lit(1)).alias("n_days"), *[F.avg(m).alias(m) for m in measures]
        )
        return asked.join(means, window)
    upto = Window.partitionBy(*sites).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = {"_day": F.row_number().over(Window.partitionBy(*sites).orderBy(date))}
    odd = lambda m: F.coalesce(F.isnan(m) | (F.abs(m) == float("inf")), F.lit(False))
    # Totals are exact decimals, so a difference of two large ones loses nothing. NaN and
    # infinite values would spoil all later totals and are counted instead.
    exact = lambda m: F.when(~odd(m), F.col(m)).cast("decimal(38,15)")
    forecast = forecast.select(*sites, date, *[F.col(m).cast("double").alias(m) for m in measures])
    for m in measures:
        totals[f"_s_{m}"] = F.coalesce(F.sum(exact(m)).over(upto), F.lit(0).cast("decimal(38,15)"))
        totals[f"_n_{m}"] = F.count(m).over(upto)
        totals[f"_q_{m}"] = F.count(F.when(odd(m), 1)).over(upto)
    running = forecast.select(*sites, date, *measures).withColumns(totals)
    kept = ["_day", *[c for c in totals if c != "_day"]]
    at_end = running.select(*sites, F.col(date).alias("_last"), F.struct(*kept).alias("_to"))
    # Totals before the first day are those of that day less its own values.
    before = {"_day": F.col("_day") - 1}
    for m in measures:
        before[f"_s_{m}"] = F.col(f"_s_{m}") - F.coalesce(exact(m), F.lit(0).cast("decimal(38,15)"))
        before[f"_n_{m}"] = F.col(f"_n_{m}") - F.col(m).isNotNull().cast("int")
        before[f"_q_{m}"] = F.col(f"_q_{m}") - odd(m).cast("int")
    at_start = running.select(*sites, F.col(date).alias("window_start"), F.struct(*[v.alias(n) for n, v in before.items()]).alias("_from"))
    found = windows.withColumn("_last", last).join(at_end, [*sites, "_last"]).join(at_start, [*sites, "window_start"])
    of = lambda c: F.col(f"_to.{c}") - F.col(f"_from.{c}")
    means = found.filter((of("_day") == F.col(duration)) & (F.col(duration) > 0)).select(
        *window, of("_day").cast("bigint").alias("n_days"),
        *[F.when(of(f"_q_{m}") > 0, F.lit(float("nan"))).when(of(f"_n_{m}") > 0, of(f"_s_{m}").cast("double") / of(f"_n_{m}")).alias(m) for m in measures],
    )
    return asked.join(means, window)


def recommend_starts(
    history: DataFrame,
    forecast: DataFrame,
    requests: DataFrame,
    hist_id: str,
    request_id: str = "request_id",
    sites: list[str] = ["site_id"],
    features: list[str] = vocab.FEATURES,
    offsets=(7, 14),
    k: int = 5,
    crop: str = "crop",
    **blocks,
) -> DataFrame:
    """Later start dates with a strictly higher success probability than the base.

    Requests: id, site, crop, start_date, duration. All requests and offsets are
    scored in one job. Base and alternatives need whole windows; a request without a
    start date, or whose own window the forecast does not cover, has none. ``rank``
    orders the alternatives of a request, the most probable first.
    """
    starts = start_windows(requests.filter(F.col("start_date").isNotNull()), (0, *offsets))
    asked = window_means(starts, forecast, sites, features)
    scored = predict_viability(
        history, asked, hist_id, [request_id, "offset", "window_start"], features, k, [crop], **blocks
    )
    return better_starts(scored, request_id, crop)


def better_starts(scored: DataFrame, request_id: str = "request_id", crop: str = "crop") -> DataFrame:
    """Of scored windows (request, offset), the later ones that beat offset 0."""
    base = F.max(F.when(F.col("offset") == 0, F.col("success_probability")))
    later = F.collect_list(
        F.when(F.col("offset") != 0, F.struct(F.col("window_start").alias("start_date"), "success_probability"))
    )
    # A request has 1 + len(offsets) rows, so its list is short.
    per_request = scored.groupBy(request_id, crop).agg(base.alias("base_probability"), later.alias("_later"))
    better = per_request.select(request_id, crop, "base_probability", F.inline("_later")).filter(
        F.col("success_probability") > F.col("base_probability")
    )
    best_first = Window.partitionBy(request_id, crop).orderBy(F.desc("success_probability"), "start_date")
    return better.withColumn("rank", F.row_number().over(best_first))
