"""Daily series: one row per day, no missing days, no missing values.

After ``first_per_day`` a key has at most one row per calendar day, so the
windows below sort days, not raw rows: a key's window is as long as its calendar
range, however many readings the key has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs, vocab
from .ordering import first_n, nearest_known
from .schema import apply_aliases, plain_headers


def first_per_day(
    df: DataFrame, keys: list[str], date: str, order: str | list[str], columns: list[str] | None = None
) -> DataFrame:
    """First non-null value per column, key and day, in the given unique order.

    An aggregate with map-side combine: a crowded day shrinks before the shuffle.
    """
    order = [order] if isinstance(order, str) else order
    columns = columns or [c for c in df.columns if c not in (*keys, date, *order)]
    place = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return (
        df.filter(F.col(date).isNotNull())
        .groupBy(*keys, date)
        .agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns])
    )


def fill_calendar(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Insert the days missing between a key's first and last, empty.

    Each row stands for the days up to the next row of its key, so the series is
    read once and joined with nothing.
    """
    ahead = F.lead(date).over(Window.partitionBy(*keys).orderBy(date))
    gap = F.coalesce(F.date_diff("_ahead", date), F.lit(1))
    offsets = F.when(gap > 1, F.sequence(F.lit(0), gap - 1)).otherwise(F.array(F.lit(0)))
    days = df.withColumn("_ahead", ahead).withColumn("_gap", F.explode(offsets)).drop("_ahead")
    empty = {c: F.when(F.col("_gap") == 0, F.col(c)) for c in df.columns if c not in (*keys, date)}
    return days.withColumns({**empty, date: F.date_add(date, F.col("_gap"))}).drop("_gap")


def align_to(df: DataFrame, reference: DataFrame, on: list[str]) -> DataFrame:
    """Bring ``df`` to the reference's (keys, dates); days it lacks are empty."""
    return reference.select(*on).distinct().join(df, on, "left")


def settle(
    df: DataFrame, keys: list[str], order: str, measures: list[str], labels: list[str], daily: bool = True
) -> DataFrame:
    """Interpolate the measures and fill the labels in one pass.

    Measures lie on a straight line between their neighbours by row position and
    take the nearest value at the ends; labels take the last value seen, else the
    next one to come. ``daily`` says that a key has one row a day; without it a
    key may be of any size and ``order`` only has to be unique in it.
    """
    if not measures and not labels:
        return df
    near = nearest_known(df, keys, order, [*measures, *labels], daily)
    out = {c: F.coalesce(F.col(f"{c}__prev.v"), F.col(f"{c}__next.v")) for c in labels}
    for c in measures:
        before, after = F.col(f"{c}__prev.v"), F.col(f"{c}__next.v")
        p, n = F.col(f"{c}__prev.p"), F.col(f"{c}__next.p")
        line = before + (after - before) * (F.col("_pos") - p) / F.nullif(n - p, F.lit(0))
        out[c] = F.coalesce(F.col(c), line, before, after)
    return near.withColumns(out).select(*df.columns)


def interpolate(df: DataFrame, keys: list[str], order: str, columns: list[str], daily: bool = True) -> DataFrame:
    return settle(df, keys, order, columns, [], daily)


def fill_forward_back(df: DataFrame, keys: list[str], order: str, columns: list[str], daily: bool = True) -> DataFrame:
    return settle(df, keys, order, [], columns, daily)


def fill_defaults(df: DataFrame, defaults: dict = vocab.MEASURE_DEFAULTS) -> DataFrame:
    return df.fillna({c: v for c, v in defaults.items() if c in df.columns})


def replace_sentinels(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing-value markers become NULL, in text columns every spelling of their number."""
    out = {}
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            continue
        if isinstance(f.dataType, T.NumericType):
            out[f.name] = F.when(~F.col(f.name).isin(vocab.SENTINELS), F.col(f.name))
        elif isinstance(f.dataType, T.StringType):
            number = exprs.to_number(F.trim(f.name))
            out[f.name] = F.when(~F.coalesce(number.isin(vocab.SENTINELS), F.lit(False)), F.col(f.name))
    return df.withColumns(out) if out else df


def head_per_key(df: DataFrame, keys: list[str], order: list, n, rank: str = "rn") -> DataFrame:
    return first_n(df, keys, order, n, rank)


def equalise_length(df: DataFrame, reference: DataFrame, keys: list[str], date: str) -> DataFrame:
    """As many days per key as the reference has: cut a longer series to its first
    days, bring a shorter one to the reference's dates (new days are empty).

    Both inputs have one row per key and day; each is read once.
    """
    values = [c for c in df.columns if c not in (*keys, date)]
    rows = df.select(*keys, date, F.struct(F.lit(1).alias("_"), *values).alias("_row")).unionByName(
        reference.select(*keys, date), allowMissingColumns=True
    )
    own = F.col("_row").isNotNull()
    by_key = Window.partitionBy(*keys)
    in_order = Window.partitionBy(*keys, own).orderBy(date)
    sized = rows.withColumns(
        {
            "_have": F.count_if(own).over(by_key),
            "_want": F.count_if(~own).over(by_key),
            "_rn": F.row_number().over(in_order),
            "_same": F.first("_row", True).over(Window.partitionBy(*keys, date)),
        }
    )
    enough = F.col("_have") >= F.col("_want")
    kept = sized.filter((own & enough & (F.col("_rn") <= F.col("_want"))) | (~own & ~enough))
    return kept.select(*[F.col(c) if c in (*keys, date) else F.col(f"_same.{c}").alias(c) for c in df.columns])


def clean_rows(
    df: DataFrame, keep: list[str], measures: list[str] = vocab.MEASURES, aliases: dict[str, str] = vocab.ALIASES
) -> DataFrame:
    """What cleaning does to each row alone: headers, sentinels, numbers, text.

    ``keep`` names the columns (keys, order) that hold no readings.
    """
    df = apply_aliases(plain_headers(df), aliases)
    df = replace_sentinels(df, [c for c in df.columns if c not in keep])
    out = {m: exprs.to_number(m) for m in measures if m in df.columns}
    out |= {c: exprs.normalise_text(c) for c in ("crop", "weather_condition") if c in df.columns}
    return df.withColumns(out) if out else df


def complete(
    df: DataFrame, keys: list[str], order: str, labels: list[str] | None = None, daily: bool = True,
    measures: list[str] = vocab.MEASURES, defaults: dict = vocab.MEASURE_DEFAULTS, skip: list[str] = (),
) -> DataFrame:
    """No empty measure: interpolation, fills and at last the defaults.

    ``labels`` (default: the remaining columns except ``result`` and ``skip``) are
    filled from the same key.
    """
    measures = [m for m in measures if m in df.columns]
    if labels is None:
        labels = [c for c in df.columns if c not in (*keys, order, *skip, *measures, "result")]
    return fill_defaults(settle(df, keys, order, measures, labels, daily), defaults)


def clean(
    df: DataFrame,
    keys: list[str],
    date: str = "date",
    order: str | list[str] | None = None,
    measures: list[str] = vocab.MEASURES,
    labels: list[str] | None = None,
    defaults: dict = vocab.MEASURE_DEFAULTS,
    aliases: dict[str, str] = vocab.ALIASES,
) -> DataFrame:
    """Headers, sentinels, aliases, numbers, days, gaps, defaults, text.

    One row per (keys, day) from the key's first to its last day and no empty
    measure. Only measures that are present are touched; ``labels`` (default:
    the remaining columns except ``result``) are filled from the same key;
    ``result`` is left as it is, empty on inserted days. Without a date column,
    ``order`` numbers the rows and nothing is inserted.
    """
    order = [order] if isinstance(order, str) else (order or [])
    df = clean_rows(df, [*keys, *order], measures, aliases)
    if date not in df.columns:
        return complete(df, keys, order[0], labels, False, measures, defaults, order)
    if not isinstance(df.schema[date].dataType, T.DateType):
        df = df.withColumn(date, exprs.leading_date(F.col(date).cast("string")))
    columns = [c for c in df.columns if c not in (*keys, date, *order)]
    df = fill_calendar(first_per_day(df, keys, date, order or columns, columns), keys, date)
    return complete(df, keys, date, labels, True, measures, defaults)
