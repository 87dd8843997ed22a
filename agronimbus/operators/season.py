"""Season columns: temperature bounds, failure samples, padding, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..plans.storage import materialise
from .aggregates import group_means
from .ordering import first_n, number_rows


def derive_bounds(
    df: DataFrame, key: list[str], low: float = 2.0, high: float = 5.0, temp: str = "temp",
    names: tuple[str, str] = ("min_temp", "max_temp"),
) -> DataFrame:
    """Add missing temperature bounds, a distance from ``temp`` fixed by the key."""
    ways = {
        names[0]: F.col(temp) - exprs.spread(low, high, F.lit("min"), *key),
        names[1]: F.col(temp) + exprs.spread(low, high, F.lit("max"), *key),
    }
    ways = {n: x for n, x in ways.items() if n not in df.columns}
    return df.withColumns(ways) if ways else df


def failure_samples(
    df: DataFrame, by: list[str], temp: str = "temp", humidity: str = "humidity", rainfall: str = "rainfall"
) -> DataFrame:
    """Two unsuccessful rows per crop from its means: heat and drought, cold and flood."""
    means = group_means(df, by, [temp, humidity, rainfall])
    t, h, r = F.col(temp), F.col(humidity), F.col(rainfall)

    def row(shift, rain, hum):
        return F.struct(
            (t + shift).alias("temp"),
            (t + shift - 5.0).alias("min_temp"),
            (t + shift + 5.0).alias("max_temp"),
            rain.alias("rainfall"),
            hum.alias("humidity"),
            F.lit(0).alias("result"),
        )

    both = F.array(row(15.0, F.lit(0.0), h / 2.0), row(-15.0, r * 3.0, F.lit(98.0)))
    return means.select(*by, F.inline(both))


def augment_failures(df: DataFrame, by: list[str], date: str = "date", on: str = "2025-01-01") -> DataFrame:
    """History plus its failure samples. Use it after cleaning, so that no failure
    spreads over inserted days."""
    extra = failure_samples(df, by)
    if date in df.columns:
        extra = extra.withColumn(date, F.lit(on).cast(df.schema[date].dataType))
    return df.unionByName(extra, allowMissingColumns=True)


def pad_season(
    df: DataFrame, keys: list[str], order: list[str], duration, day: str = "season_day", last: int = 10
) -> DataFrame:
    """Exactly ``duration`` rows per key: the first rows in order, then the last
    ``last`` of them over and over. ``duration`` is a number or a column.

    A column's largest value is fetched first: cut to that number, a key leaves only
    so many rows per task before anything is shuffled.
    """
    length = F.lit(duration) if isinstance(duration, int) else F.col(duration)
    most = duration if isinstance(duration, int) else int(df.agg(F.max(length)).first()[0] or 0)
    head = materialise(first_n(df, keys, order, most, day).filter(F.col(day) <= length))
    sizes = head.groupBy(*keys).agg(F.max(day).alias("_n"), F.max(length).alias("_d"))
    short = sizes.filter(F.col("_n") < F.col("_d")).select(
        *keys, F.explode(F.sequence(F.col("_n") + 1, F.col("_d").cast("int"))).alias("_day"), "_n"
    )
    pool = F.least(F.lit(last), F.col("_n"))
    source = F.col("_n") - pool + 1 + F.pmod(F.col("_day") - F.col("_n") - 1, pool)
    wanted = short.select(*keys, "_day", source.cast("int").alias(day))
    pad = wanted.join(head, [*keys, day]).drop(day).withColumnRenamed("_day", day)
    return head.unionByName(pad)


def redate(
    df: DataFrame, keys: list[str], order: list[str], start, per_day: int = 1, date: str = "date"
) -> DataFrame:
    """Consecutive days from ``start`` in the given order, ``per_day`` rows a day.

    Rows are numbered over range partitions, so a key may be of any size.
    """
    first = F.lit(start).cast("date") if isinstance(start, str) else start
    step = F.floor((F.col("_rn") - 1) / per_day).cast("int")
    return number_rows(df, keys, order, "_rn").withColumn(date, F.date_add(first, step)).drop("_rn")


def season_day(df: DataFrame, keys: list[str], date: str = "date", out: str = "day") -> DataFrame:
    """Number the days of each key; ``df`` has one row per key and day."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(date)))
