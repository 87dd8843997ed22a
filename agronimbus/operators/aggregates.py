"""Grouped summaries. Each is one partial and one final aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import half_even

DAILY = {"temp": "avg", "min_temp": "min", "max_temp": "max", "rainfall": "sum", "humidity": "avg"}


def daily_resample(df: DataFrame, keys: list[str], ts: str, aggs: dict = DAILY, date: str = "date"):
    """Readings to days; ``aggs`` maps output column -> function or (function, input)."""
    out = []
    for name, how in aggs.items():
        how, source = (how, name) if isinstance(how, str) else how
        out.append(getattr(F, how)(source).alias(name))
    return df.groupBy(*keys, F.to_date(ts).alias(date)).agg(*out)


def group_means(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in measures])


def distinct_counts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Exact number of distinct values per column.

    Values are made distinct under (key, value) before they are counted per key.
    """
    return df.groupBy(*keys).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def all_missing(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[(F.count(c) == 0).alias(f"{c}_missing") for c in columns])


def water_requirement(df: DataFrame, keys: list[str], duration: str, rainfall: str = "rainfall"):
    """Ten times the mean rainfall spread over the season, to two places."""
    need = F.avg(rainfall) * 10.0 / F.max(duration)
    return df.groupBy(*keys).agg(half_even(need).alias("water_requirement"))
