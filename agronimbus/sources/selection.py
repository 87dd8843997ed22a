"""Choosing between sources and topping one up from another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import first_n
from ..plans.storage import materialise


def quality_gate(df: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Per source: rows, and whether it is usable - more than one row and no
    measure missing throughout."""
    full = reduce(lambda a, b: a & b, [F.count(m) > 0 for m in measures])
    rows = F.count(F.lit(1))
    return df.groupBy(*by).agg(rows.alias("n_rows"), ((rows > 1) & full).alias("usable"))


def arbitrate(df: DataFrame, sites: list[str], priority: str, measures: list[str]) -> DataFrame:
    """Rows of each site's best usable source (smallest priority).

    The decision is an aggregate; its result, one row per site, is joined back.
    """
    gate = quality_gate(df, [*sites, priority], measures).filter("usable")
    chosen = materialise(gate.groupBy(*sites).agg(F.min(priority).alias(priority)))
    return df.join(chosen, [*sites, priority], "left_semi")


def top_up(primary: DataFrame, reserve: DataFrame, keys: list[str], date: str, days) -> DataFrame:
    """Primary rows, the reserve's rows for days the primary lacks, first ``days``.

    Both have one row per key and day; each is read once.
    """
    both = primary.withColumn("_first", F.lit(True)).unionByName(
        reserve.withColumn("_first", F.lit(False)), allowMissingColumns=True
    )
    held = F.max("_first").over(Window.partitionBy(*keys, date))
    wanted = both.withColumn("_held", held).filter(F.col("_first") | ~F.col("_held"))
    return first_n(wanted.drop("_first", "_held"), keys, [date], days, "rn").drop("rn")


def equality_filter(df: DataFrame, query: dict | None = None) -> DataFrame:
    """Rows equal to all given values (NULL equals NULL); an empty query is all rows."""
    tests: list[Column] = [F.col(k).eqNullSafe(F.lit(v)) for k, v in (query or {}).items()]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df
