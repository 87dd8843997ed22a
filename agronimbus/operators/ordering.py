"""Ordered operators that stay balanced when one key holds most rows.

A window over a key puts the whole key into one task. The operators here either
cut each group to a few rows before that happens, or number and accumulate over
range partitions, whose size does not depend on the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialise

SALTS = 32


def _columns(names) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def match_on(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner"):
    """Equi join on ``names`` that also pairs NULL with NULL; keeps left's keys.

    For small right sides only: the null-safe keys keep Spark from reusing a
    partitioning by ``names``. Elsewhere plain joins are used.
    """
    if not names:
        raise ValueError("a join needs at least one key")
    renamed = right.select(
        *[F.col(n).alias(f"__{n}") if n in names else F.col(n) for n in right.columns]
    )
    condition = F.lit(True)
    for n in names:
        condition = condition & left[n].eqNullSafe(renamed[f"__{n}"])
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__{n}" for n in names])


def first_n(
    df: DataFrame, keys: list[str], order: list, n, rank: str = "rank", salts: int = SALTS
) -> DataFrame:
    """The first ``n`` rows per key with their rank; ``n`` is a number or a column.

    Two steps: first n per (key, salt), then first n of what is left, so that a
    key's rows are sorted by many tasks. With a number, Spark also cuts to n
    before the shuffle (``WindowGroupLimit``).
    """
    limit = F.col(n) if isinstance(n, str) else F.lit(n) if isinstance(n, int) else n
    order = _columns(order)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    near = df.withColumn("_salt", salt)
    w = Window.partitionBy(*keys, "_salt").orderBy(*order)
    near = near.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= limit)
    w = Window.partitionBy(*keys).orderBy(*order)
    return (
        near.drop("_salt")
        .withColumn(rank, F.row_number().over(w))
        .filter(F.col(rank) <= limit)
    )


def in_blocks(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows range-partitioned by key and order, with the partition as ``_block``.

    Blocks follow the order and are cut by row counts, so a key of any size is
    spread over many. Written once: the boundaries come from a sample, and both
    the rows and the block totals must see the same ones.
    """
    ranged = df.repartitionByRange(*_columns(keys), *_columns(order))
    return materialise(ranged.withColumn("_block", F.spark_partition_id()))


def block_offsets(blocks: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """Per (key, block): weight in the key's earlier blocks, and the key's total."""
    per_block = blocks.groupBy(*keys, "_block").agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys)
    before = w.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select(
        *keys,
        "_block",
        F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_before"),
        F.sum("_w").over(w).alias("_total"),
    )


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list,
    weight,
    out: str = "running",
    total: str | None = None,
    block: str | None = None,
) -> DataFrame:
    """Running sum of ``weight`` per key in the given (unique) order.

    ``total`` and ``block`` name columns to keep: the key's sum, the row's block.
    """
    blocks = in_blocks(df, keys, order)
    weight = F.col(weight) if isinstance(weight, str) else weight
    w = (
        Window.partitionBy(*keys, "_block")
        .orderBy(*_columns(order))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    offsets = block_offsets(blocks, keys, weight)
    rows = blocks.withColumn("_here", F.sum(weight).over(w))
    joined = match_on(rows, offsets, [*keys, "_block"])
    joined = joined.withColumn(out, F.col("_before") + F.col("_here"))
    for name, kept in (("_total", total), ("_block", block)):
        joined = joined.withColumnRenamed(name, kept) if kept else joined
    return joined.drop("_block", "_here", "_before", "_total")


def number_rows(
    df: DataFrame, keys: list[str], order: list, out: str = "rn", total: str | None = None, block: str | None = None
) -> DataFrame:
    """``row_number`` per key for keys of any size; the order must be unique."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), out, total, block)


# Frames that grow with the row; a frame that shrinks towards the end of a key
# would be computed anew for every row.
GROWING = (Window.unboundedPreceding, Window.currentRow)


def _known(column: str) -> Column:
    return F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("v"), F.col("_pos").alias("p")))


def _both_ways(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    front = Window.partitionBy(*keys).orderBy(order).rowsBetween(*GROWING)
    back = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(*GROWING)
    out = {}
    for c in columns:
        out[f"{c}__prev"] = F.last(_known(c), True).over(front)
        out[f"{c}__next"] = F.last(_known(c), True).over(back)
    return df.withColumns(out)


def nearest_known(df: DataFrame, keys: list[str], order: str, columns: list[str], short: bool) -> DataFrame:
    """Per column the nearest known value up to and from each row on.

    Adds ``_pos`` (the row's position in its key) and, per column, ``__prev`` and
    ``__next``: the value ``v`` and its position ``p``. With ``short`` keys (one
    row a day) two windows do it. Otherwise the windows run within blocks, and
    what a block does not know comes from the blocks before and after it.
    """
    if short:
        by_key = Window.partitionBy(*keys).orderBy(order)
        return _both_ways(df.withColumn("_pos", F.row_number().over(by_key)), keys, order, columns)
    rows = materialise(number_rows(df, keys, [order], "_pos", block="_b"))
    ends = {}
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.col("_pos"))
        ends[f"{c}__last"], ends[f"{c}__first"] = F.max_by(_known(c), at), F.min_by(_known(c), at)
    per_block = rows.groupBy(*keys, "_b").agg(*[x.alias(n) for n, x in ends.items()])
    w = Window.partitionBy(*keys)
    earlier = w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    later = w.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        *keys,
        "_b",
        *[F.last(f"{c}__last", True).over(earlier).alias(f"{c}__in") for c in columns],
        *[F.last(f"{c}__first", True).over(later).alias(f"{c}__out") for c in columns],
    )
    both = match_on(_both_ways(rows, [*keys, "_b"], order, columns), carried, [*keys, "_b"])
    fill = {}
    for c in columns:
        fill[f"{c}__prev"] = F.coalesce(f"{c}__prev", f"{c}__in")
        fill[f"{c}__next"] = F.coalesce(f"{c}__next", f"{c}__out")
    return both.withColumns(fill).drop("_b", *[f"{c}__{s}" for c in columns for s in ("in", "out")])


def exact_median(df: DataFrame, keys: list[str], measures: list[str], accuracy: int = 10_000) -> DataFrame:
    """Exact medians per key, one row per key; null and NaN are not counted.

    A first pass takes, by a sketch of proven error (1 / ``accuracy`` of the ranks), two
    values with the median between them. A second pass counts what lies below and the
    equal values in between, some 6 / ``accuracy`` of the rows. Only those counts are put in
    order, over range partitions, and the middle is read off.
    """
    by, step = [*keys, "_measure"], 2 / accuracy
    pairs = [c for m in measures for c in (F.lit(m), F.col(m).cast("double"))]
    long = df.select(*keys, F.stack(F.lit(len(measures)), *pairs).alias("_measure", "_value"))
    known = long.filter(F.col("_value").isNotNull() & ~F.isnan("_value"))
    ends = F.percentile_approx("_value", [0.5 - step, 0.5 + step], accuracy)
    around = materialise(known.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"), ends.alias("_ends")))
    least, most = F.col("_ends")[0], F.col("_ends")[1]
    counts = (
        match_on(known, around, by)
        .filter(F.col("_value") <= most)
        .groupBy(*by, F.when(F.col("_value") >= least, F.col("_value")).alias("_value"))  # NULL: below, and first in order
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_all").alias("_all"))
    )
    run = running_total(counts, by, ["_value"], "_n", "_upto")
    low = F.floor((F.col("_all") - 1) / 2)
    high = F.floor(F.col("_all") / 2)
    covers = lambda pos: (F.col("_upto") - F.col("_n") <= pos) & (pos < F.col("_upto"))
    out = []
    for m in measures:
        mine = F.col("_measure") == m
        middle = F.max(F.when(mine & covers(low), F.col("_value"))) + F.max(F.when(mine & covers(high), F.col("_value")))
        lost = F.raise_error(F.lit(f"the median of {m} is not between the sketch's values"))
        out.append(F.when(middle.isNotNull() | ~F.coalesce(F.bool_or(mine), F.lit(False)), middle / 2.0).otherwise(lost).alias(m))
    return run.groupBy(*keys).agg(*out)
