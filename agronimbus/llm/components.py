"""Connected components of link tables of any size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.storage import materialise, release


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each (a, b) with the least of a and all its b; summed before the shuffle."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
    return pairs.join(least, F.col("a") == F.col("_a")).select("a", "b", "m")


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); component is its least node.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours, then its smaller ones, to the least node it knows. The number of
    rounds grows with the logarithm of the longest chain. Each round's links are
    written to the shared folder, so lineage stays short; nothing is collected.
    """
    links = materialise(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    )
    before = None
    for _ in range(rounds):
        pairs = _with_least(_both_ways(links))
        large = pairs.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        pairs = _with_least(large)
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            pairs.select("a", F.col("m").alias("b"))
        )
        # Counted while it is written, so a round is one job.
        seen, older = Observation(), links
        sums = F.count("a").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        links = materialise(small.filter("a <> b").distinct().observe(seen, *sums))
        release(older)
        state = seen.get
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def local_roots(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For 0..count-1, the least member of its component under the given links.

    Label passing with jumps, all links at once, so a few rounds do.
    """
    root = np.arange(count)
    while len(left):
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return root
