"""Mix sources to target weights by temperature.

Source token shares ``p`` are raised to an exponent and normalised; bisection finds
the exponent at which the mixture's entropy reaches a share of its maximum, or the
largest repetition of any source meets a limit. The weights then become budgets:
each source's stream is one hash permutation of its documents after another (a
pass), cut where its budget ends, and laid out in blocks of a fixed token budget
in each of which every source has its weight. With exponent 1 budgets are whole
numbers from whole numbers, so that without ``tokens`` every document comes once.

Only keys and counts are ordered, over range partitions, so a source may hold any
share of the rows. Text null counts as empty, source null is a source of its own;
every document counts its words and one end. Rows equal in doc_id, text and source
share an order value and stand or fall together at the end of a budget. An empty
table gives an empty mixture. Only column expressions, joins and windows, no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import running_total
from ..plans.storage import materialise

#: Bisection levels that one job evaluates (all their midpoints at once), and jobs.
LEVELS, JOBS = 6, 4


@dataclass(frozen=True)
class Target:
    """What the mixture shall meet; tokens None: as many as the corpus has.

    entropy: share of the largest entropy possible (all sources alike).
    repeats: no source is passed through more often than this.
    """

    entropy: float | None = 0.95
    repeats: float | None = 4.0
    tokens: int | None = None
    block_tokens: int = 1 << 20
    seed: int = 0


def words_and_end(text: str = "text") -> Column:
    """Number of white-space separated words, and one."""
    blank = "' \\t\\n\\u000B\\u000C\\r'"
    return F.expr(
        f"cast(if(btrim(coalesce({text}, ''), {blank}) = '', 0, "
        f"size(split(btrim({text}, {blank}), '[\\\\x20\\\\x09-\\\\x0D]+'))) + 1 as bigint)"
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with ``_source`` (never null) and ``_tie`` (hash of what tells rows apart)."""
    source = F.col("source").cast("string")
    return docs.withColumns(
        {
            "_source": F.coalesce(F.concat(F.lit("s"), source), F.lit("n")),
            "_tie": F.xxhash64(F.col("doc_id"), F.col("text")),
        }
    )


def _order(target: Target, number: Column) -> Column:
    """The place of a document in the permutation of a pass."""
    return F.xxhash64(F.col("_tie"), F.lit(target.seed), number)


def exponent(sources: DataFrame, total: int, budget: float, target: Target) -> float:
    """The exponent in 0..1: 1 keeps the shares, 0 makes all alike.

    The largest one that reaches the entropy, raised where needed to the least one
    that meets the repetition limit. Both sides are monotone in the exponent. Each
    job sums over the sources once for all midpoints of six bisection levels.
    """
    count = sources.count()

    def probe(points: list[float]) -> list[tuple[float, float]]:
        at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a")) for i, a in enumerate(points)])).alias("at")
        p = (F.col("tokens") / F.lit(float(total))).alias("p")
        rows = sources.select(p, "tokens", at).select("p", "tokens", "at.i", "at.a")
        power = F.pow("p", "a")
        sums = rows.groupBy("i").agg(
            F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("l"), F.max(power / F.col("tokens")).alias("m")
        )
        by = {r["i"]: r for r in sums.collect()}
        return [
            (math.log(by[i]["z"]) - a * by[i]["l"] / by[i]["z"], budget * by[i]["m"] / by[i]["z"]) for i, a in enumerate(points)
        ]

    def bisect(holds) -> tuple[float, float]:
        """The interval at whose left end ``holds`` is true and at whose right end it is not."""
        low, high = 0.0, 1.0
        for _ in range(JOBS):
            step = (high - low) / (1 << LEVELS)
            points = [low + step * i for i in range(1, 1 << LEVELS)]
            last = low
            for a, found in zip(points, probe(points)):
                if not holds(found):
                    high = a
                    break
                last = a
            low = last
        return low, high

    if not count:
        return 1.0
    (_, _), (h1, r1) = probe([0.0, 1.0])
    slack = 1e-9
    least, found = target.entropy, 1.0
    if least is not None and h1 < least * math.log(count) - slack:
        found = bisect(lambda x: x[0] >= least * math.log(count) - slack)[0]
    most = target.repeats
    if most is not None and r1 <= most and probe([found])[0][1] > most:
        found = max(found, bisect(lambda x: x[1] > most)[1])
    return found


def source_budgets(docs: DataFrame, target: Target) -> DataFrame:
    """_source, tokens, weight, budget, passes (whole ones), rest (tokens of the last)."""
    sized = docs.groupBy("_source").agg(F.sum("_n").alias("tokens"))
    sources = materialise(sized)
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = float(target.tokens if target.tokens is not None else total)
    if target.repeats is not None:
        budget = min(budget, target.repeats * total)
    a = exponent(sources, total, budget, target)
    power = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(a))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    weighed = sources.withColumn("weight", F.round(power / F.lit(z), 12))
    if a == 1.0:  # the shares as they are, without rounding
        weighed = weighed.withColumn("budget", F.expr(f"cast(tokens as decimal(19, 0)) * cast({int(budget)} as decimal(19, 0)) div {max(total, 1)}"))
    else:
        wanted = power / F.lit(z) * F.lit(budget)
        # What doubles lose must not take the last token of a whole pass.
        weighed = weighed.withColumn("budget", F.floor(wanted * F.lit(1 + 1e-12)).cast("bigint"))
    return materialise(
        weighed.withColumn("passes", F.floor(F.col("budget") / F.col("tokens")).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))
        .withColumn("exponent", F.lit(a))
    )


def _plan(docs: DataFrame, target: Target) -> tuple[DataFrame, DataFrame]:
    """Budgets, and one row per document and pass: place in its source's stream."""
    sized = materialise(
        _keyed(docs.select("doc_id", "text", "source")).select(
            "doc_id", F.col("source").cast("string").alias("source"), "_source", "_tie", words_and_end().alias("_n")
        )
    )
    budgets = source_budgets(sized, target)
    taken = sized.join(budgets, "_source").select(
        "doc_id", "source", "_source", "_tie", "_n", "tokens", "weight", "passes", "rest",
        F.explode(F.expr("sequence(0, if(rest > 0, passes, passes - 1))")).alias("pass"),
    ).filter("passes > 0 or rest > 0")
    taken = taken.withColumn("_order", _order(target, F.col("pass")))
    placed = running_total(taken, ["_source", "pass"], ["_order", "_tie"], "_n", "_through")
    # Rows that share an order value end where the last of them ends.
    whole = placed.filter("pass < passes")
    last = placed.filter("pass = passes")
    ends = last.groupBy("_source", "_order").agg(F.max("_through").alias("_end"))
    last = last.join(ends.withColumnsRenamed({"_source": "_s", "_order": "_o"}), (F.col("_source") == F.col("_s")) & (F.col("_order") == F.col("_o")))
    last = last.filter(F.col("_end") <= F.col("rest")).drop("_s", "_o", "_end")
    return budgets, whole.unionByName(last)


def mix_schedule(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """One row per document and pass of the mixture: where it comes in the training order.

    doc_id, source, pass, block (each has its token budget split by the weights), place
    (order inside the block), n_tokens, weight.
    """
    _, placed = _plan(docs, target)
    before = F.col("pass") * F.col("tokens") + F.col("_through") - F.col("_n")
    share = F.greatest(F.col("weight") * F.lit(float(target.block_tokens)), F.lit(1.0))
    return placed.select(
        "doc_id",
        "source",
        "pass",
        F.floor(before / share).cast("bigint").alias("block"),
        F.xxhash64("_order", "_source").alias("place"),
        F.col("_n").alias("n_tokens"),
        "weight",
    )


def mix_documents(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """The documents of the mixture, one row per pass, with the columns of ``docs``.

    The plan is made from keys; of it only the order value at which each source's
    last pass ends goes to the documents, so that texts are not shuffled.
    """
    budgets, placed = _plan(docs, target)
    cut = placed.filter("pass = passes").groupBy("_source").agg(F.max("_order").alias("_cut"))
    limits = materialise(
        budgets.select("_source", "passes").join(cut, "_source", "left").select(F.col("_source").alias("_s"), "passes", "_cut")
    )
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = _keyed(docs.select(whole_row, "doc_id", "text", "source")).select("row", "_source", "_tie")
    rows = rows.join(limits, F.col("_source") == F.col("_s"))
    extra = F.coalesce((_order(target, F.col("passes")) <= F.col("_cut")).cast("int"), F.lit(0))
    times = F.expr("filter(sequence(0, _times), i -> i > 0)")
    return rows.withColumn("_times", F.col("passes") + extra).select("row", F.explode(times)).select("row.*")


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_schedule(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERY = ("op8_mixing", mixed_documents)
