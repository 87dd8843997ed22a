"""Crop names: resolving a request, the catalogue, hints in prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs, vocab
from ..plans.storage import materialise

TIERS = {1: "exact", 2: "synonym", 3: "partial"}


#: Letters of the pieces under which names are filed.
PIECE = 3


def _pieces(df: DataFrame, name: str, sizes: list) -> DataFrame:
    """Each name's digest as ``name`` with every distinct piece of one of the ``sizes`` as ``_piece``.

    Digests travel in place of names, so that rows grow with a name's length and not
    with its square. A size is a number or a column; size 0 gives the empty piece.
    """
    letters = F.split(name, "")

    def cut(size) -> Column:
        size = F.lit(size) if isinstance(size, int) else size
        last = F.length(name) - size + 1
        found = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(letters, i, size), ""))
        return F.when(last >= 1, found).otherwise(F.array().cast("array<string>"))

    pieces = F.array_distinct(F.flatten(F.array(*[cut(n) for n in sizes])))
    return df.select(F.md5(name).alias("_digest"), F.explode(pieces).alias("_piece")).withColumnRenamed("_digest", name)


def contained_names(short: DataFrame, needle: str, long: DataFrame, hay: str) -> DataFrame:
    """Pairs of distinct names of which ``hay`` contains ``needle``.

    An inverted index: each hay is filed under all its pieces of three letters, each
    needle asks only for that of its own pieces which the fewest hays have, and not at
    all where some piece is in none. What is found is verified on the names. Needles of
    less than three letters are one piece; hays are filed under such lengths only where
    they occur. Columns: ``needle`` and ``hay``.
    """
    few = short.select(F.length(needle).alias("n")).filter(F.col("n") < PIECE).distinct()
    sizes = [*sorted(r[0] for r in few.collect()), PIECE]  # four at most
    filed = materialise(_pieces(long, hay, sizes))
    held = filed.groupBy("_piece").agg(F.count(F.lit(1)).alias("_held"))
    asks = _pieces(short, needle, [F.least(F.length(needle), F.lit(PIECE))]).join(held, "_piece", "left")
    rarest = asks.groupBy(needle).agg(F.min(F.struct(F.coalesce("_held", F.lit(0)).alias("held"), "_piece")).alias("_least"))
    rarest = materialise(rarest.filter("_least.held > 0").select(needle, F.col("_least._piece").alias("_piece")))
    pairs = filed.join(rarest, "_piece").select(F.col(needle).alias("_a"), F.col(hay).alias("_b"))
    pairs = pairs.join(short.select(needle, F.md5(needle).alias("_a")), "_a")
    pairs = pairs.join(long.select(hay, F.md5(hay).alias("_b")), "_b")
    return pairs.filter(F.contains(hay, needle)).select(needle, hay)


def resolve_crop(
    requests: DataFrame,
    catalogue: DataFrame,
    requested: str = "requested",
    crop: str = "crop",
    position: str | None = None,
    synonyms: dict[str, str] = vocab.CROP_SYNONYMS,
    mode: str = "longest",
) -> DataFrame:
    """Requests with ``resolved`` crop and ``tier``: exact, synonym, partial, none.

    Tiers are tried in turn: only what neither the name nor a synonym resolves goes
    on to partial matches. One holds when either name contains the other; it is found
    by ``contained_names`` and not by comparing every request with every crop. Of
    several, ``mode="longest"`` takes the longest name, then the first in the alphabet;
    ``mode="first"`` the one with the smallest ``position``.
    """
    if mode not in ("longest", "first"):
        raise ValueError(f"mode is 'longest' or 'first', not {mode!r}")
    if mode == "first" and position is None:
        raise ValueError("mode 'first' needs a position column in the catalogue")
    place = F.min(position) if mode == "first" else F.lit(0)
    crops = catalogue.groupBy(exprs.normalise_text(crop).alias("_crop")).agg(
        place.cast("bigint").alias("_place")
    )
    crops = materialise(crops.filter(F.col("_crop").isNotNull()))
    asked = requests.select(exprs.normalise_text(requested).alias("_asked")).distinct()
    asked = materialise(asked.filter(F.col("_asked").isNotNull()))

    exact = asked.join(crops, F.col("_asked") == F.col("_crop")).withColumn("_tier", F.lit(1))
    pairs = [F.lit(x) for item in synonyms.items() for x in item]
    renamed = asked.withColumn("_other", F.try_element_at(F.create_map(*pairs), F.col("_asked")))
    synonym = (
        renamed.join(crops, F.col("_other") == F.col("_crop")).drop("_other").withColumn("_tier", F.lit(2))
    )
    known = exact.unionByName(synonym).select(F.col("_asked").alias("_known")).distinct()
    rest = materialise(asked.join(known, F.col("_asked") == F.col("_known"), "left_anti"))
    names = contained_names(rest, "_asked", crops, "_crop").unionByName(contained_names(crops, "_crop", rest, "_asked"))
    partial = names.join(crops, "_crop").withColumn("_tier", F.lit(3))

    # Best candidate per distinct request: an aggregate, combined map-side.
    size = F.lit(0) if mode == "first" else -F.length("_crop")
    best = F.min(F.struct("_tier", "_place", size.alias("_size"), "_crop"))
    both = exact.unionByName(synonym).unionByName(partial.select(*exact.columns))
    found = materialise(both.groupBy("_asked").agg(best.alias("_best")))
    tier = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for t in TIERS.items() for x in t]), F.col("_best._tier")),
        F.lit("none"),
    )
    return (
        requests.withColumn("_asked", exprs.normalise_text(requested)).join(found, ["_asked"], "left")
        .withColumns({"resolved": F.col("_best._crop"), "tier": tier})
        .drop("_asked", "_best")
    )


def crop_catalogue(history: DataFrame, crop: str = "crop", fixed: list[str] = vocab.CATALOGUE_CROPS):
    """Names in the data and on the fixed list, once each, sorted."""
    spark = history.sparkSession
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in fixed])).alias("crop"))
    known = history.select(exprs.capitalise(exprs.normalise_text(crop)).alias("crop"))
    return known.filter(F.col("crop").isNotNull()).distinct().union(listed).distinct().orderBy("crop")


def extract_hints(docs: DataFrame, text: str, unit: str = "days", degree: str = "°?C") -> DataFrame:
    """Season length and temperature named in each whole text; NULL where absent."""
    return docs.withColumns(
        {"duration_hint": exprs.duration_hint(text, unit), "temperature_hint": exprs.temperature_hint(text, degree)}
    )
