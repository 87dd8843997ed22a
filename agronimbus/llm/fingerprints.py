"""Document fingerprints by a hash threshold that scales with the document.

A fingerprint keeps every five-word shingle hash below a fixed fraction of the
hash range, so its size follows the document's and the union of two fingerprints
is the fingerprint of both documents together. Shares of common hashes estimate
likeness and containment, also between a page and a book. A short document without a
hash below the fraction keeps its smallest one, so that it has a fingerprint too; that
hash is left out where a union is made or containment is asked for.

Text null counts as empty; a document without words has the empty fingerprint,
which is like (1.0) only other empty ones. Texts of fewer than five words are one
shingle. Only column expressions and joins, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import number_rows
from ..plans.storage import materialise

#: Share of the hash range that is kept.
FRACTION = 0.25
#: Bits of a hash, twelve hexadecimal digits.
BITS = 48
SHINGLE_WORDS = 5


def sketch(text: str, fraction: float = FRACTION, size: int = SHINGLE_WORDS) -> Column:
    """Sorted hashes below the fraction, and the smallest, of the text column's shingles."""
    words = f"split(btrim(lower(coalesce({text}, '')), ' \\t\\n\\u000B\\u000C\\r'), '[\\\\x20\\\\x09-\\\\x0D]+')"
    parts = ", ".join(f"get(w, i + {j})" for j in range(size))
    hashes = (
        f"transform({words_of(words)}, w -> transform(sequence(0, greatest(size(w) - {size}, 0)), "
        f"i -> shiftrightunsigned(xxhash64({parts}), {64 - BITS})))[0]"
    )
    kept = (
        f"transform(array({hashes}), h -> array_sort(array_distinct(concat("
        f"filter(h, x -> x < {int(fraction * (1 << BITS))}L), array(array_min(h))))))[0]"
    )
    return F.expr(f"if(btrim(coalesce({text}, ''), ' \\t\\n\\u000B\\u000C\\r') = '', cast(array() as array<bigint>), {kept})")


def words_of(words: str) -> str:
    """An array of the one word list, so that it is split once and bound to a name."""
    return f"array({words})"


def as_text(hashes: str) -> Column:
    """A sketch as twelve hexadecimal digits per hash."""
    return F.expr(f"array_join(transform({hashes}, h -> lpad(hex(h), {BITS // 4}, '0')), '')")


def below(hashes: str, fraction: float = FRACTION) -> str:
    """The hashes of a sketch below the fraction, that is without the smallest of a text that has none there."""
    return f"filter({hashes}, x -> x < {int(fraction * (1 << BITS))}L)"


def merged(a: str, b: str, fraction: float = FRACTION) -> Column:
    """The sketch of both documents together, just as ``sketch`` would make it of all their shingles."""
    both = f"array_union({a}, {b})"
    some = below(both, fraction)
    return F.expr(f"array_sort(if(size({both}) = 0 or size({some}) > 0, {some}, array(array_min({both}))))")


def likeness(a: str, b: str) -> Column:
    """Share of common hashes among all of both; 1 for two empty sketches."""
    common = f"size(array_intersect({a}, {b}))"
    return F.expr(f"if(size({a}) = 0 and size({b}) = 0, 1D, {common} / (size({a}) + size({b}) - {common}))")


def containment(a: str, b: str, fraction: float = FRACTION) -> Column:
    """Share of ``a``'s hashes below the fraction that ``b`` has too; 1 for an empty ``a``.

    Null for a text with words but no hash below the fraction: its sketch is one hash
    that a longer text, which has others below the fraction, does not keep.
    """
    some = below(a, fraction)
    return F.expr(f"if(size({a}) = 0, 1D, if(size({some}) = 0, null, size(array_intersect({some}, {b})) / size({some})))")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, tie, n_chars and for each document the next's and the previous one's keys.

    Next is by descending doc_id (null last), ties by a hash of the text, and after
    the last comes the first. Only keys are ordered, over range partitions; equal
    rows are one entry here and keep their number in the join that follows.
    """
    keys = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.length("text").cast("bigint").alias("n")).distinct()
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    placed = materialise(number_rows(keys, [], order, out="place", total="total"))
    at = placed.select(F.col("place").alias("_place"), F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie"), F.col("n").alias("_n"))
    after = F.col("place") % F.col("total") + 1
    before = (F.col("place") + F.col("total") - 2) % F.col("total") + 1
    forward = placed.join(at, after == F.col("_place")).select(
        "doc_id", "tie", "place", "total", F.col("_doc").alias("next_doc"), F.col("_tie").alias("next_tie")
    )
    return forward.join(at, before == F.col("_place")).select(
        "doc_id", "tie", "next_doc", "next_tie", F.col("_doc").alias("prior_doc"), F.col("_tie").alias("prior_tie"), F.col("_n").alias("prior_n")
    )


def _key(doc: str, tie: str) -> Column:
    """One joinable number for a nullable id and a hash."""
    return F.struct(F.coalesce(F.col(doc), F.lit(0)).alias("d"), F.col(doc).isNull().alias("o"), F.col(tie).alias("t"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text is the document without its last ``floor(n_chars / 3)`` code
    points, followed by as many first ones of the next document (see with_next).
    From the next document only that head and its sketch travel.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    near = with_next(docs).select(
        _key("doc_id", "tie").alias("near_k"), _key("prior_doc", "prior_tie").alias("prior_k"), "prior_n"
    )
    # Both joins read this with the same columns, so that texts are shuffled once.
    own = docs.withColumn("tie", F.xxhash64("text")).select(_key("doc_id", "tie").alias("k"), "text")
    heads = own.join(near, F.col("k") == F.col("near_k")).select(
        "prior_k",
        F.expr("substring(text, 1, cast(floor(prior_n / 3) as int))").alias("head"),
        sketch("text").alias("hashes"),
    )
    # Equal rows have equal heads; this shuffle by the prior document is also the join's.
    heads = heads.groupBy("prior_k").agg(F.first("head").alias("head"), F.first("hashes").alias("next_hashes"))
    both = own.join(heads, F.col("k") == F.col("prior_k")).select(
        F.expr("if(k.o, null, k.d)").alias("doc_id"),
        "text",
        F.length("text").cast("bigint").alias("n_chars"),
        F.expr("concat(substring(text, 1, length(text) - cast(floor(length(text) / 3) as int)), head)").alias("edited"),
        "next_hashes",
    )
    hashed = both.select("doc_id", "n_chars", "edited", "next_hashes", sketch("text").alias("hashes"))
    hashed = hashed.withColumn("edited_hashes", sketch("edited"))
    return hashed.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("hashes").alias("fingerprint"),
        as_text("edited_hashes").alias("edited_fingerprint"),
        likeness("hashes", "edited_hashes").alias("near_edited"),
        likeness("hashes", "next_hashes").alias("near_next"),
        containment("hashes", "edited_hashes").alias("contained_edited"),
        containment("hashes", "next_hashes").alias("contained_next"),
    )


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERY = ("op6_fingerprints", document_fingerprints)
