"""Best-fit packing of documents into sequences of several permitted lengths.

Documents, longest first, go to the open bin with the least room that still holds
them. Where none does, a bin of the length is opened that costs least per token it
is likely to hold, given what is still to be packed. At the end every bin shrinks
to the shortest permitted length that holds its contents.

Documents longer than the longest length are cut into pieces of that length and a
rest. Nothing is dropped. Text null counts as empty (its end alone). Equal rows are
counted first and dealt out by copy, so that no shard grows with repeated rows.

``pack_documents`` packs whatever count it is given. The query and the pipeline give it
the ids of a tokenizer and the end id (``token_sizes``), so that a bin of 8192 holds 8192
ids, also of texts without blanks (zh, ja, th).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import materialise
from .shipping import ship
from .token_output import ENCODED_AT_ONCE, encode

#: Permitted sequence lengths, in the unit of the sizes.
LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Words whose ids a worker remembers: they stay while it lives, beside what other stages need.
MEMO_WORDS = 400_000


def token_sizes(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``n_tokens``: the ids of each whole text, the end id included.

    One row per row of ``docs``, whose other columns stay behind; null counts as empty.
    The ids are those that ``token_output`` writes. Texts are encoded where they are read.
    """
    ship(docs.sparkSession)
    read = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    kind = dict(docs.select(key).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, ENCODED_AT_ONCE) for i in range(0, whole.num_rows, ENCODED_AT_ONCE)):
                found = encode(b.column("text").to_pylist(), tokenizer_path, end_id, "<u4", MEMO_WORDS)
                yield pa.record_batch([b.column("key"), pa.array([len(x) // 4 for x in found], pa.int64())], ["key", "n_tokens"])

    return read.mapInArrow(run, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)


def attention_cost(length: int) -> float:
    """Cost of a sequence in tokens: its own, attention over them, and a fixed part."""
    return length + length * length / 32_768 + 32


def pack(
    sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = attention_cost
) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece, and each bin's final length.

    ``sizes`` are whole numbers between 1 and the longest length; ties are packed in
    the order given.
    """
    lengths = tuple(sorted(lengths))
    order = np.argsort(-sizes, kind="stable")
    # Tokens still to come of pieces up to each size: what could fill a bin's rest.
    coming = np.bincount(sizes, weights=sizes, minlength=lengths[-1] + 1)
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    place, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    # Sums of ``coming`` below each possible rest change with every piece; pieces come
    # in falling size, so what lies below a size is untouched until that size is met.
    below = np.concatenate([[0.0], np.cumsum(coming)])
    taken_here: dict[int, int] = {}
    for i in order:
        n = int(sizes[i])
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            left = below[n + 1] - taken_here.get(n, 0)
            best = None
            for c in lengths:
                if c >= n:
                    rest = c - n
                    fill = min(rest, below[rest + 1] if rest < n else left - n)
                    price = cost(c) / (n + max(fill, 0))
                    if best is None or price < best[0] - 1e-12:
                        best = (price, c)
            b, free = len(used), best[1]
            used.append(0)
        taken_here[n] = taken_here.get(n, 0) + n
        place[i], offset[i] = b, used[b]
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    return place, offset, [lengths[bisect_left(lengths, u)] for u in used]


def pack_documents(
    docs: DataFrame,
    key: str = "doc_id",
    size: str = "n_tokens",
    lengths: tuple[int, ...] = LENGTHS,
    cost: Callable[[int], float] = attention_cost,
    shard_docs: int = 4_096,
) -> DataFrame:
    """One row per piece: key, copy, piece, n_tokens, shard, bin, offset, length.

    ``docs`` has the key and a token count (null or below 1 counts as 1). Shards of
    about ``shard_docs`` documents, dealt by hash, are packed each by one task; only
    keys and counts travel. ``copy`` numbers rows that are equal.
    """
    ship(docs.sparkSession)
    longest = max(lengths)
    counted = docs.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size), F.lit(1)), F.lit(1)).cast("bigint").alias("n"))
    counted = materialise(counted.groupBy("key", "n").agg(F.count(F.lit(1)).alias("times")))
    rows = counted.agg(F.sum("times")).first()[0] or 0
    shards = max(1, -(-rows // shard_docs))
    dealt = counted.select("key", "n", F.explode(F.expr("sequence(1L, times)")).alias("copy"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("key", "copy"), F.lit(shards)).cast("int"))
    kind = dict(docs.select(key).dtypes)[key]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "descending"), ("key", "ascending"), ("copy", "ascending")])
        n = table.column("n").to_numpy()
        whole = n // longest
        pieces = whole + (n % longest > 0)
        doc = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        sizes = np.where(piece < whole[doc], longest, n[doc] % longest)
        bins, offsets, final = pack(sizes, lengths, cost)
        return pa.table(
            {
                "key": table.column("key").take(pa.array(doc)),
                "copy": table.column("copy").take(pa.array(doc)),
                "piece": pa.array(piece, pa.int64()),
                "n_tokens": pa.array(sizes, pa.int64()),
                "shard": table.column("shard").take(pa.array(doc)),
                "bin": pa.array(bins, pa.int64()),
                "offset": pa.array(offsets, pa.int64()),
                "length": pa.array([final[b] for b in bins], pa.int64()),
            }
        )

    packed = dealt.groupBy("shard").applyInArrow(
        run, f"key {kind}, copy bigint, piece bigint, n_tokens bigint, shard int, bin bigint, offset bigint, length bigint"
    )
    return packed.withColumnRenamed("key", key)


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(token_sizes(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2))


QUERY = ("op10_packing", packed_documents)
