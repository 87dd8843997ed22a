"""Quality classifier: a byte-level convolutional network in numpy.

Bytes get learned vectors; learned filters, each over eight bytes at a step of four,
run over chunks that cover the whole document, each half shared with the next. Every
chunk keeps the largest answer of each filter. The largest, mean and smallest over
the chunks are combined into one probability; the smallest tells a stretch in which
nothing new comes.

Training takes a bounded sample of labelled documents (see ``train``). Text null or
empty is scored as eight blanks. Labels null are left out, several labels of one
document count by their mean. Without labels of both kinds every score is the share
of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shipping import ship
from .text import in_parts

#: Numbers per byte, filters, bytes per step (a filter sees two), steps per half chunk.
VECTOR, FILTERS, STEP, HALF = 8, 48, 4, 24
BLANK = 32
#: Bytes that are convolved at a time, so that long texts need little memory.
SLAB = STEP * HALF * 1024
#: Chunks whose gradients are found at a time.
SLICE_CHUNKS = 256


@dataclass
class Network:
    """Weights; ``bias`` alone decides when ``filters`` is None."""

    vectors: np.ndarray | None = None  # 256 x VECTOR
    filters: np.ndarray | None = None  # (2 * STEP * VECTOR) x FILTERS
    offsets: np.ndarray | None = None  # FILTERS
    out: np.ndarray | None = None  # 3 * FILTERS
    bias: float = 0.0
    moments: dict = field(default_factory=dict)


def _steps(data: bytes) -> np.ndarray:
    """The bytes in whole steps, at least two; blanks fill the last."""
    a = np.frombuffer(data, dtype=np.uint8)
    size = max(2 * STEP, -(-len(a) // STEP) * STEP)
    return a if size == len(a) else np.concatenate([a, np.full(size - len(a), BLANK, np.uint8)])


def chunk_answers(net: Network, data: bytes) -> np.ndarray:
    """Chunks x filters: the largest answer of each filter in each chunk.

    Half chunks are HALF filter places, a chunk is two neighbours (the only one, if
    there is one); so the last half, which may be short, never stands alone.
    """
    steps = _steps(data)
    half = STEP * VECTOR
    both = np.concatenate([net.filters[:half], net.filters[half:]], axis=1)
    found = []
    for at in range(0, len(steps) - STEP, SLAB):
        part = steps[at : at + SLAB + STEP]
        y = np.take(net.vectors, part, axis=0).reshape(-1, half) @ both
        answers = y[:-1, :FILTERS] + y[1:, FILTERS:]
        found.append(np.maximum.reduceat(answers, np.arange(0, len(answers), HALF), axis=0))
    halves = np.concatenate(found)
    if len(halves) > 1:
        halves = np.maximum(halves[:-1], halves[1:])
    return np.maximum(halves + net.offsets, 0)


def features(answers: np.ndarray) -> np.ndarray:
    return np.concatenate([answers.max(axis=0), answers.mean(axis=0), answers.min(axis=0)])


def probability(net: Network, data: bytes) -> float:
    """Chance of label 1."""
    logit = net.bias
    if net.filters is not None:
        logit += float(features(chunk_answers(net, data)) @ net.out)
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def cut_chunks(text: str | None, most: int) -> np.ndarray:
    """Chunks x bytes of a text for training, at most ``most``, evenly spaced; zeros fill up."""
    data, width = _steps((text or "").encode("utf-8", "surrogatepass")), STEP * (2 * HALF + 1)
    last = max(len(data) - width, 0)
    starts = np.unique(np.append(np.arange(0, last + 1, STEP * HALF), last))
    if len(starts) > most:
        starts = starts[np.linspace(0, len(starts) - 1, most).astype(int)]
    padded = np.concatenate([data, np.zeros(max(width - len(data), 0), np.uint8)])
    return np.stack([padded[s : s + width] for s in starts])


def filled(chunks: np.ndarray) -> np.ndarray:
    """Chunks x places: whether a filter would look at filling."""
    return ~chunks.reshape(len(chunks), -1, STEP)[:, 1:].any(axis=2)


def gradients(net: Network, samples: list[np.ndarray], labels: np.ndarray, total: int) -> dict:
    """Sums of the gradients of some documents' log loss, each divided by ``total``."""
    half = STEP * VECTOR
    chunks = np.concatenate(samples)
    owner = np.repeat(np.arange(len(samples)), [len(x) for x in samples])
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    count = np.diff(np.r_[first, len(owner)])
    both = np.concatenate([net.filters[:half], net.filters[half:]], axis=1)
    y = (np.take(net.vectors, chunks.ravel(), axis=0).reshape(-1, half) @ both).reshape(len(chunks), -1, 2 * FILTERS)
    answers = y[:, :-1, :FILTERS] + y[:, 1:, FILTERS:]
    answers[filled(chunks)] = -1e9
    where = answers.argmax(axis=1)  # chunks x filters
    top = np.take_along_axis(answers, where[:, None], axis=1)[:, 0] + net.offsets
    kept = np.maximum(top, 0)
    most, least = np.maximum.reduceat(kept, first, axis=0), np.minimum.reduceat(kept, first, axis=0)
    seen_by = np.concatenate([most, np.add.reduceat(kept, first, axis=0) / count[:, None], least], axis=1)
    p = 1 / (1 + np.exp(-np.clip(seen_by @ net.out + net.bias, -30, 30)))
    error = ((p - labels) / total).astype(np.float32)
    back = error[:, None] * net.out
    g = back[owner, FILTERS : 2 * FILTERS] / count[owner, None]
    g += back[owner, :FILTERS] * (kept == most[owner]) + back[owner, 2 * FILTERS :] * (kept == least[owner])
    g *= top > 0
    # Only the places where a filter answered most take part.
    spans = (where[:, :, None] * STEP + np.arange(2 * STEP)).astype(np.int64)
    seen = np.take_along_axis(chunks[:, None, :], spans, axis=2)  # chunks x filters x 8
    values = net.vectors[seen].reshape(len(chunks), FILTERS, -1)
    spread = (g[:, :, None] * net.filters.T[None]).reshape(-1, VECTOR)
    return {
        "vectors": np.stack([np.bincount(seen.ravel(), weights=spread[:, j], minlength=256) for j in range(VECTOR)], axis=1),
        "filters": np.einsum("cf,cfk->kf", g, values),
        "offsets": g.sum(axis=0),
        "out": seen_by.T @ error,
        "bias": error.sum(),
    }


def slices(sizes: list[int], most: int = SLICE_CHUNKS) -> Iterator[slice]:
    """Runs of documents of at most ``most`` chunks together, or of one document."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if held:
        yield slice(begin, len(sizes))


def fit(samples: list[np.ndarray], labels: np.ndarray, steps: int = 600, batch: int = 64, seed: int = 7) -> Network:
    """Train on documents given as chunks x bytes (each chunk with its overlap).

    Batches hold as many documents of either label; Adam on the mean log loss. The
    gradients of a batch are added up over slices, so that memory stays small.
    """
    rng = np.random.default_rng(seed)
    half = STEP * VECTOR
    net = Network(
        rng.normal(0, 0.5, (256, VECTOR)).astype(np.float32),
        (rng.normal(0, 1, (2 * half, FILTERS)) / np.sqrt(2 * half) * 2).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32),
    )
    sides = [np.flatnonzero(labels == 0), np.flatnonzero(labels == 1)]
    state: dict[str, list] = {}
    for t in range(1, steps + 1):
        rows = np.concatenate([rng.choice(s, batch // 2) for s in sides])
        grads: dict = {}
        for part in slices([len(samples[i]) for i in rows]):
            for name, d in gradients(net, [samples[i] for i in rows[part]], labels[rows[part]], len(rows)).items():
                grads[name] = grads.get(name, 0.0) + d
        grads["filters"] += 1e-4 * net.filters
        grads["out"] += 1e-4 * net.out
        rate = 0.01 * min(1.0, 2 * (1 - t / (steps + 1)))
        for name, d in grads.items():
            m, v = state.get(name, [0.0, 0.0])
            m, v = 0.9 * m + 0.1 * d, 0.99 * v + 0.01 * d * d
            state[name] = [m, v]
            change = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            value = getattr(net, name) - change
            setattr(net, name, float(value) if name == "bias" else value.astype(np.float32))
    return net


def held_out(key: str = "doc_id", parts: int = 3, part: int = 1) -> Column:
    """Whether the key's CRC-32 falls into the part that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = 1_500, chunks: int = 32) -> Network:
    """Train on at most ``rows`` documents of either label and ``chunks`` chunks of each.

    ``docs`` (doc_id, text) and ``labels`` (doc_id, quality) must hold only what may be
    learned from. The sample is that with the smallest hashes of doc_id; of several rows
    of a doc_id the least text counts, however often it is there; of a document with more
    chunks, evenly spaced ones are taken. So the driver gets at most 2 x rows documents
    and 2 x rows x chunks x 196 bytes. Scores are set to the true share of label 1.
    """
    ship(docs.sparkSession)
    marked = labels.filter("quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    marked = marked.filter("doc_id is not null")
    totals = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("label").alias("n")).collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values())) if totals else 0.5
    if len(totals) < 2:
        return Network(bias=float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    chosen = None
    for label in (0, 1):
        part = marked.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [cut_chunks(x, chunks).tobytes() for x in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("label"), pa.array(out, pa.binary())], ["doc_id", "label", "chunks"])

    # At most 2 x rows keys, so the marked side is small whatever the corpus.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    table = found.mapInArrow(cut, "doc_id bigint, label int, chunks binary").toArrow().sort_by("doc_id")
    y = table.column("label").to_numpy()
    if len(set(y.tolist())) < 2:
        return Network(bias=float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    samples = [np.frombuffer(x, np.uint8).reshape(-1, STEP * (2 * HALF + 1)) for x in table.column("chunks").to_pylist()]
    del table
    net = fit(samples, y)
    net.bias += float(np.log(share / (1 - share)))
    return net


def score(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and score (0 to 1) of every document, from its whole text, without a shuffle."""
    ship(docs.sparkSession)
    kind = dict(docs.select(key).dtypes)[key]

    def scored(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [probability(net, (x or "").encode("utf-8", "surrogatepass")) for x in b.column(1).to_pylist()]
        return pa.record_batch([b.column(0), pa.array(found, pa.float64())], ["key", "score"])

    return docs.select(key, text).mapInArrow(in_parts(scored), f"key {kind}, score double").withColumnRenamed("key", key)


def learnable(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents and labels that may be learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.filter(~held_out()), labels.select("doc_id", "quality").filter(~held_out())


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(*learnable(spark, docs, sf_dir))
    return score(docs, net).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, net: Network, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns."""
    ship(docs.sparkSession)
    kinds = docs.schema

    def good(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(b.schema.get_field_index("text")).to_pylist()
        return b.filter(pa.array([probability(net, (x or "").encode("utf-8", "surrogatepass")) >= least for x in texts], pa.bool_()))

    return docs.mapInArrow(in_parts(good), kinds)


QUERY = ("op9_quality", quality_scores)
