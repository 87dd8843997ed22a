"""Language-model scores by a hidden Markov model over word classes.

States follow one another by a transition matrix and give out word classes: the most
frequent words are classes of their own, the others share classes by their last bytes.
Inside a class a word has its add-one share, and one place is left for unknown words.
As that share does not depend on the state, the likelihood of a text is the product of
the words' shares and the forward recursion over the classes, which is scaled and runs
over the whole text.

Word counts, class counts and the expected counts of Baum-Welch cover all training
rows: tasks sum them up for their rows and Spark over the tasks. The word table stays
distributed; texts meet the counts of their words in blocks of bounded size. The driver
holds the frequent words, the class totals and the matrices, all of fixed size.

Text null counts as empty: its only token is the end. Without training rows all counts
are 0 and a score is that of the untrained model. Repeated rows are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import materialise
from .quality import held_out
from .shipping import ship
from .text import words

#: States, words that are classes of their own, classes of all others.
STATES, FREQUENT, ENDINGS = 8, 1_000, 1_024
#: The end of a text as a word; no word has a blank.
END = b" "
#: Tokens per training segment; what fills up the last one; what marks, on its first
#: token, a segment that goes on from the one before, whose last token that is.
SEGMENT, NOTHING, CONTINUED = 64, 65_535, 1 << 15
#: Bytes of text per block that is scored at once.
BLOCK_BYTES = 6 << 20


def word_ids(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the index of each token's word, and tokens per text; with the ends."""
    index: dict[bytes, int] = {END: 0}
    at, lengths = [], np.empty(len(texts), np.int64)
    for k, text in enumerate(texts):
        found = words(text)
        found.append(END)
        lengths[k] = len(found)
        at.append(np.fromiter((index.setdefault(w, len(index)) for w in found), np.int64, len(found)))
    return list(index), np.concatenate(at) if at else np.empty(0, np.int64), lengths


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)).view(np.int64)


def endings(found: list[bytes]) -> np.ndarray:
    """Ending class of each word, after the frequent ones and the end."""
    return np.fromiter((FREQUENT + 1 + xxhash.xxh32_intdigest(w[-3:]) % ENDINGS for w in found), np.int64, len(found))


@dataclass
class Model:
    """``frequent``: hashes of words 0..; ``totals``/``kinds``: tokens and words per class."""

    frequent: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray
    tokens: int
    vocabulary: int
    start: np.ndarray | None = None
    moves: np.ndarray | None = None
    gives: np.ndarray | None = None  # states x classes

    def classes(self, found: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Class of each word; the end is class FREQUENT."""
        out = endings(found)
        if len(self.frequent):
            order = np.argsort(self.frequent, kind="stable")
            at = np.searchsorted(self.frequent[order], hashes)
            at[at == len(order)] = 0
            hit = self.frequent[order][at] == hashes
            out[hit] = order[at[hit]]
        for i, w in enumerate(found[:1]):
            if w == END:
                out[i] = FREQUENT
        return out

    def shares(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of each word's share of its class."""
        single = classes <= FREQUENT
        share = (counts + 1.0) / (self.totals[classes] + self.kinds[classes] + 1.0)
        return np.log10(np.where(single, 1.0, share))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, ending, c): how often each word, by its hash, occurs; ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, at, _ = word_ids(b.column("text").to_pylist())
            counts = np.bincount(at, minlength=len(found))
            kinds = endings(found)
            kinds[0] = FREQUENT
            yield pa.record_batch(
                [pa.array(word_hashes(found)), pa.array(kinds.astype(np.int32)), pa.array(counts.astype(np.int64))], ["word", "ending", "c"]
            ).filter(pa.array(counts > 0))

    rows = docs.select("text").mapInArrow(run, "word bigint, ending int, c bigint")
    return rows.groupBy("word").agg(F.first("ending").alias("ending"), F.sum("c").alias("c"))


def class_model(vocabulary: DataFrame) -> Model:
    """Frequent words and class totals of a word table."""
    others = vocabulary.filter(F.col("ending") != FREQUENT)
    often = others.orderBy(F.col("c").desc(), "word").limit(FREQUENT).select("word", "ending", "c").toArrow()
    totals, kinds = (np.zeros(FREQUENT + 1 + ENDINGS) for _ in range(2))
    sums = vocabulary.groupBy("ending").agg(F.sum("c").alias("c"), F.count("c").alias("k")).toArrow()
    for e, c, k in zip(*(sums.column(i).to_pylist() for i in range(3))):
        totals[e], kinds[e] = c, k
    tokens, words_known = int(totals.sum()), int(kinds.sum())
    for i, (e, c) in enumerate(zip(often.column("ending").to_pylist(), often.column("c").to_pylist())):
        totals[i], kinds[i] = c, 1
        totals[e] -= c
        kinds[e] -= 1
    return Model(often.column("word").to_numpy().copy(), totals, kinds, tokens, words_known)


def cut_segments(seq: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Texts laid end to end as segments that share one token, so that every move lies in just one."""
    step = SEGMENT - 1
    pieces = 1 + np.maximum(0, -(-(lengths - SEGMENT) // step))
    begin, before = np.cumsum(lengths) - lengths, np.cumsum(pieces) - pieces
    out = np.full((int(pieces.sum()), SEGMENT), NOTHING, "<u2")
    # A token's segment is the first that holds it ...
    place = np.arange(len(seq), dtype=np.int64) - np.repeat(begin, lengths)
    piece = np.maximum(place - 1, 0) // step
    out.ravel()[(np.repeat(before, lengths) + piece) * SEGMENT + place - piece * step] = seq
    # ... and the last token of a segment also the first of the next.
    ahead = np.arange(len(out)) - np.repeat(before, pieces)
    out[ahead > 0, 0] = out[np.flatnonzero(ahead > 0) - 1, step]
    out[ahead > 0, 0] |= CONTINUED
    return out


def class_segments(docs: DataFrame, model: Model) -> DataFrame:
    """Class sequences cut into segments: one row per batch, 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, at, lengths = word_ids(b.column("text").to_pylist())
            seq = model.classes(found, word_hashes(found))[at].astype("<u2")
            out = cut_segments(seq, lengths)
            for rows in np.array_split(out, max(1, -(-len(out) // 8_192))):
                yield pa.record_batch([pa.array([rows.tobytes()], pa.binary())], ["segments"])

    return docs.select("text").mapInArrow(run, "segments binary")


def long_run(moves: np.ndarray) -> np.ndarray:
    """Shares of the states after many moves."""
    return np.linalg.matrix_power(moves, 1 << 12).mean(axis=0)


def expected_counts(model: Model, obs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and gives of segments x places, and their log likelihood.

    A segment that goes on begins in the long run's shares of the states; its first
    token, the last of the segment before, counts neither as a start nor as given.
    """
    moves, start, gives = (np.ascontiguousarray(x, np.float32) for x in (model.moves, model.start, model.gives))
    lengths = (obs != NOTHING).sum(axis=1)
    order = np.argsort(-lengths, kind="stable")
    continued = (obs[order, 0] & CONTINUED) != 0
    if continued.any():
        obs = obs.copy()
        obs[:, 0] &= CONTINUED - 1
    begin = np.where(continued, long_run(model.moves).astype(np.float32)[:, None], start[:, None])
    # Longest first: the segments that reach a place are the first ones. States x segments per place.
    reach = np.searchsorted(-lengths[order], -np.arange(lengths.max()), side="left").tolist()
    symbols = [row[:n].astype(np.int64) for row, n in zip(np.ascontiguousarray(obs[order].T), reach)]
    seen = [gives.take(s, axis=1, mode="clip") for s in symbols]
    forward, loglik = [], 0.0
    for t, n in enumerate(reach):
        alpha = seen[t] * (moves.T @ forward[t - 1][:, :n] if t else begin)
        scale = alpha.sum(axis=0)
        alpha /= scale
        seen[t] /= scale
        forward.append(alpha)
        loglik += float(np.log(scale if t else scale[~continued]).sum(dtype=np.float64))
    # Where nothing follows, the future says nothing.
    beta = np.ones_like(forward[0])
    moved = np.zeros_like(model.moves)
    for t in range(len(reach) - 1, -1, -1):
        if t + 1 < len(reach):
            n = reach[t + 1]
            ahead = seen[t + 1] * beta[:, :n]
            moved += forward[t][:, :n] @ ahead.T
            beta[:, :n] = moves @ ahead
        forward[t] *= beta[:, : reach[t]]
    moved *= moves
    starts = forward[0][:, ~continued].sum(axis=1, dtype=np.float64)
    weights = np.concatenate(forward, axis=1)
    weights /= weights.sum(axis=0)
    weights[:, : len(continued)][:, continued] = 0
    every = np.concatenate(symbols)
    given = np.stack([np.bincount(every, w, gives.shape[1]) for w in weights])
    return starts, moved, given, loglik


def improved(model: Model, segments: DataFrame) -> Model:
    """One round of Baum-Welch over all rows of ``segments``."""
    k, c = model.gives.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for body in b.column(0):
                obs = np.frombuffer(body.as_buffer(), "<u2").reshape(-1, SEGMENT)
                for part in np.array_split(obs, max(1, -(-len(obs) // 2_048))):
                    if len(part):
                        found = np.concatenate([np.ravel(x) for x in expected_counts(model, part)[:3]])
                        total = found if total is None else total + found
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "value"])

    sums = segments.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(k + k * k + k * c)
    total[sums.column("at").to_numpy()] = sums.column("value").to_numpy()
    start, moves, gives = total[:k] + 1, total[k : k + k * k].reshape(k, k) + 1, total[k + k * k :].reshape(k, c)
    background = (model.totals + 0.5) / (model.totals + 0.5).sum()
    gives = gives + 50 * background
    return Model(
        model.frequent, model.totals, model.kinds, model.tokens, model.vocabulary,
        start / start.sum(), moves / moves.sum(axis=1, keepdims=True), gives / gives.sum(axis=1, keepdims=True),
    )


def untrained(model: Model, states: int = STATES, seed: int = 5) -> Model:
    """States that differ by chance and tend to stay."""
    rng = np.random.default_rng(seed)
    background = (model.totals + 0.5) / (model.totals + 0.5).sum()
    gives = background * np.exp(rng.normal(0, 1.0, (states, len(background))))
    model.start = np.full(states, 1 / states)
    model.moves = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(model.moves, 0.9)
    model.moves /= model.moves.sum(axis=1, keepdims=True)
    model.gives = gives / gives.sum(axis=1, keepdims=True)
    return model


def train(docs: DataFrame, warm_rounds: int = 8) -> tuple[Model, DataFrame]:
    """The model and its word table (word, c), learned from all ``docs`` (text).

    Each of the ``warm_rounds`` of Baum-Welch sees all segments, at every size.
    """
    ship(docs.sparkSession)
    vocabulary = materialise(count_words(docs))
    model = untrained(class_model(vocabulary))
    if model.tokens:
        segments = materialise(class_segments(docs, model))
        for _ in range(warm_rounds):
            model = improved(model, segments)
    return model, vocabulary


def forward_log10(model: Model, seq: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 likelihood of each class sequence (laid end to end) by the scaled forward recursion."""
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    running = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    gives = np.ascontiguousarray(model.gives.T)
    total = np.zeros(len(lengths))
    alpha = np.empty((0, len(model.start)))
    for t, active in enumerate(running.tolist()):
        seen = gives[seq[begin[:active] + t]]
        alpha = model.start * seen if t == 0 else (alpha[:active] @ model.moves) * seen
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:active] += np.log10(scale)
    out = np.empty(len(lengths))
    out[order] = total
    return out


def score(docs: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every document.

    Documents are dealt into blocks of about BLOCK_BYTES; each block asks the word
    table once for each of its words and is scored by one task. One shuffle of the
    texts serves both, the asking and the scoring.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // BLOCK_BYTES) + 1
    blocked = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def asked(table: pa.Table) -> pa.Table:
        found = word_ids(table.column("text").to_pylist())[0]
        return pa.table(
            {"block": pa.array(np.full(len(found), table.column("block")[0].as_py()), pa.int32()), "word": pa.array(word_hashes(found))}
        )

    def scored(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found, at, lengths = word_ids(left.column("text").to_pylist())
        hashes = word_hashes(found)
        known, times = right.column("word").to_numpy(), right.column("c").to_numpy()
        counts = np.zeros(len(found), np.int64)
        if len(known):
            order = np.argsort(known)
            place = np.minimum(np.searchsorted(known[order], hashes), len(known) - 1)
            hit = known[order][place] == hashes
            counts[hit] = times[order][place[hit]]
        classes = model.classes(found, hashes)
        ends = np.cumsum(lengths)

        def per_text(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values[at], ends - lengths) if len(lengths) else np.empty(0)

        base = np.log10((counts + 1) / (model.tokens + model.vocabulary + 1))
        whole = forward_log10(model, classes[at], lengths) + per_text(model.shares(classes, counts))
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "n_tokens": pa.array(lengths, pa.int64()),
                "n_known": pa.array(per_text((counts > 0).astype(np.int64)), pa.int64()),
                "base_score": pa.array(per_text(base), pa.float64()),
                "score": pa.array(whole, pa.float64()),
            }
        )

    questions = blocked.groupBy("block").applyInArrow(asked, "block int, word bigint")
    answers = questions.join(vocabulary.select("word", "c"), "word").select("block", "word", "c")
    return (
        blocked.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(scored, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    )


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = held_out("doc_id", 7, 2)
    model, vocabulary = train(docs.filter(~held))
    found = score(docs, model, vocabulary)
    return found.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )


QUERY = ("op3_hidden_markov", document_scores)
