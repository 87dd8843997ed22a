"""Language identification in two levels.

A linear support vector machine per family picks the language family; inside it,
one-versus-one linear support vector machines, one for each pair, vote on the closely
related languages. Features are shares of byte pairs and triples of the lower-cased
letters, hashed into a fixed number of places.

Training takes a bounded sample of labelled documents (see ``train``), in which equal
rows count once. Text null or
without a letter is ``und`` with score 0. Without any labelled document everything is
``und``; with one language all others texts are that language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import first_n
from .quality import held_out
from .shipping import ship
from .text import in_parts

UNDETERMINED = "und"
#: Places that byte pairs and triples are hashed into.
PLACES = 1 << 14

# Families of languages by ISO 639-1 code. Others are families of one.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk ky",
    "iranian": "fa ku ps tg",
    "indic": "hi ur bn pa gu mr ne",
    "dravidian": "ta te kn ml",
    "semitic": "ar he am mt",
    "malayic": "id ms jv",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_BLANKED = bytes(c if chr(c).isalpha() or c >= 0x80 else 32 for c in range(256))


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.split("-")[0].lower(), lang)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def places(text: str) -> np.ndarray:
    """Place of every byte pair and triple of the text's letters, words set apart by blanks."""
    cleaned = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_BLANKED).split())
    a = np.frombuffer(b" " + cleaned + b" ", dtype=np.uint8).astype(np.uint32)
    pairs = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA77)
    triples = pairs[:-1] * np.uint32(0xC2B2AE3D) + a[2:] * np.uint32(0x27D4EB2F) + np.uint32(1)
    codes = np.concatenate([pairs, triples])
    codes ^= codes >> np.uint32(15)
    codes *= np.uint32(0x2C1B3C6D)
    return (codes >> np.uint32(18)).astype(np.int32)


@dataclass
class Model:
    """Hyperplanes, one column each, and what they part."""

    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)  # by family
    pairs: list[tuple[str, str, str]] = field(default_factory=list)  # family, first, second
    planes: np.ndarray | None = None  # PLACES x (families, then pairs)
    bias: np.ndarray | None = None


def separate(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear support vector machine, y in -1 and 1, by dual coordinate descent.

    Squared hinge loss; both sides weigh alike, however many rows they have. The
    bias is a further feature that is always 1.
    """
    kernel = x @ x.T + 1.0
    share = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    soft = 1 / (2 * cost * share)
    alpha, value = np.zeros(len(y)), np.zeros(len(y))
    order = np.random.default_rng(3)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            gradient = y[i] * value[i] - 1 + soft[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / (kernel[i, i] + soft[i]))
            if new != alpha[i]:
                value += (new - alpha[i]) * y[i] * kernel[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return (alpha * y).astype(x.dtype) @ x, float((alpha * y).sum())


def least_per_language(known: DataFrame, rows: int) -> DataFrame:
    """lang and tie of the ``rows`` least distinct ties of each language.

    Tasks hand on no more than that many of each language, each once, so copies of a
    row neither travel nor take the places of others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column("lang").dictionary_encode()
            codes, ties = langs.indices.to_numpy(), b.column("tie").to_numpy()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                held[lang] = np.unique(np.concatenate([held.get(lang, ties[:0]), ties[codes == code]]))[:rows]
        for lang, ties in held.items():
            yield pa.record_batch([pa.array([lang] * len(ties), pa.string()), pa.array(ties, pa.int64())], ["lang", "tie"])

    least = known.select("lang", "tie").mapInArrow(run, "lang string, tie bigint").distinct()
    return first_n(least, ["lang"], ["tie"], rows).select("lang", "tie")


def train(docs: DataFrame, rows: int = 300) -> Model:
    """Learn from at most ``rows`` documents of each language.

    ``docs`` (doc_id, text, lang) must hold only what may be learned from. The sample
    has the smallest hashes of doc_id and text of each language, whole texts, equal rows
    once. The driver gets the counted places of each, at most PLACES x 8 bytes a document.
    """
    ship(docs.sparkSession)
    known = docs.select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("tie"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    chosen = least_per_language(known, rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, share = [], []
            for text in b.column("text").to_pylist():
                n = np.bincount(places(text), minlength=PLACES)
                some = np.flatnonzero(n)
                at.append(some.astype(np.int32))
                share.append((n[some] / n.sum()).astype(np.float32))
            yield pa.record_batch(
                [b.column("lang"), b.column("tie"), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))],
                ["lang", "tie", "at", "share"],
            )

    # At most ``rows`` keys per language, so the chosen side is small whatever the corpus.
    sample = known.join(F.broadcast(chosen), ["lang", "tie"]).groupBy("lang", "tie").agg(F.min("text").alias("text"))
    table = sample.mapInArrow(count, "lang string, tie bigint, at array<int>, share array<float>").toArrow()
    table = table.sort_by([("lang", "ascending"), ("tie", "ascending")])
    langs = table.column("lang").to_pylist()
    if not langs:
        return Model()
    x = np.zeros((len(langs), PLACES), np.float32)
    for row, at, share in zip(x, table.column("at"), table.column("share")):
        row[at.values.to_numpy()] = share.values.to_numpy()
    del table
    # Rare places weigh as much as frequent ones; the scale goes into the planes.
    scale = 1 / (x.std(axis=0) + 1e-4)
    x *= scale
    norm = float(np.sqrt((x * x).sum(axis=1).mean()))
    x /= norm
    langs_at = np.array(langs)
    fams_at = np.array([family(v) for v in langs])
    model = Model(sorted(set(fams_at)))
    columns = []
    for f in model.families:
        model.languages[f] = sorted(set(langs_at[fams_at == f]))
        one = len(model.families) == 1
        columns.append((np.zeros(PLACES, np.float32), 1.0) if one else separate(x, np.where(fams_at == f, 1.0, -1.0)))
    for f in model.families:
        for i, a in enumerate(model.languages[f]):
            for b in model.languages[f][i + 1 :]:
                rows_here = (langs_at == a) | (langs_at == b)
                model.pairs.append((f, a, b))
                columns.append(separate(x[rows_here], np.where(langs_at[rows_here] == a, 1.0, -1.0)))
    model.planes = np.ascontiguousarray((np.stack([w for w, _ in columns], axis=1) * (scale / norm)[:, None]).astype(np.float32))
    model.bias = np.array([b for _, b in columns], np.float32)
    return model


def _sure(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(4 * margin, -30, 30))))


def predict(model: Model, text: str | None, slab: int = 1 << 18) -> tuple[str, float]:
    """Language and score (0 to 1) of a whole text."""
    if model.planes is None or not has_letter(text):
        return UNDETERMINED, 0.0
    at = places(text)
    if len(at) > PLACES // 4:
        total = np.bincount(at, minlength=PLACES).astype(np.float32) @ model.planes
    else:
        total = model.planes[at].sum(axis=0, dtype=np.float32)
    margin = total / len(at) + model.bias
    best = int(np.argmax(margin[: len(model.families)]))
    chosen = model.families[best]
    sure = 1.0 if len(model.families) == 1 else _sure(margin[best])
    votes = {v: [0, 0.0, 1.0] for v in model.languages[chosen]}
    for (f, a, b), m in zip(model.pairs, margin[len(model.families) :].tolist()):
        if f == chosen:
            won = a if m > 0 else b
            votes[won][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
            votes[a][2] = min(votes[a][2], _sure(m))
            votes[b][2] = min(votes[b][2], _sure(-m))
    lang = min(votes, key=lambda v: (-votes[v][0], -votes[v][1], v))
    return lang, sure * votes[lang][2]


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, lang_pred and score of every document, without a shuffle."""
    ship(docs.sparkSession)
    kind = dict(docs.select(key).dtypes)[key]

    def told(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [predict(model, x) for x in b.column(1).to_pylist()]
        return pa.record_batch(
            [b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
            ["key", "lang_pred", "score"],
        )

    return docs.select(key, text).mapInArrow(in_parts(told), f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language can be told, with all their columns.

    A null in ``lang`` becomes the language told; a language that is given stays.
    Without a trained model the rows are those with a letter, as they are.
    """
    ship(docs.sparkSession)

    def known(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(b.schema.get_field_index("text")).to_pylist()
        if model.planes is None:
            return b.filter(pa.array([has_letter(x) for x in texts], pa.bool_()))
        told = pa.array([predict(model, x)[0] for x in texts], pa.string())
        at = b.schema.get_field_index("lang")
        if at >= 0:
            b = b.set_column(at, b.schema.field(at), pc.coalesce(b.column(at), told.cast(b.schema.field(at).type)))
        return b.filter(pc.not_equal(told, UNDETERMINED))

    return docs.mapInArrow(in_parts(known), docs.schema)


QUERY = ("op1_language_id", document_languages)
