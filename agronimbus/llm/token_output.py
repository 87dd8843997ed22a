"""Token ids as compressed blocks: one Zstandard frame per document, one shared dictionary.

Format, three Parquet tables in a folder, so that Spark's committer protects the
files against lost tasks and any store that Spark writes to will do:

* ``blocks``: shard, block, first_doc, last_doc, dictionary (hash), doc_ids, offsets
  (of the frames in the payload, one more than documents), counts (ids per document),
  before (ids of the shard before the block), payload (the frames);
* ``shards``: shard, first_doc, start (ids of all shards before), n_docs, n_tokens;
* ``dictionary``: hash (SHA-256), width (bytes per id), body.

Blocks hold ascending doc_id. To read one document, take the block by first and
last doc, slice one frame by the offsets and decompress that frame only.

Nulls: text null counts as empty; doc_id null sorts first. Repeated rows are all
kept, ordered by doc_id and a hash of the text. An empty table gives empty files.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import compress, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import new_folder
from .shipping import ship

#: Words whose ids a worker remembers, each of at most so many bytes; when full the later half goes.
MEMO_WORDS, MEMO_BYTES = 1_500_000, 64
#: Documents whose new words are encoded together.
ENCODED_AT_ONCE = 256
#: ASCII signs at a word's end that the tokenizer always parts from letters before them.
SIGNS = b".,;:!?*&%$#|\"()[]{}<>/-_+=@~^`"
_tokenizers: dict[str, tuple] = {}


class _Memo(dict):
    """Ids of words. A word asked for the first time is noted and gets an empty place to be filled."""

    def __init__(self):
        super().__init__()
        self.new, self.places, self.of = [], [], None

    def __missing__(self, word: bytes) -> bytearray:
        place = self[word] = bytearray()
        self.new.append(word)
        self.places.append(place)
        return place

    def thin(self, words: int) -> None:
        """Keep the words met first: frequent ones are met early."""
        kept = list(islice(self.items(), words))
        self.clear()
        self.update(kept)

    def forget(self) -> None:
        self.clear()
        self.new.clear()
        self.places.clear()


_memo = _Memo()


def _tokenizer(path: str) -> tuple:
    """The tokenizer; the same for words of plain letters; by id, whether the token ends a word.

    The second one leaves out the normal form, the lower case and the search for words,
    which plain letters, each word already parted by a blank, do not need.
    """
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers.clear()
        found = Tokenizer.from_file(path)
        last = np.zeros(found.get_vocab_size(), bool)
        last[[i for token, i in found.get_vocab().items() if token.endswith("</w>")]] = True
        form = json.loads(found.to_str())
        steps = form["pre_tokenizer"].get("pretokenizers", [form["pre_tokenizer"]])
        form["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *[x for x in steps if x["type"] != "Split"]]}
        form["normalizer"] = None
        _tokenizers[path] = (found, Tokenizer.from_str(json.dumps(form)), last)
    return _tokenizers[path]


def _encode_words(path: str, kind: str, found: list[bytes]) -> list[bytes]:
    encoded = _tokenizer(path)[0].encode_batch_fast([w.decode() for w in found], add_special_tokens=False)
    return [np.array(e.ids, kind).tobytes() for e in encoded]


def _encode_letters(path: str, kind: str, found: list[bytes], forms: list[str] | None = None, at_once: int = 4_000) -> list[bytes]:
    """Ids of words of plain letters: encoded as one text, cut after each word's last token.

    ``forms``: the words in normal form and lower case; None: as they are.
    """
    _, tokenizer, last = _tokenizer(path)
    width, out = np.dtype(kind).itemsize, []
    for i in range(0, len(found), at_once):
        part = found[i : i + at_once]
        text = b" ".join(part).decode() if forms is None else " ".join(forms[i : i + at_once])
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, kind)
        ends = (width * (np.flatnonzero(last[ids]) + 1)).tolist()
        if len(ends) == len(part):
            body = ids.tobytes()
            out += [body[a:b] for a, b in zip([0, *ends], ends)]
        else:  # a letter that becomes more than letters
            out += _encode_words(path, kind, part)
    return out


def _forms(found: list[bytes]) -> list[str | None]:
    """Of each word its normal form in lower case if that is nothing but letters."""
    whole = unicodedata.normalize("NFC", b" ".join(found).decode())
    # Capital sigma is the one letter whose lower case hangs on its place.
    words = whole.split(" ") if "\u03a3" in whole else whole.lower().split(" ")
    return [w if w.isalpha() and "\u03a3" not in w and not w.isascii() else None for w in words]


def _learn(path: str, kind: str, new: list[bytes]) -> dict[bytes, bytes]:
    """Ids of new words; letters and the signs that follow them are encoded apart."""
    plain, known = [w for w in new if w.isalpha() and w.islower()], _memo.get
    learned = dict.fromkeys(plain)
    rest = [w for w in new if w not in learned]
    cores = [w.rstrip(SIGNS) for w in rest]
    far = [c for c in dict.fromkeys(cores) if not c.isascii()]
    form = {c: f for c, f in zip(far, _forms(far)) if f}
    letters = [c.isalpha() and c.islower() or c in form for c in cores]
    parted, others = list(compress(rest, letters)), [w for w, x in zip(rest, letters) if not x]
    cores = list(compress(cores, letters))
    unmet = [c for c in dict.fromkeys(cores) if c not in learned and not known(c)]
    plain += [c for c in unmet if c not in form]
    learned.update(zip(plain, _encode_letters(path, kind, plain)))
    far = [c for c in unmet if c in form]
    learned.update(zip(far, _encode_letters(path, kind, far, [form[c] for c in far])))
    others += [x for x in {w[len(c) :] for w, c in zip(parted, cores)} if x and not known(x)]
    learned.update(zip(others, _encode_words(path, kind, others)))
    for w, core in zip(parted, cores):
        if len(w) > len(core):
            signs = w[len(core) :]
            learned[w] = (learned.get(core) or known(core)) + (learned.get(signs) or known(signs))
    return learned


def encode(texts: list[bytes | str | None], path: str, end_id: int, kind: str = "<u4", memo_words: int = MEMO_WORDS) -> list[bytes]:
    """Ids of each text and the end id, as unsigned numbers of the given kind.

    The tokenizer must split at white space, drop it and lower-case (as the word
    vocabularies do); each word is then looked up once and encoded once per worker, as
    long as a worker meets no more than ``memo_words``.
    """
    if _memo.of != (path, kind):
        _memo.forget()
        _memo.of = (path, kind)
    elif len(_memo) > memo_words:
        _memo.thin(memo_words // 2)
    end, rows = np.array([end_id], dtype=kind).tobytes(), []
    try:
        for text in texts:
            body = text.encode("utf-8") if isinstance(text, str) else text or b""
            # The names of special tokens, in <| and |>, are told by their case.
            rows.append(list(map(_memo.__getitem__, (body if b"<|" in body else body.lower()).split())))
        new = _memo.new
        if new:
            learned = _learn(path, kind, new)
            bodies = [learned[w] for w in new]
            for place, body in zip(_memo.places, bodies):
                place += body
        out = [b"".join(row) + end for row in rows]
        if new:
            _memo.update(zip(new, bodies))
            if max(map(len, new)) > MEMO_BYTES:
                for w in new:
                    if len(w) > MEMO_BYTES:
                        del _memo[w]
            new.clear()
            _memo.places.clear()
        return out
    except BaseException:
        _memo.forget()  # some places may be empty yet
        raise


def _sample(docs: DataFrame, path: str, end_id: int, kind: str, rows: int, ids: int) -> list[bytes]:
    """Serialised ids of at most ``rows`` documents, at most ``ids`` of each.

    The documents with the smallest hash of their id; all when there are no more.
    """
    total = docs.count()
    keep = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, rows / max(total, 1))) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A word has one id at least, so the first words hold the first ids.
            starts = [b" ".join((x or b"").split(None, ids)[:ids]) for x in b.column(0).to_pylist()]
            found = encode(starts, path, end_id, kind)
            yield pa.record_batch([pa.array([x[: ids * np.dtype(kind).itemsize] for x in found], pa.binary())], ["ids"])

    sampled = docs.filter(keep).select("text").limit(rows).mapInArrow(run, "ids binary")
    return [bytes(x) for x in sampled.toArrow().column(0).to_pylist()]


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A Zstandard dictionary; the samples themselves where they are too few to train."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _loaded(body: bytes):
    return zstandard.ZstdCompressionDict(body) if len(body) >= 8 else None


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int,
    *,
    dictionary_bytes: int = 65_536,
    sample_rows: int = 2_000,
    sample_ids: int = 2_048,
    block_docs: int = 1_024,
    block_bytes: int = 4 << 20,
    level: int = 3,
) -> None:
    """Write ``docs`` (doc_id, text) in the format above; see the module's notes.

    The dictionary is trained on the driver on at most ``sample_rows`` x
    ``sample_ids`` ids; everything else covers all rows. Texts are ordered first and
    encoded after, for the range shuffle looks at its input twice to find the ranges.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    width = 2 if _tokenizer(tokenizer_path)[0].get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    kind = f"<u{width}"
    body = train_dictionary(_sample(docs, tokenizer_path, end_id, kind, sample_rows, sample_ids), dictionary_bytes)
    digest = hashlib.sha256(body).hexdigest()
    spark.createDataFrame([(digest, width, bytearray(body))], "hash string, width int, body binary").write.parquet(
        f"{folder}/dictionary"
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, before, ids, counts, bodies = TaskContext.get().partitionId(), 0, 0, [], [], []

        def made() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in bodies])]).tolist()
            known = [x for x in ids if x is not None]
            row = {
                "shard": shard, "block": block, "first_doc": min(known, default=None), "last_doc": max(known, default=None),
                "dictionary": digest, "before": before, "doc_ids": ids, "offsets": offsets, "counts": counts, "payload": b"".join(bodies),
            }
            return pa.RecordBatch.from_pylist([row], schema=BLOCK_ARROW)

        packer, weight = zstandard.ZstdCompressor(level=level, dict_data=_loaded(body), write_dict_id=False), 0
        parts = (b.slice(i, ENCODED_AT_ONCE) for b in batches for i in range(0, b.num_rows, ENCODED_AT_ONCE))
        for b in parts:
            found = encode(b.column("text").to_pylist(), tokenizer_path, end_id, kind)
            for doc_id, encoded in zip(b.column("doc_id").to_pylist(), found):
                ids.append(doc_id)
                counts.append(len(encoded) // width)
                bodies.append(packer.compress(encoded))
                weight += len(bodies[-1])
                if len(ids) >= block_docs or weight >= block_bytes:
                    yield made()
                    block, before, ids, counts, bodies, weight = block + 1, before + sum(counts), [], [], [], 0
        if ids:
            yield made()

    ordered = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    written = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    shards = written.groupBy("shard").agg(
        F.min("first_doc").alias("first_doc"),
        F.sum(F.size("doc_ids")).cast("bigint").alias("n_docs"),
        F.sum(F.expr("aggregate(counts, 0L, (a, x) -> a + x)")).alias("n_tokens"),
    )
    # One row per shard: the only global order is over this short list.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0).cast("bigint"))).write.parquet(
        f"{folder}/shards"
    )


BLOCK_SCHEMA = (
    "shard int, block int, first_doc bigint, last_doc bigint, dictionary string, before bigint, "
    "doc_ids array<bigint>, offsets array<bigint>, counts array<bigint>, payload binary"
)
BLOCK_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
        ("dictionary", pa.string()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("offsets", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("payload", pa.binary()),
    ]
)


def read_tokens(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents of a token folder: doc_id, start, n_tokens, ids (unsigned 32-bit).

    With ``doc_ids`` only the blocks that can hold them are read (Parquet skips the
    others by first and last doc) and only their frames decompressed. Fails when a
    block names another dictionary than the folder has.
    """
    ship(spark)
    held = spark.read.parquet(f"{folder}/dictionary").toArrow().to_pylist()[0]
    digest, width, body = held["hash"], held["width"], bytes(held["body"])
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    if doc_ids is not None:
        within = [(F.col("first_doc") <= d) & (F.col("last_doc") >= d) for d in doc_ids]
        chosen = within[0] if within else F.lit(False)
        for w in within[1:]:
            chosen = chosen | w
        blocks = blocks.filter(chosen)
    shards = spark.read.parquet(f"{folder}/shards").select("shard", "start")
    wanted = None if doc_ids is None else set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor(dict_data=_loaded(body))
        for b in batches:
            for row in b.to_pylist():
                if row["dictionary"] != digest:
                    raise ValueError(f"block {row['shard']}/{row['block']} needs dictionary {row['dictionary']}")
                start, payload = row["start"] + row["before"], memoryview(row["payload"])
                out: tuple[list, list, list, list] = ([], [], [], [])
                for i, (doc_id, n) in enumerate(zip(row["doc_ids"], row["counts"])):
                    if wanted is None or doc_id in wanted:
                        ids = opener.decompress(payload[row["offsets"][i] : row["offsets"][i + 1]], max_output_size=n * width)
                        ids = ids if width == 4 else np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()
                        for column, value in zip(out, (doc_id, start, n, ids)):
                            column.append(value)
                    start += n
                yield pa.record_batch(
                    [*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    placed = blocks.join(shards, "shard")
    return placed.select("start", *[c for c in blocks.columns if c not in ("first_doc", "last_doc")]).mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    )


def token_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids, read them back and digest them."""
    import public_tokenizers

    folder = new_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    back = read_tokens(spark, folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERY = ("op5_token_output", token_documents)
