"""Folders of very many small CSV files, where tasks reach them as local files.

Hadoop's local file system starts a process (chmod) twice for each file that it makes, and
Spark's writer lets the driver move the folders of a partitioned table one by one. Its
file scan copies Hadoop's settings for each file, and its driver lists all files and finds
types for the values in all folders' names. Here Spark makes lines and takes them apart, and
Python workers make, move, list and read the files. What they would do in another way, and
other file systems (``local_path`` is None), is left to Spark's writer and reader.
"""

from __future__ import annotations

import codecs
import os
import re
import shutil
import sys
import uuid
from dataclasses import dataclass, field
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import materialise, release

# Tasks get the helpers below with their code, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Signs of a value that Spark writes as %XX in a folder's name, and its name for no value.
ESCAPED = frozenset(b"\"#%'*/:=?\\\x7f{[]^") | frozenset(range(1, 32))
NO_VALUE = b"__HIVE_DEFAULT_PARTITION__"
#: Types whose values are written and read alike by Spark's files and its functions for lines.
PLAIN = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
BLANK = bytes(range(33))  # a line of these is empty to Spark
BATCH_LINES, BATCH_BYTES = 10_000, 1 << 24
LARGEST = 1 << 29  # bytes of a file that one task reads
LOOKED = pa.schema(
    [("line", pa.binary()), ("keys", pa.list_(pa.string())), ("kinds", pa.list_(pa.string())), ("files", pa.int64()), ("total", pa.int64()), ("largest", pa.int64())]
)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The absolute path of ``path`` in the local file system; None, if it lies elsewhere."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(place).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def can_write(df: DataFrame, key: str, path: str | None) -> bool:
    """Whether ``write_csv_by`` would write what Spark's writer does.

    It must be given lines of several plain columns, and names that the JVM can read again.
    """
    kinds = [f.dataType for f in df.schema.fields if f.name != key]
    if path is None or key not in df.columns or len(kinds) < 2 or not all(isinstance(k, PLAIN) for k in kinds):
        return False
    if df.sparkSession._jvm.System.getProperty("sun.jnu.encoding") == "UTF-8":
        return True
    return path.isascii() and df.filter(F.col(key).cast("string").rlike(r"[^\x00-\x7F]")).isEmpty()


def folder_name(key: str, value: str | None) -> bytes:
    """Spark's name of the folder of a partition."""
    text = value.encode() if value else b""
    if not ESCAPED.isdisjoint(text):
        text = b"".join(b"%%%02X" % c if c in ESCAPED else bytes([c]) for c in text)
    return key.encode() + b"=" + (text or NO_VALUE)


def write_csv_by(df: DataFrame, key: str, path: str, tasks: int) -> None:
    """Write the rows of ``df`` as CSV files below ``path``, in one folder per value of ``key``.

    A task makes one file per value that it holds. Folders of the values given are replaced,
    others stay. Files are made in a staging folder, whose name readers pass over, and are
    moved by ``tasks`` tasks once all are made; only files of tasks that succeeded are moved,
    and a move may be repeated.
    """
    spark, job = df.sparkSession, uuid.uuid4().hex
    names = [c for c in df.columns if c != key]

    def line(cells):
        return F.concat(F.to_csv(F.struct(*cells), {"escape": '"'}), F.lit("\n"))

    header = spark.range(1).select(line([F.lit(c).alias(c) for c in names])).first()[0].encode()
    root = path.encode()
    at = f"{path}/.staging-{job}".encode()

    def make(batches):
        task = TaskContext.get()
        number = task.partitionId()
        own = b"%d-%d" % (number, task.taskAttemptId())
        name, out, last, made = f"part-{number:05d}-{job}.csv", None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs, lines = pc.run_end_encode(batch.column(0)), batch.column(1).cast(pa.large_binary())
            ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset :].tolist()
            text, start, new = memoryview(lines.buffers()[2]), 0, []
            for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                folder = folder_name(key, value)
                if folder != last:
                    if out is None:
                        os.makedirs(at + b"/" + own)
                    else:
                        out.close()
                    file = b"%s/%d" % (own, made)
                    out, last, made = open(at + b"/" + file, "wb"), folder, made + 1
                    out.write(header)
                    new.append((folder, file))
                out.write(text[ends[start] : ends[end]])
                start = end
            if new:
                yield pa.record_batch([*(pa.array(x, pa.binary()) for x in zip(*new, strict=True)), pa.array([name] * len(new))], ["folder", "file", "name"])
        if out is not None:
            out.close()

    def move(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for folder, files in groupby(rows, lambda r: r[0]):
            folder, new = root + b"/" + folder, {name.encode(): at + b"/" + file for _, file, name in files}
            try:
                os.mkdir(folder)
            except FileExistsError:
                for old in os.listdir(folder):
                    if old not in new:
                        _remove(folder + b"/" + old)
            for name, file in new.items():
                try:
                    os.rename(file, folder + b"/" + name)
                except FileNotFoundError:  # an earlier attempt of this task may have moved it
                    if not os.path.exists(folder + b"/" + name):
                        raise
        yield from ()

    os.makedirs(root, exist_ok=True)
    try:
        lines = df.select(F.col(key).cast("string").alias("_key"), line([F.col(f"`{c.replace('`', '``')}`") for c in names]).alias("_line"))
        made = materialise(lines.sortWithinPartitions("_key").mapInArrow(make, "folder binary, file binary, name string"))
        dealt = made.repartition(tasks, "folder").sortWithinPartitions("folder")
        dealt.mapInArrow(move, "n int").write.format("noop").mode("overwrite").save()
        release(made)
    finally:
        shutil.rmtree(at, ignore_errors=True)


@dataclass
class Folder:
    """What the CSV files below a local folder have in common (``header`` is None, if their
    first lines or the keys of their inner folders ``key=value`` differ)."""

    path: str
    names: list[bytes]
    header: str | None = None
    keys: list[str] = field(default_factory=list)
    kinds: list[set[str]] = field(default_factory=list)  # of the values of each key, see _kind
    files: int = 0
    bytes: int = 0
    largest: int = 0


def look(spark: SparkSession, path: str) -> Folder | None:
    """Files below a local folder, opened by Python workers; None, where only Spark can tell.

    Names that begin with ``_`` or ``.`` and files without a line are left out.
    """
    root, names = path.encode(), os.listdir(path.encode())
    seen = Folder(path, names)
    if not names:
        return seen

    def open_all(batches):
        found = {}
        for file, inner in _walk(root, batches):
            line = size = None
            usual = inner is not None and all(v and "%" not in k for k, v in inner)
            keys = tuple(k for k, _ in inner) if usual else None
            if file is not None:
                with open(file, "rb") as f:
                    line, size = _first_line(f), os.fstat(f.fileno()).st_size
                if line is None:
                    continue
            if (line, keys) not in found and len(found) == 3:
                break
            entry = found.setdefault((line, keys), [[set() for _ in keys or ()], 0, 0, 0])
            for kinds, (_, value) in zip(entry[0], inner if usual else (), strict=True):
                kinds.add(_kind(value))
            entry[1:] = entry[1] + 1, entry[2] + (size or 0), max(entry[3], size or 0)
        for (line, keys), (kinds, files, total, largest) in found.items():
            kinds = ["".join(sorted(k)) for k in kinds]
            yield pa.RecordBatch.from_pylist([dict(zip(LOOKED.names, (line, keys, kinds, files, total, largest), strict=True))], LOOKED)

    looked = _dealt(spark, names, 2 * spark.sparkContext.defaultParallelism)
    found = looked.mapInArrow(open_all, "line binary, keys array<string>, kinds array<string>, files bigint, total bigint, largest bigint").collect()
    if any(r.line is None for r in found):
        return None
    if len({(bytes(r.line), None if r.keys is None else tuple(r.keys)) for r in found}) == 1 and found[0].keys is not None:
        try:
            seen.header = bytes(found[0].line).decode()
        except UnicodeDecodeError:
            return None
        seen.keys = found[0].keys
        seen.kinds = [set().union(*(r.kinds[i] for r in found)) for i in range(len(seen.keys))]
        seen.files, seen.bytes, seen.largest = sum(r.files for r in found), sum(r.total for r in found), max(r.largest for r in found)
    return seen


def can_read(seen: Folder | None, names: list[str], known: dict[str, T.DataType]) -> bool:
    """Whether ``read_csv_by`` would give what Spark's reader does.

    There must be inner folders, whose values Spark would not take for other numbers or for
    times where they are asked for as text, and files that one task can read.
    """
    if seen is None or not seen.keys or not seen.header.strip() or seen.largest > LARGEST:
        return False
    every = [n.lower() for n in (*names, *seen.keys)]
    if len(set(every)) < len(every) or not all(isinstance(known.get(n), (*PLAIN, type(None))) for n in names):
        return False
    text = lambda kinds: "t" in kinds or "?" not in kinds
    return all(k not in known or known[k] == T.StringType() and text(kinds) for k, kinds in zip(seen.keys, seen.kinds, strict=True))


def read_csv_by(spark: SparkSession, seen: Folder, fields: list[T.StructField]) -> DataFrame:
    """The rows of the files of ``seen`` with the values of their inner folders as text.

    Python workers read lines, Spark takes them apart. A task has some 64 MB and 2,000
    files, however many of them lie in one folder.
    """
    root, n = seen.path.encode(), len(seen.keys)
    tasks = max(2 * spark.sparkContext.defaultParallelism, seen.bytes >> 26, seen.files // 2_000)

    def list_files(batches):
        found = _walk(root, batches)
        while some := list(islice(found, BATCH_LINES)):
            values = [[None if v == NO_VALUE.decode() else v for _, v in inner] for _, inner in some]
            yield pa.record_batch([pa.array([f for f, _ in some], pa.binary()), pa.array(values, pa.list_(pa.string()))], ["file", "of"])

    def read(batches):
        lines, values, counts, size = [], [], [], 0

        def batch():
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            columns = [pa.array([v[i] for v in values], pa.string()).take(rows) for i in range(n)]
            made = pa.record_batch([pa.array(lines, pa.binary()), *columns], ["line", *(f"k{i}" for i in range(n))])
            for kept in (lines, values, counts):
                kept.clear()
            return made

        for file, of in (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            with open(file, "rb") as f:
                header = True
                for some in _lines(f):
                    some = [x for x in some if x.strip(BLANK)]
                    if header and some:
                        del some[0]
                        header = False
                    lines += some
                    values.append(of)
                    counts.append(len(some))
                    size += sum(map(len, some))
                    if len(lines) >= BATCH_LINES or size >= BATCH_BYTES:
                        yield batch()
                        size = 0
        if lines:
            yield batch()

    kinds = ", ".join(["line binary", *(f"k{i} string" for i in range(n))])
    files = _dealt(spark, seen.names, 2 * spark.sparkContext.defaultParallelism).mapInArrow(list_files, "file binary, of array<string>")
    lines = files.repartition(tasks).mapInArrow(read, kinds)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)
    rows = lines.withColumn("row", F.from_csv(F.col("line").cast("string"), schema, {"escape": '"'}))
    cells = [F.col("row").getField(f.name).alias(f.name) for f in fields]
    return rows.select(*cells, *[F.col(f"k{i}").alias(k) for i, k in enumerate(seen.keys)])


def _dealt(spark: SparkSession, names: list[bytes], tasks: int) -> DataFrame:
    return spark.createDataFrame(pa.table({"name": pa.array(names, pa.binary())})).repartition(tasks)


def _walk(root: bytes, batches):
    """The files below entries of ``root`` with the (key, value) pairs of their inner folders.

    Pairs are None, if a folder has another name; the file is None, if only Spark can tell.
    """
    todo = [(root, name, ()) for batch in batches for name in batch.column(0).to_pylist()]
    while todo:
        folder, name, inner = todo.pop()
        at = folder + b"/" + name
        if name.startswith(b".") or name.startswith(b"_") and b"=" not in name and b"metadata" not in name:
            continue
        if os.path.isdir(at):
            pair = _pair(name) if b"=" in name[1:] and not name.startswith((b"_", b"=")) else None
            inner = None if inner is None or pair is None else (*inner, pair)
            todo += [(at, x, inner) for x in os.listdir(at)]
        else:
            yield at if name.endswith(b".csv") and not name.startswith(b"_") else None, inner


def _pair(name: bytes) -> tuple[str, str] | None:
    try:
        key, _, value = name.decode().partition("=")
    except UnicodeDecodeError:
        return None
    return key, re.sub("%([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), value)


def _kind(value: str) -> str:
    """n: a whole number as Spark prints it, t: a text that is no number or time to Spark."""
    if value == NO_VALUE.decode():
        return ""
    if re.fullmatch("0|-?[1-9][0-9]{0,17}", value, re.ASCII):
        return "n"
    bare = value.strip(BLANK.decode() + "+-").lower()
    if bare in ("", "nan", "inf", "infinity", "epoch", "now", "today", "tomorrow", "yesterday"):
        return "?"
    # Times begin with a sign, a digit or a T.
    return "t" if bare[0].isalpha() and bare[0] != "t" or not any(c.isdigit() for c in value) else "?"


def _first_line(f) -> bytes | None:
    """Up to the first line feed or carriage return; None, if there is nothing to read."""
    line = f.readline().removeprefix(codecs.BOM_UTF8)
    return line.splitlines()[0] if line else None


def _lines(f):
    """The lines of a file in lists, one for some megabytes."""
    rest = b""
    while chunk := f.read(1 << 22):
        whole, feed, rest = (rest + chunk).rpartition(b"\n")
        if feed:
            yield whole.splitlines()
    if rest:
        yield rest.splitlines()


def _remove(path: bytes) -> None:
    try:
        shutil.rmtree(path) if os.path.isdir(path) and not os.path.islink(path) else os.unlink(path)
    except FileNotFoundError:
        return
