"""CSV readers with explicit schemas; no inference pass over the data."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs
from ..operators import schema as S
from ..operators.season import augment_failures, derive_bounds, redate
from ..operators.timeline import clean_rows
from . import local_files


def header_groups(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Header line -> files that have it, of a file, folder or glob; compressed ones too.

    Only names and first lines are read here, in threads, as Spark lists files on the
    driver too. Files without a line, and names beginning with ``_`` or ``.``, are left out.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    todo, files = list(fs.globStatus(place) or []), []
    if not todo:
        raise FileNotFoundError(path)
    while todo:
        status = todo.pop()
        inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        for x in inner:
            if not x.getPath().getName().startswith(("_", ".")) or x is status:
                (todo if x.isDirectory() else files).append(x)

    def first_line(status) -> tuple[str | None, str]:
        stream = fs.open(status.getPath())
        try:
            codec = codecs.getCodec(status.getPath())
            opened = codec.createInputStream(stream) if codec else stream
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(opened, "UTF-8"))
            return reader.readLine(), status.getPath().toString()
        finally:
            stream.close()

    groups: dict[str, list[str]] = {}
    with ThreadPoolExecutor(16) as pool:
        for line, name in sorted(pool.map(first_line, files), key=lambda x: x[1]):
            if line is not None:
                groups.setdefault(line.removeprefix("\ufeff"), []).append(name)
    return groups


def _one_folder(spark: SparkSession, path: str) -> str | None:
    """The folder that a path or glob stands for, if it is a folder and only one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return found[0].getPath().toString() if found and len(found) == 1 and found[0].isDirectory() else None


def _look(spark: SparkSession, path: str) -> tuple[str | None, local_files.Folder | None]:
    """The header of a folder whose files have all the same one and lie all in it or all in
    inner folders of the same names (crop=...); None, if that is not so. Of a local folder,
    also what else was seen.

    Found by tasks, which list and open the files, however many there are.
    """
    folder = _one_folder(spark, path)
    if folder is None:
        return None, None
    local = local_files.local_path(spark, folder)
    seen = local_files.look(spark, local) if local else None
    if seen is not None:
        return seen.header, seen
    root = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getRawPath().rstrip("/")
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", "_metadata.file_path", F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_block_start").alias("start")
    )
    first = lines.filter("start = 0").groupBy("file_path").agg(F.min_by("value", "at").alias("header"))
    inner = F.split(F.regexp_replace("file_path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/")
    inner = F.slice(inner, root.count("/") + 2, 1_000)
    folders = F.slice(inner, 1, F.size(inner) - 1)
    usual = F.forall(folders, lambda x: F.instr(x, "=") > 1) & ~F.exists(inner, lambda x: x.startswith("_") | x.startswith("."))
    keys = F.when(usual, F.transform(folders, lambda x: F.substring_index(x, "=", 1)))
    kinds = first.select("header", keys.alias("keys")).distinct().limit(2).collect()
    if len(kinds) != 1 or kinds[0].keys is None:
        return None, None
    return kinds[0].header.removeprefix("\ufeff"), None


def _only_header(spark: SparkSession, path: str) -> str | None:
    return _look(spark, path)[0]


def read_csv(spark: SparkSession, path: str, columns: T.StructType | None = None) -> DataFrame:
    """Rows under their header names, as text unless ``columns`` gives names and types.

    Files may have different headers: each distinct header is one scan of its files (of the
    folder, if there is but one), and the scans are united by name, a column that a file lacks being null. A header must be
    one line. Without any line there are no rows, and only ``columns`` names columns.
    """
    header, seen = _look(spark, path)
    groups = header_groups(spark, path) if header is None else {header: path}
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    options = {"header": True, "escape": '"'}
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    if len(found) == 1 and found[0].isDirectory():
        options["basePath"] = found[0].getPath().toString()  # columns that are in the names of inner folders
    out = None
    for header, files in groups.items():
        names = [n.strip() if columns is not None else n for n in next(csv.reader([header], escapechar=None))]
        known = {f.name: f.dataType for f in columns} if columns is not None else {}
        if len(set(names)) == len(names):
            fields = [T.StructField(n, known.get(n, T.StringType())) for n in names]
            if columns is not None and local_files.can_read(seen, names, known):
                part = local_files.read_csv_by(spark, seen, fields)
            else:
                part = spark.read.options(**options).schema(T.StructType(fields)).csv(files)
        else:  # Spark tells equal names apart by their places
            part = spark.read.options(**options).csv(files)
        if columns is not None:
            part = part.select(*[(F.col(f"`{n}`") if n in part.columns else F.lit(None)).cast(t).alias(n) for n, t in known.items()])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return spark.createDataFrame([], columns or T.StructType()) if out is None else out


def standardise_history(df: DataFrame, key: list[str], date: str = "date") -> DataFrame:
    """Any crop table in the history schema, with its ids.

    Absent bounds are derived, an absent result means success, absent dates run
    from 2025-01-01 with 24 rows a day in key order. ``soil_ph`` stays if present.
    """
    df = S.apply_aliases(S.plain_headers(df))
    numbers = [c for c in (*S.vocab.MEASURES, "result") if c in df.columns]
    df = df.withColumns({c: exprs.to_number(c) for c in numbers})
    df = df.withColumn("crop", exprs.normalise_text("crop"))
    df = derive_bounds(df, key)
    if date not in df.columns:
        df = redate(df, [], key, "2025-01-01", per_day=24, date=date)
    kept = [f for f in S.CROP_HISTORY.fields]
    if "soil_ph" in df.columns:
        kept.append(T.StructField("soil_ph", T.DoubleType()))
    kept = [T.StructField(c, df.schema[c].dataType) for c in key if c not in S.CROP_HISTORY.names] + kept
    return S.ensure_columns(df, T.StructType(kept), {"result": 1})


def read_history(spark: SparkSession, path: str, key: list[str], failures: bool = True) -> DataFrame:
    """History from a landed CSV, whichever of the known headers it has.

    Rows are cleaned one by one (sentinels, numbers, text) before the failure
    samples are made of the crops' means; empty readings stay empty.
    """
    df = standardise_history(clean_rows(read_csv(spark, path), key), key)
    return augment_failures(df, ["crop"]) if failures else df


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A predictions CSV under snake-case headers with typed columns."""
    df = S.snake_headers(read_csv(spark, path))
    numbers = [c for c in ("similarity_score", "success_probability", *S.vocab.FEATURES) if c in df.columns]
    df = df.withColumns({c: exprs.to_number(c) for c in numbers})
    return df.withColumn("date", exprs.leading_date("date")) if "date" in df.columns else df
