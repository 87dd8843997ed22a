"""Exports and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import schema as S
from ..plans.storage import materialise, release
from . import local_files
from .selection import equality_filter

FILE_ROWS = 1_000_000  # of a file of season tables


def write_season(crop: DataFrame, weather: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """The two aligned tables, one folder per crop; the crops given are replaced, others stay.

    A crop has one file per FILE_ROWS rows, so there are hardly more files than crops.
    """
    S.require_same_schema(crop, weather)
    for name, df in (("crop_data", crop), ("weather_data", weather)):
        spark = df.sparkSession
        df = materialise(df)
        files = F.ceil(F.count(F.lit(1)) / FILE_ROWS).cast("int")
        large = materialise(df.groupBy(F.col("crop").alias("_crop")).agg(files.alias("_files")).filter("_files > 1"))
        part = F.pmod(F.xxhash64(*[f.name for f in df.schema.fields if f.name != "crop"]), F.coalesce("_files", F.lit(1)))
        # The number of tasks is given: AQE would merge by bytes what is costly by files.
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
        spread = df.join(large, F.col("crop").eqNullSafe(F.col("_crop")), "left").repartition(tasks, "crop", part).select(*df.columns)
        place = local_files.local_path(spark, f"{folder}/{name}") if fmt == "csv" else None
        if local_files.can_write(df, "crop", place):
            local_files.write_csv_by(spread, "crop", place, tasks)
            release(df, large)
            continue
        # Files move to a staging folder with each task's commit and to their place with the job's.
        writer = spread.write.mode("overwrite").options(partitionOverwriteMode="dynamic", **{"mapreduce.fileoutputcommitter.algorithm.version": 2})
        writer = writer.partitionBy("crop")
        (writer.options(header=True, escape='"') if fmt == "csv" else writer).format(fmt).save(f"{folder}/{name}")
        release(df, large)


def comparison_export(comparisons: DataFrame) -> DataFrame:
    """Comparisons under Title Case headers; nested parts as JSON text."""
    flat = comparisons.select(
        *[
            F.to_json(f.name).alias(f.name)
            if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
            else F.col(f.name)
            for f in comparisons.schema.fields
        ]
    )
    return S.title_headers(flat)


def matched_patterns(
    matches: DataFrame, queries: DataFrame, history: DataFrame, hist_id: str, query_id: str,
    measures: dict[str, str], date: str = "date", crop: str | None = None,
) -> DataFrame:
    """Best match of each query side by side; ``measures`` maps column -> short name."""
    best = matches.filter(F.col("rank") == 1).select(query_id, hist_id, "distance", F.col("similarity").alias("similarity_score"))
    label = F.lit(crop) if crop else F.col("crop") if "crop" in queries.columns else F.lit("Unknown")
    ahead = queries.select(
        query_id, F.col(date).alias("forecast_date"), label.alias("crop"),
        *[F.col(m).alias(f"forecast_{s}") for m, s in measures.items()],
    )
    back = history.select(
        hist_id, F.col(date).alias("matched_hist_date"),
        *[F.col(m).alias(f"matched_hist_{s}") for m, s in measures.items()],
    )
    pairs = best.join(ahead, [query_id]).join(back, [hist_id])
    return pairs.select(
        "forecast_date", "crop", *[f"forecast_{s}" for s in measures.values()],
        "matched_hist_date", *[f"matched_hist_{s}" for s in measures.values()],
        "distance", "similarity_score",
    )


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)
    return path


def export_similarity_results(comparisons: DataFrame, folder: str) -> str:
    return write_csv(comparison_export(comparisons), f"{folder}/similarity_results")


def export_matched_patterns(patterns: DataFrame, folder: str) -> str:
    return write_csv(S.title_headers(patterns), f"{folder}/matched_crop_patterns")


def export_future_predictions(predictions: DataFrame, folder: str) -> str:
    return write_csv(S.title_headers(predictions), f"{folder}/future_prediction_results")


def append_runs(runs: DataFrame, path: str) -> None:
    """Append run records; time and id are stamped unless given."""
    if "timestamp" not in runs.columns:
        runs = runs.withColumn("timestamp", F.current_timestamp())
    runs = runs.withColumn("_id", F.expr("uuid()")).withColumn("run_date", F.to_date("timestamp"))
    runs.write.mode("append").partitionBy("run_date").parquet(path)


def read_runs(spark: SparkSession, path: str, query: dict | None = None) -> DataFrame:
    return equality_filter(spark.read.parquet(path), query)
