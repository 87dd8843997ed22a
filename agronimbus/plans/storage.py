"""Intermediate tables in the folder all executors share.

Every table of a session lies in a sub-folder named after its application. A table
that only its maker needs is dropped by ``release``; all others by ``cleanup``, once
the results that read them are written, and at the latest when the program ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folder of each application that wrote one -> how to reach its file system.
_written: dict[str, tuple] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting: it gets a temporary
    folder, remembered for the rest of the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.agronimbus.scratch", None
    )
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="agronimbus-")
    spark.conf.set("spark.agronimbus.scratch", folder)
    return folder


def new_folder(spark: SparkSession) -> str:
    """A folder of this session that does not exist yet."""
    own = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    _written[own] = (spark._jvm, spark._jsc.hadoopConfiguration())
    return f"{own}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so a lost executor repeats nothing before this point, and
    gives Spark the true size: a following join broadcasts the table only below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._agronimbus_path = path
    return kept


def release(*tables: DataFrame) -> None:
    """Drop tables of ``materialise`` that nothing will read any more."""
    for table in tables:
        _delete(getattr(table, "_agronimbus_path", None), table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration())


def cleanup(spark: SparkSession) -> None:
    """Drop all tables of the session. Results that still read them can't be used after."""
    own = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    if own in _written:
        _delete(own, *_written.pop(own))


def _delete(path: str | None, jvm, conf) -> None:
    if path:
        place = jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(conf)
        if fs.getUri().getScheme() == "file":  # Hadoop takes several times as long for very many files
            shutil.rmtree(fs.makeQualified(place).toUri().getPath(), ignore_errors=True)
        fs.delete(place, True)


@atexit.register
def _at_exit() -> None:
    for own, reach in list(_written.items()):
        try:
            _delete(own, *reach)
        except Exception:  # the JVM may have gone first; nothing can be done then
            return
