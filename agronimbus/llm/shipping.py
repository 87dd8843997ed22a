"""The package's code for the executors, so that they need no installation."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to what Spark hands its Python workers, once per application.

    Workers then import the modules, and what a module keeps (a tokenizer, ids of
    words) lives as long as its worker.
    """
    context, package = spark.sparkContext, Path(__file__).resolve().parent.parent
    if getattr(context, "_agronimbus_shipped", False) or not package.is_dir():
        return
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="agronimbus-code-")), "agronimbus.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, f"{package.name}/{path.relative_to(package)}")
    context.addPyFile(archive)
    context._agronimbus_shipped = True
