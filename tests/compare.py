"""Run registered queries in Spark and DuckDB and compare the rows.

``python tests/compare.py FOLDER [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return str(v) if not isinstance(v, (int, str)) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark, con, folder, run, sql):
    """('' or a description, number of rows, Spark seconds)."""
    start = time.time()
    df = run(spark, folder)
    found = [tuple(x) for x in df.collect()]
    took = time.time() - start
    if sql is None:
        return "", len(found), took
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    wanted = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}", len(found), took
    a, b = rows_of(df.columns, found), rows_of(names, wanted)
    if a != b:
        return (
            f"{len(found)} and {len(wanted)} rows, {sum((a - b).values())} only in Spark "
            f"{list((a - b))[:2]}, {sum((b - a).values())} only in SQL {list((b - a))[:2]}",
            len(found), took,
        )
    return "", len(found), took


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(folder)
    bad = 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        try:
            wrong, n, took = differences(spark, con, folder, run, entry.oracle_sql().get(name))
        except Exception as e:  # report and go on with the next query
            wrong, n, took = f"{type(e).__name__}: {str(e)[:600]}", 0, 0.0
        bad += bool(wrong)
        print(f"{name:28} {n:8} rows {took:6.2f} s  {'same' if not wrong else 'DIFFERENT ' + wrong}", flush=True)
    print("different:", bad)
