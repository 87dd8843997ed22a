"""The driver's tables read as weather and crop tables, in Spark and in SQL.

Every view covers its whole table. SQL text is DuckDB's dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ["temp", "rainfall", "humidity"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- crop history from parts -------------------------------------------------

def history(spark, folder) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("hist_id"),
        F.lower("p_type").alias("crop"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("date"),
        F.col("p_size").cast("double").alias("temp"),
        F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("double").alias("rainfall"),
        ((F.col("p_retailprice") - 900) * 0.9).alias("humidity"),
        F.col("p_size").between(10, 40).cast("int").alias("result"),
    )


HISTORY = """
SELECT p_partkey AS hist_id, lower(p_type) AS crop, DATE '2024-01-01' + p_size AS date,
       CAST(p_size AS DOUBLE) AS temp,
       CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS rainfall,
       (p_retailprice - 900) * CAST(0.9 AS DOUBLE) AS humidity,
       CASE WHEN p_size BETWEEN 10 AND 40 THEN 1 ELSE 0 END AS result
FROM part"""


# --- sensor readings from events: error events read -999 ----------------------

def readings(spark, folder) -> DataFrame:
    events = table(spark, folder, "events")
    return events.select(
        F.col("event_id"),
        F.col("user_id").alias("site_id"),
        "ts",
        F.to_date("ts").alias("date"),
        F.col("event_type").alias("source"),
        F.when(F.col("event_type") == "error", -999.0).otherwise(F.col("value")).alias("temp"),
        F.get_json_object("props", "$.k").alias("humidity"),
    )


READINGS = """
SELECT event_id, user_id AS site_id, ts, CAST(ts AS DATE) AS date, event_type AS source,
       CASE WHEN event_type = 'error' THEN -999.0::DOUBLE ELSE value END AS temp,
       json_extract_string(props, '$.k') AS humidity
FROM events"""

# The same with sentinels removed: NULL where the sensor failed.
GOOD_READINGS = f"""
SELECT * REPLACE (CASE WHEN temp = -999 THEN NULL ELSE temp END AS temp,
                  CAST(humidity AS DOUBLE) AS humidity) FROM ({READINGS})"""


# --- daily forecast per site from events --------------------------------------

def forecast(spark, folder) -> DataFrame:
    from ..operators.aggregates import daily_resample

    events = table(spark, folder, "events").select(
        F.col("user_id").alias("site_id"),
        "ts",
        F.col("value").alias("temp"),
        (F.col("value") / 20.0).alias("rainfall"),
        F.get_json_object("props", "$.k").cast("double").alias("humidity"),
    )
    how = {
        "temp": "avg", "min_temp": ("min", "temp"), "max_temp": ("max", "temp"),
        "rainfall": "sum", "humidity": "avg",
    }
    return daily_resample(events, ["site_id"], "ts", how)


FORECAST = """
SELECT user_id AS site_id, CAST(ts AS DATE) AS date, avg(value) AS temp, min(value) AS min_temp,
       max(value) AS max_temp, sum(value / CAST(20 AS DOUBLE)) AS rainfall,
       avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS humidity
FROM events GROUP BY 1, 2"""


# --- one request per site ------------------------------------------------------

CROPS = ["economy", "large", "medium", "promo", "small", "standard"]


def requests(spark, folder, days: int = 10) -> DataFrame:
    events = table(spark, folder, "events")
    names = F.array(*[F.lit(c) for c in CROPS])
    return events.groupBy(F.col("user_id").alias("site_id")).agg(
        F.min(F.to_date("ts")).alias("start_date")
    ).select(
        F.col("site_id").alias("request_id"),
        "site_id",
        F.element_at(names, (F.pmod("site_id", F.lit(6)) + 1).cast("int")).alias("crop"),
        "start_date",
        F.lit(days).alias("duration"),
    )


REQUESTS = f"""
SELECT user_id AS request_id, user_id AS site_id,
       {CROPS}[(user_id % 6 + 1)::INT] AS crop,
       min(CAST(ts AS DATE)) AS start_date, 10 AS duration
FROM events GROUP BY user_id"""


# --- SQL pieces ----------------------------------------------------------------

def neighbours_sql(h: str, q: str, ids: list[str], k: int, by: str | None = None,
                   features: list[str] = FEATURES, extra: str = "", fit: str | None = None) -> str:
    """CTEs ``st, hz, qz, nn``: k nearest rows of view ``h`` for each row of ``q``."""
    keys = f"{by}, " if by else ""
    link = f"JOIN st USING ({by})" if by else "CROSS JOIN st"
    stats = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in features)
    z = ", ".join(f"({f} - m_{f}) / coalesce(nullif(s_{f}, 0), 1) AS z_{f}" for f in features)
    d = "round_even(sqrt(" + " + ".join(f"(a.z_{f} - b.z_{f}) * (a.z_{f} - b.z_{f})" for f in features) + "), 9)"
    who = ", ".join(f"b.{i}" for i in ids)
    pair = f"JOIN qz b ON a.{by} = b.{by}" if by else "CROSS JOIN qz b"
    at = (f"a.{by}, " if by else "") + who
    return f"""
st AS (SELECT {keys}{stats} FROM {fit or h} {f'GROUP BY {by}' if by else ''}),
hz AS (SELECT {h}.*, {z} FROM {h} {link}),
qz AS (SELECT {q}.*, {z} FROM {q} {link}),
nn AS (SELECT * FROM (
  SELECT {at}, a.hist_id, a.result, {d} AS distance{extra},
         row_number() OVER (PARTITION BY {at} ORDER BY {d}, a.hist_id) AS rank
  FROM hz a {pair}) WHERE rank <= {k})"""


def vote_sql(ids: list[str]) -> str:
    """CTEs ``vote, score`` on top of ``nn``: viability per ids."""
    who = ", ".join(ids)
    return f"""
vote AS (SELECT {who},
  CASE WHEN min(distance) = 0
       THEN sum(CASE WHEN distance = 0 THEN result ELSE 0 END)
            / sum(CASE WHEN distance = 0 THEN 1.0::DOUBLE ELSE 0 END)
       ELSE sum(result / nullif(distance, 0)) / sum(1 / nullif(distance, 0)) END AS p,
  exp(-avg(distance) / 3) * 100 AS sim FROM nn GROUP BY {who}),
score AS (SELECT {who}, round_even(sim, 2) AS similarity_score,
  round_even(sim / 100 * p * 100, 2) AS success_probability,
  CASE WHEN sim >= 85 AND sim / 100 * p * 100 >= 75 THEN 'low' WHEN sim >= 68 THEN 'medium'
       ELSE 'high' END AS risk_level FROM vote)"""
