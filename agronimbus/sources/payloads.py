"""Landed JSON payloads to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs, vocab

# Parameter names of the daily-weather payload.
PARAMETERS = {
    "T2M": "temp",
    "T2M_MIN": "min_temp",
    "T2M_MAX": "max_temp",
    "PRECTOTCORR": "rainfall",
    "RH2M": "humidity",
}
PARAMETER_SCHEMA = "properties struct<parameter: map<string, map<string, double>>>"

# Field names of the 3-hourly forecast payload.
FORECAST_FIELDS = {"temp": "temp", "min_temp": "temp_min", "max_temp": "temp_max", "humidity": "humidity"}
FORECAST_SCHEMA = (
    "list array<struct<dt_txt: string,"
    " main: struct<temp: double, temp_min: double, temp_max: double, humidity: double>,"
    " rain: map<string, double>>>"
)


def parameter_map_to_daily(payloads: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """``parameter -> yyyymmdd -> value`` to one wide row per key and day."""
    parsed = payloads.select(*keys, F.from_json(body, PARAMETER_SCHEMA).alias("j"))
    long = parsed.select(*keys, F.explode("j.properties.parameter").alias("name", "days")).select(
        *keys, "name", F.explode("days").alias("day", "value")
    )
    wide = long.groupBy(*keys, exprs.compact_date("day").alias("date")).agg(
        *[
            F.min(F.when(F.col("name") == source, F.col("value"))).alias(target)
            for source, target in PARAMETERS.items()
        ]
    )
    return wide


def forecast_list_to_rows(payloads: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """3-hourly list to rows; an absent field takes its default."""
    parsed = payloads.select(*keys, F.from_json(body, FORECAST_SCHEMA).alias("j"))
    item = parsed.select(*keys, F.explode("j.list").alias("i"))
    d = vocab.FORECAST_DEFAULTS
    fields = {n: F.coalesce(F.col(f"i.main.{src}"), F.lit(d[n])) for n, src in FORECAST_FIELDS.items()}
    rain = F.coalesce(F.try_element_at("i.rain", F.lit("3h")), F.lit(d["rainfall"]))
    return item.select(
        *keys,
        exprs.leading_date("i.dt_txt").alias("date"),
        *[fields[n].alias(n) for n in ("temp", "min_temp", "max_temp")],
        rain.alias("rainfall"),
        fields["humidity"].alias("humidity"),
    )


def summary_text(payloads: DataFrame, body: str = "body", out: str = "extract") -> DataFrame:
    return payloads.withColumn(out, F.coalesce(F.get_json_object(body, "$.extract"), F.lit("")))
