"""Column names, order and presence. All metadata work, no data is touched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab


def rename_all(df: DataFrame, rule) -> DataFrame:
    """Apply ``rule`` to every header; two columns of one name raise."""
    names = [rule(c) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns collide after renaming: {', '.join(twice)}")
    return df.toDF(*names)


def plain_headers(df: DataFrame) -> DataFrame:
    return rename_all(df, lambda c: c.lower().strip())


def snake_headers(df: DataFrame) -> DataFrame:
    return rename_all(df, lambda c: c.lower().replace(" ", "_"))


def title_headers(df: DataFrame) -> DataFrame:
    return rename_all(df, lambda c: c.replace("_", " ").title())


def apply_aliases(df: DataFrame, aliases: dict[str, str] = vocab.ALIASES) -> DataFrame:
    return rename_all(df, lambda c: aliases.get(c, c))


def ensure_columns(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Exactly the schema's columns in its order; an absent one is its default or NULL."""
    defaults = defaults or {}
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name)))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )


def conform(
    df: DataFrame,
    schema: T.StructType,
    aliases: dict[str, str] = vocab.ALIASES,
    defaults: dict | None = None,
) -> DataFrame:
    return ensure_columns(apply_aliases(plain_headers(df), aliases), schema, defaults)


def require_same_schema(a: DataFrame, b: DataFrame) -> None:
    left = [(f.name, f.dataType) for f in a.schema.fields]
    right = [(f.name, f.dataType) for f in b.schema.fields]
    if left != right:
        raise ValueError(f"schema mismatch: {left} and {right}")


def _doubles(names):
    return [T.StructField(n, T.DoubleType()) for n in names]


CROP_HISTORY = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("crop", T.StringType()),
        *_doubles(vocab.FEATURES),
        T.StructField("result", T.IntegerType()),
    ]
)
SEASON_DAILY = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("crop", T.StringType()),
        *_doubles(vocab.FEATURES),
        *_doubles(["soil_ph", "water_requirement"]),
        T.StructField("growth_duration", T.IntegerType()),
        T.StructField("weather_condition", T.StringType()),
    ]
)
