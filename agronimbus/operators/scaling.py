"""Standardisation and min-max scaling with fitted statistics as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import number_or_zero
from ..plans.storage import materialise
from .ordering import match_on


def _need(df: DataFrame, names: list[str], what: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing {', '.join(missing)}")


def scaler_aggregates(features: list[str], only=None, mark: str = "") -> list:
    """Mean and population deviation per feature, over the rows where ``only``."""
    out = []
    for f in features:
        x = number_or_zero(f)
        x = x if only is None else F.when(only, x)
        out.append(F.avg(x).alias(f"{f}__mean{mark}"))
        out.append(F.stddev_pop(x).alias(f"{f}__sd{mark}"))
    return out


def fit_scaler(df: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    """One row of statistics, or one per group; unparsable values count as 0."""
    _need(df, features, "scaler features")
    return df.groupBy(*(by or [])).agg(*scaler_aggregates(features))


def z_score(feature: str, mean, sd):
    """A deviation of zero divides by one."""
    return (number_or_zero(feature) - mean) / F.coalesce(F.nullif(sd, F.lit(0.0)), F.lit(1.0))


def apply_scaler(
    df: DataFrame,
    stats: DataFrame,
    features: list[str],
    by: list[str] | None = None,
    prefix: str = "z_",
    mark: str = "",
) -> DataFrame:
    """Add ``z_<feature>`` columns.

    Global statistics come in as a scalar subquery. Grouped ones are joined; pass
    a materialised table so that Spark sees its size and picks the join by it.
    Rows of groups without statistics drop out.
    """
    _need(df, features, "scaler input")
    wanted = [f"{f}__{s}{mark}" for f in features for s in ("mean", "sd")]
    if any(c not in stats.columns for c in wanted):
        raise ValueError("the scaler has not been fitted yet on these features")
    if by:
        joined = df.join(stats.select(*by, *wanted), by)
        z = [z_score(f, F.col(f"{f}__mean{mark}"), F.col(f"{f}__sd{mark}")) for f in features]
        return joined.withColumns({f"{prefix}{f}": x for f, x in zip(features, z)}).drop(*wanted)
    fit = stats.select(F.struct(*wanted).alias("s")).scalar()
    return df.withColumns(
        {
            f"{prefix}{f}": z_score(f, fit.getField(f"{f}__mean{mark}"), fit.getField(f"{f}__sd{mark}"))
            for f in features
        }
    )


def min_max_scale(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Scale to [0, 1] in place; a constant column becomes 0. Default: all numbers."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    ends = df.agg(
        F.struct(
            *[F.min(c).cast("double").alias(f"{c}__lo") for c in columns],
            *[F.max(c).cast("double").alias(f"{c}__hi") for c in columns],
        ).alias("s")
    ).scalar()
    out = {}
    for c in columns:
        lo, hi = ends.getField(f"{c}__lo"), ends.getField(f"{c}__hi")
        out[c] = F.when(hi == lo, F.lit(0.0)).otherwise((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return df.withColumns(out)


def attach_group_means(
    df: DataFrame, measures: list[str], by: list[str] | None = None, suffix: str = "_mean"
) -> DataFrame:
    """Add each measure's mean over the table or over the row's group."""
    means = [F.avg(m).alias(m + suffix) for m in measures]
    if by:
        return match_on(df, materialise(df.groupBy(*by).agg(*means)), by, "left")
    fit = df.agg(F.struct(*means).alias("s")).scalar()
    return df.withColumns({m + suffix: fit.getField(m + suffix) for m in measures})
