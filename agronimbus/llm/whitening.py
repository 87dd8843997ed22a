"""Whitening of embeddings with a covariance found by polarisation.

Entries become whole numbers, floor(scale * c) + shift, so every sum is exact. The fit
list holds each distinct vector once. Its entries are centred at the whole number
nearest their mean; tasks add up the squares of every centred dimension and of every sum
of two centred dimensions, and since

    2 cov(i, j) = var(i + j) - var(i) - var(j),

differences of variances give all covariances. What the whole number leaves of the mean
(half at most) is taken off in exact integers, so nothing is rounded before the matrix is
handed to eigh. A task's sums travel as limbs of thirty bits, which Spark adds up; the
driver gets some limbs for each pair of dimensions, whatever the number of rows.

Rows whose vector is null or holds null, NaN or infinite entries are dropped, as are
empty vectors. Numbers whose scaled size is beyond 2**62 are held there, so that they fit a long. Repeated rows are
each whitened but fitted once. Vectors of different length are fitted apart, each length
with its own components. Components without variance (equal vectors only, or fewer
vectors than dimensions) cannot be scaled and are left out; equal eigenvalues leave the
choice of axes open, and the one made holds for all rows. vec_id null is kept as it is.
An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import materialise
from .embedding_dedup import _by_size, _matrix
from .shipping import ship

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LIMB = 30
#: Rows whose sums of pairs are squared at once.
ROWS_AT_ONCE = 256
#: An eigenvalue below this share of the largest is none.
NO_VARIANCE = 1e-14


@dataclass(frozen=True)
class Whitening:
    """What is learned from the vectors of one length; ``centre`` whole, ``rest`` = sum - n * centre."""

    n: int
    centre: np.ndarray
    rest: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float


def whole_numbers(vectors: DataFrame, keep: list[str], embedding: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``keep``, size and x (the whole numbers) of the vectors that can be used."""
    usable = vectors.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.col(f"`{embedding}`").cast("array<double>").alias("e"))
    usable = usable.filter("size(e) > 0 and forall(e, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")
    held = lambda v: F.least(F.greatest(v * scale, F.lit(-(2.0**62))), F.lit(2.0**62))
    x = F.transform("e", lambda v: F.floor(held(v)) + F.lit(shift).cast("bigint"))
    return usable.select(*[F.col(f"_{i}") for i in range(len(keep))], F.size("e").alias("size"), x.alias("x"))


def _limbs(values: list[int]) -> Iterator[tuple[int, int, int]]:
    """(place, limb, part) of numbers not below 0; sum of part << (LIMB * limb) is the number."""
    for at, v in enumerate(values):
        limb = 0
        while v:
            yield at, limb, v & ((1 << LIMB) - 1)
            v, limb = v >> LIMB, limb + 1


def _exact_sums(rows: DataFrame, count: int, parts) -> list[int]:
    """Sums over all rows of ``count`` numbers, exact; ``parts(batch)`` adds up one batch (numbers not below 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * count
        for b in batches:
            total = [a + v for a, v in zip(total, parts(b))]
        found = list(_limbs(total))
        yield pa.record_batch([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["at", "limb", "part"])

    summed = rows.mapInArrow(run, "at bigint, limb bigint, part bigint").groupBy("at", "limb").agg(F.sum("part").alias("part"))
    out = [0] * count
    for at, limb, part in summed.collect():  # some limbs for each number
        out[at] += part << (LIMB * limb)
    return out


def _whole(column: pa.Array, centre: np.ndarray | None = None) -> np.ndarray:
    """Rows of a list column as whole numbers, less a centre; Python's where 64 bits could be too few."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)
    if centre is None:
        return x
    if len(x) and max(int(x.max()) - int(centre.min()), int(centre.max()) - int(x.min())) >= 1 << 62:
        return x.astype(object) - centre.astype(object)
    return x - centre


def _square_sums(z: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[int]:
    """Of each dimension and each pair of dimensions, the sum of squares of z and of z + z."""
    most = max(abs(int(z.max())), abs(int(z.min()))) if z.size else 0
    total = np.zeros(z.shape[1] + len(left), object)
    for i in range(0, len(z), ROWS_AT_ONCE):
        part = z[i : i + ROWS_AT_ONCE]
        if 4 * most * most * len(part) >= 1 << 62:
            part = part.astype(object)
        pairs = part[:, left] + part[:, right]
        total += np.concatenate([(part * part).sum(axis=0), (pairs * pairs).sum(axis=0)]).astype(object)
    return total.tolist()


def fit(vectors: DataFrame, components: int = COMPONENTS, embedding: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> tuple[dict[int, Whitening], DataFrame]:
    """By vector length what whitens it, and the fit list (size, x)."""
    ship(vectors.sparkSession)
    distinct = materialise(whole_numbers(vectors, [], embedding, scale, shift).distinct())
    found = {}
    for size, n in sorted(distinct.groupBy("size").count().collect()):  # one row per vector length
        rows = distinct.filter(F.col("size") == size).select("x")
        # Numbers not below 0: what stands above the smallest possible one.
        sums = _exact_sums(rows, size, lambda b: (_whole(b.column("x")).astype(object) + (1 << 63)).sum(axis=0).tolist() if b.num_rows else [0] * size)
        sums = [s - n * (1 << 63) for s in sums]
        centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
        rest = tuple(s - n * int(c) for s, c in zip(sums, centre))
        left, right = np.triu_indices(size, 1)
        squares = _exact_sums(rows, size + len(left), lambda b: _square_sums(_whole(b.column("x"), centre), left, right))
        # n * n times the variances of dimensions and of sums of two.
        variance = [n * s - r * r for s, r in zip(squares, rest)]
        covariance = np.empty((size, size))
        for i in range(size):
            covariance[i, i] = Fraction(variance[i], n * n)
        for i, j, s in zip(left.tolist(), right.tolist(), squares[size:]):
            pair = n * s - (rest[i] + rest[j]) ** 2
            covariance[i, j] = covariance[j, i] = Fraction(pair - variance[i] - variance[j], 2 * n * n)
        values, axes = np.linalg.eigh(covariance)
        values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
        some = values > NO_VARIANCE * max(float(values[0]), 0.0) if len(values) else values > 0
        trace = float(Fraction(sum(variance[:size]), n * n))
        found[size] = Whitening(n, centre, rest, np.ascontiguousarray(axes[:, some]), values[some], trace)
    return found, distinct


def _turned(z: np.ndarray, model: Whitening) -> np.ndarray:
    centred = z.astype(np.float64) - np.array([float(Fraction(r, model.n)) for r in model.rest])
    return centred @ model.axes / np.sqrt(model.values)


def identity_errors(distinct: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """By vector length the largest absolute entry of (covariance of the whitened fit list - identity)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for size, at in _by_size(b):
                w = _turned(_whole(b.column("x").take(pa.array(at)), models[size].centre), models[size])
                sums[size] = sums.get(size, 0.0) + np.vstack([w.sum(axis=0), w.T @ w])
        for size, s in sums.items():
            yield pa.record_batch([pa.array(np.full(s.size, size), pa.int32()), pa.array(np.arange(s.size), pa.int64()), pa.array(s.ravel(), pa.float64())], ["size", "at", "value"])

    summed = distinct.mapInArrow(run, "size int, at bigint, value double").groupBy("size", "at").agg(F.sum("value").alias("value"))
    table, errors = summed.toArrow().sort_by([("size", "ascending"), ("at", "ascending")]), {}
    for size, rows in _by_size(table):
        s = table.column("value").to_numpy()[rows].reshape(len(models[size].values) + 1, -1) / models[size].n
        errors[size] = float(np.abs(s[1:] - np.outer(s[0], s[0]) - np.eye(s.shape[1])).max(initial=0.0))
    return errors


def whiten(vectors: DataFrame, models: dict[int, Whitening], keep: tuple[str, ...] = ("vec_id",), embedding: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``keep``, n, deviation, whitened and explained (an entry per component) of each usable vector.

    deviation is the exact squared distance from the mean times n * n; null where 38 digits are too few.
    """
    from decimal import Decimal

    ship(vectors.sparkSession)
    rows = whole_numbers(vectors, list(keep), embedding, scale, shift)
    kinds = ", ".join(f"_{i} {vectors.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def distances(z: np.ndarray, model: Whitening) -> list[int]:
        # (n z - rest)^2 summed; 64 bits where they do, else Python's numbers.
        most, rest = int(np.abs(z).max(initial=0)), np.array(model.rest, object)
        wide = z.astype(object) if most * max(most, model.n) * z.shape[1] >= 1 << 62 else z
        squares, mixed = (wide * wide).sum(axis=1), (wide * (rest if wide is not z else rest.astype(np.int64))).sum(axis=1)
        return (model.n**2 * squares.astype(object) - 2 * model.n * mixed.astype(object) + int((rest * rest).sum())).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for size, at in _by_size(b):
                at, model = pa.array(at), models[size]
                z = _whole(b.column("x").take(at), model.centre)
                away = [Decimal(v) if v < 10**38 else None for v in distances(z, model)]
                turned = _turned(z, model)
                ends = pa.array(np.arange(len(turned) + 1) * turned.shape[1], pa.int32())
                share = np.broadcast_to(model.values / model.trace, turned.shape) if model.trace else turned
                columns = [pa.array(np.full(len(turned), model.n), pa.int64()), pa.array(away, pa.decimal128(38, 0))]
                columns += [pa.ListArray.from_arrays(ends, pa.array(v.ravel(), pa.float64())) for v in (turned, share)]
                yield pa.record_batch([*[b.column(f"_{i}").take(at) for i in range(len(keep))], *columns], names)

    names = [*[f"_{i}" for i in range(len(keep))], "n", "deviation", "whitened", "explained"]
    out = rows.mapInArrow(run, ", ".join(x for x in (kinds, "n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>") if x))
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], *names[len(keep) :])


def whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    models, distinct = fit(vectors)
    errors = identity_errors(distinct, models)
    found = whiten(vectors, models)
    return found.select(
        "vec_id", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    ).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"),
        F.lit(max(errors.values(), default=0.0)).alias("identity_error"),
    )


QUERY = ("op11_whitening", whitened_embeddings)
