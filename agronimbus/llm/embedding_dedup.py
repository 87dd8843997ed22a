"""Near duplicates among embeddings by a PCA-ordered, tiled comparison.

Vectors are turned to the principal axes of all unit vectors, largest variance
first. Two unit vectors of cosine t or more lie at most sqrt(2 - 2t) apart, also
along each axis, so cells of that width on the leading axes need to be compared
with neighbour cells only. Cells are cut into tiles of bounded size, and one task
compares two tiles: it sums products of the leading axes first, bounds the rest by
the product of the suffix norms, and drops a pair as soon as it cannot reach t.
What is left is checked on the original vectors in double precision.

Equal vectors are one class with a count, so copies are never compared. A task
returns link counts and a spanning forest, not all pairs. Vectors are only compared
under equal labels; label null, and vectors that are null, empty, zero or hold null
or non-finite numbers, link with nothing, nor do vectors of different length. Rows
with vec_id null link with nothing either and are not kept. Numbers of any size count:
rows are scaled by a power of two before they are squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import materialise
from .components import connected_components, local_roots
from .shipping import ship

#: Axes that are summed before a pair is looked at again.
STRIDE = 8
#: Room for rounding in bounds; the last check has none.
ROUNDING = 1e-9
CELL_AXES = 2


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column (all of one length) in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _units(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)  # squares of large numbers would overflow
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _shrunk(raw: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest number near 1: no digit is lost, no square overflows."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, keepdims=True))[1]) if raw.size else raw


def _by_size(table: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    sizes = table.column("size").to_numpy()
    for size in np.unique(sizes):
        yield int(size), np.flatnonzero(sizes == size)


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """By vector length: axes as columns, largest variance first.

    Each task sums products of its rows, Spark sums those of all tasks; the driver
    gets length squared numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for size, rows in _by_size(b):
                u = _units(_matrix(b.column("embedding").take(pa.array(rows))))
                sums[size] = sums.get(size, 0.0) + u.T @ u
        for size, s in sums.items():
            yield pa.record_batch(
                [
                    pa.array(np.full(size * size, size), pa.int32()),
                    pa.array(np.arange(size * size), pa.int64()),
                    pa.array(s.ravel(), pa.float64()),
                ],
                ["size", "at", "value"],
            )

    sums = classes.select("size", "embedding").mapInArrow(run, "size int, at bigint, value double")
    table = sums.groupBy("size", "at").agg(F.sum("value").alias("value")).toArrow().sort_by([("size", "ascending"), ("at", "ascending")])
    axes = {}
    for size, rows in _by_size(table):
        s = table.column("value").to_numpy()[rows].reshape(size, size)
        axes[size] = np.ascontiguousarray(np.linalg.eigh((s + s.T) / 2)[1][:, ::-1])
    return axes


def near_pairs(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with cosine >= threshold; a and b are turned unit vectors.

    ``same``: both are one tile, each pair is looked at once.
    """
    size = a.shape[1]
    suffix = [np.sqrt(np.maximum((x[:, ::-1] ** 2).cumsum(axis=1)[:, ::-1], 0)) for x in (a, b)]
    first = min(STRIDE, size)
    partial = a[:, :first] @ b[:, :first].T
    reach = partial.copy()
    if first < size:
        reach += np.outer(suffix[0][:, first], suffix[1][:, first])
    alive = reach >= threshold - ROUNDING
    if same:
        alive = np.triu(alive, 1)
    i, j = np.nonzero(alive)
    total = partial[i, j]
    at = first
    while at < size and len(i):
        end = min(at + STRIDE, size)
        total = total + np.einsum("ij,ij->i", a[i, at:end], b[j, at:end])
        bound = total + (suffix[0][i, end] * suffix[1][j, end] if end < size else 0.0)
        left = bound >= threshold - ROUNDING
        i, j, total, at = i[left], j[left], total[left], end
    x, y = _shrunk(raw_a)[i], _shrunk(raw_b)[j]
    cosine = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
    return i[cosine >= threshold], j[cosine >= threshold]


def vector_classes(vectors: DataFrame) -> DataFrame:
    """One row per distinct label and vector: cls, label, size, embedding, least id, copies."""
    usable = vectors.filter(
        "vec_id is not null and label is not null and size(embedding) > 0 and "
        "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and "
        "exists(embedding, x -> x <> 0)"
    )
    grouped = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    return grouped.withColumns({"cls": F.xxhash64("label", "embedding"), "size": F.size("embedding")})


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tile_rows: int = 1_024, cell_axes: int = CELL_AXES) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept; see the module's notes.

    ``vectors``: vec_id, embedding, label.
    """
    ship(vectors.sparkSession)
    vectors = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    classes = materialise(vector_classes(vectors))
    axes = principal_axes(classes)
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = np.zeros((b.num_rows, cell_axes), np.int64)
            for size, rows in _by_size(b):
                u = _units(_matrix(b.column("embedding").take(pa.array(rows))))
                lead = u @ axes[size][:, :cell_axes]
                cells[rows[:, None], np.arange(lead.shape[1])] = np.floor(lead / width)
            yield pa.record_batch(
                [b.column(c) for c in ("cls", "label", "size", "copies", "embedding")] + [pa.array(list(cells), pa.list_(pa.int64()))],
                ["cls", "label", "size", "copies", "embedding", "cell"],
            )

    kind = dict(vectors.select("label").dtypes)["label"]
    placed = classes.select("cls", "label", "size", "copies", "embedding").mapInArrow(
        place, f"cls bigint, label {kind}, size int, copies bigint, embedding array<double>, cell array<bigint>"
    )
    placed = materialise(placed)
    keys = ["label", "size", "cell"]
    cells = materialise(placed.groupBy(*keys).agg(F.ceil(F.count("cls") / tile_rows).cast("bigint").alias("tiles")))
    # Of two neighbour cells one is the later; a cell is also its own neighbour.
    steps = [[]]
    for _ in range(cell_axes):
        steps = [[*s, d] for s in steps for d in (-1, 0, 1)]
    ahead = [s for s in steps if s >= [0] * cell_axes]
    near = cells.select(*keys, "tiles", F.explode(F.array(*[F.array(*[F.lit(d).cast("bigint") for d in s]) for s in ahead])).alias("step"))
    near = near.withColumn("other", F.zip_with("cell", "step", lambda x, y: x + y))
    other = cells.select(F.col("label").alias("_l"), F.col("size").alias("_s"), F.col("cell").alias("_c"), F.col("tiles").alias("_t"))
    near = near.join(other, (F.col("label") == F.col("_l")) & (F.col("size") == F.col("_s")) & (F.col("other") == F.col("_c")))
    tiles = near.select(*keys, "other", "_t", F.explode(F.expr("sequence(0L, tiles - 1)")).alias("i"))
    tiles = tiles.select(*keys, "other", "i", F.explode(F.expr("sequence(if(cell = other, i, 0L), _t - 1)")).alias("j"))
    tiles = tiles.withColumn("pair", F.xxhash64("label", "size", "cell", "i", "other", "j"))
    sides = tiles.select("label", "size", F.col("cell").alias("cell"), F.col("i").alias("tile"), "pair", F.lit(0).alias("side")).unionByName(
        tiles.filter("not (cell = other and i = j)").select("label", "size", F.col("other").alias("cell"), F.col("j").alias("tile"), "pair", F.lit(1).alias("side"))
    )
    sides = materialise(sides)
    tiled = placed.join(cells, keys).withColumn("tile", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("tiles")))
    dealt = tiled.join(sides, [*keys, "tile"]).select("pair", "side", "cls", "size", "copies", "embedding")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        cls, copies = table.column("cls").to_numpy(), table.column("copies").to_numpy()
        raw = _matrix(table.column("embedding").combine_chunks())
        turned = _units(raw) @ axes[raw.shape[1]] if len(raw) else raw
        left = np.flatnonzero(side == 0)
        same = not (side == 1).any()
        right = left if same else np.flatnonzero(side == 1)
        i, j = near_pairs(turned[left], turned[right], raw[left], raw[right], threshold, same)
        i, j = left[i], right[j]
        links = np.bincount(i, copies[j], len(cls)) + np.bincount(j, copies[i], len(cls))
        root = local_roots(len(cls), i, j)
        linked = np.flatnonzero(links > 0)
        return pa.table(
            {
                "a": pa.array(cls[linked], pa.int64()),
                "b": pa.array(cls[root[linked]], pa.int64()),
                "links": pa.array(links[linked].astype(np.int64), pa.int64()),
            }
        )

    # One row per linked class and pair of tiles: its links there and the root of its group.
    found = materialise(dealt.groupBy("pair").applyInArrow(compare, "a bigint, b bigint, links bigint"))
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select("a", "b"))
    member = classes.select("cls", "label", "embedding", "least_id", "copies")
    member = member.join(counts, F.col("cls") == F.col("a"), "left").join(groups, F.col("cls") == F.col("node"), "left")
    member = member.withColumn("component", F.coalesce("component", "cls"))
    least = member.groupBy(F.col("component").alias("_component")).agg(F.min("least_id").alias("component_id"))
    member = member.join(least, F.col("component") == F.col("_component"))
    member = member.select(
        F.col("label").alias("_label"), F.col("embedding").alias("_embedding"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id",
    )
    own = vectors.join(member, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")) & F.col("vec_id").isNotNull(), "left")
    own = own.withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return own.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERY = ("op4_embedding_dedup", embedding_duplicates)
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id < b.vec_id
         WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, ways.b FROM reach JOIN ways ON ways.a = reach.other)
SELECT vec_id, (SELECT count(*) FROM ways WHERE ways.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1)"""
