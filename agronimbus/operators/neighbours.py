"""Exact k-nearest-neighbour join without comparing every pair.

Outline, the same for every size:
1. Copies of a point are cut to the smallest ids: as ties go to the smaller id, a
   copy beyond the k-th is nobody's neighbour. Points with more than k copies are found
   by counting hashes, so only their rows are sorted. Equal queries are asked once.
2. A k-d tree over a bounded sample, turned to its principal axes, cuts the space into
   leaves of similar size, along the axes of largest spread first. Rows go to leaves;
   large leaves are split by hash into blocks. A box around the rows of each leaf (its
   least and greatest coordinates on the axes) is as small as the rows allow.
3. Each query is answered within one block of the leaf whose box lies nearest, found by
   walking down the boxes. The distance of its k-th neighbour there is a bound no true
   neighbour exceeds. Inside a block a second tree does the same with small leaves.
4. The query visits only those other blocks whose box lies within the bound (none, if
   there is one block), and takes only rows within it along.
5. The best k of what the blocks returned are kept. Answers stay lists, one a query, until
   they have met the rows that asked; tasks there get a given number of such rows.

A block and the queries sent to it have a target size in rows and in bytes, so no task
grows with the data, with a hot group or with a hot region. Vector and bound travel with
a visit, so visits, which are more than the queries, meet no other table than the
blocks. With few features, or many whose spread lies along a few directions (clusters),
most leaves are out of reach, also of queries far away from all rows. Of many
that spread alike in all directions a query reaches nearly all leaves, and the join
becomes a comparison in blocks of all queries with all rows.

Vectors that are null or empty or hold a null, NaN or infinite number are nobody's
neighbour and have none; vectors of different length are not compared.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.storage import materialise

BLOCK_ROWS = 50_000
BLOCK_QUERIES = 20_000
BLOCK_BYTES = 8 << 20  # of vectors, on either side
FEW_TASKS = 200  # spark.shuffle.sort.bypassMergeThreshold
INNER_ROWS = 256  # of a leaf inside a block
COPY_ROWS = 10_000  # of a share in which the copies of a point are cut first
COPY_SALTS = 8  # least number of shares of a point with more copies than that
SAMPLE_PER_LEAF = 32
SAMPLE_BYTES = 64 << 20  # of vectors that the driver sees
PAIRS_AT_ONCE = 2_000_000  # inside a task
TASK_ROWS = 250_000  # that one task sorts or collects
ASKED_ROWS = 50_000  # of the table of queries that one task joins with their answers
ALIKE = 2.0  # variances within this factor leave the principal axes to chance

# Distances are compared and reported to nine decimals of the power of ten below the
# group's largest coordinate, so that the last bits, which depend on the order of a
# distributed sum, decide no tie, whatever the scale of the data.
DIGITS = 9


# Tasks get the helpers below with their code, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- helpers run inside tasks ------------------------------------------------

def _cut(points: np.ndarray, leaves: int, least: int) -> list | None:
    """Nested [dimension, value, left, right] splits at medians; None is a leaf."""
    if leaves < 2 or len(points) < 2 * least:
        return None
    for dim in np.argsort(points.min(axis=0) - points.max(axis=0)):  # widest first
        at = float(np.median(points[:, dim]))
        below = points[:, dim] < at
        if least <= below.sum() <= len(points) - least:
            half = leaves // 2
            return [int(dim), at, _cut(points[below], half, least), _cut(points[~below], half, least)]
    return None


def _fitted(points: np.ndarray, leaves: int, least: int) -> tuple[np.ndarray, list] | None:
    """Principal axes (columns) of the points and a tree over the turned points.

    Where the spread is alike in all directions these axes lie anyhow; the features' own
    are kept then, as boxes along them fit rows that end at a feature's least or greatest
    value, and queries beyond it reach few of them.
    """
    centred = points - points.mean(axis=0)
    size = np.abs(centred).max(initial=0.0)
    if not 0 < size < float("inf"):
        return None
    centred /= size
    spread, turn = np.linalg.eigh(centred.T @ centred)
    axes = np.eye(len(spread)) if spread[-1] <= ALIKE * spread[0] else np.ascontiguousarray(turn[:, ::-1])
    tree = _cut(points @ axes, leaves, least)
    return tree and (axes, tree)


def _leaf_of(tree, points: np.ndarray) -> np.ndarray:
    """Leaf number of each (turned) point; a node's children are 2n+1 and 2n+2."""
    out = np.zeros(len(points), dtype=np.int64)
    todo = [(tree, 0, np.arange(len(points)))]
    while todo:
        node, number, rows = todo.pop()
        if node is None or not len(rows):
            out[rows] = number
            continue
        below = points[rows, node[0]] < node[1]
        todo.append((node[2], 2 * number + 1, rows[below]))
        todo.append((node[3], 2 * number + 2, rows[~below]))
    return out


def _box_gap(points: np.ndarray, box) -> np.ndarray:
    """Distance of each point from a box (least and greatest coordinates)."""
    low, high = box
    away = np.maximum(np.maximum(low - points, points - high), 0)
    return np.sqrt(np.einsum("ij,ij->i", away, away))


def _node_boxes(tree, leaves: dict, number: int = 0) -> dict:
    """Boxes of all nodes that hold rows, from those of the leaves; by node number."""
    if tree is None:
        return {number: leaves[number]} if number in leaves else {}
    out = {}
    for child, step in ((2, 1), (3, 2)):
        inner = 2 * number + step
        out |= _node_boxes(tree[child], leaves, inner)
        if inner in out:
            low, high = out.get(number, out[inner])
            out[number] = np.minimum(low, out[inner][0]), np.maximum(high, out[inner][1])
    return out


def _nearest_leaf(tree, points: np.ndarray, boxes: dict) -> np.ndarray:
    """The leaf reached by going down to the nearer box each time; it holds rows."""
    out = np.zeros(len(points), dtype=np.int64)
    todo = [(tree, 0, np.arange(len(points)))]
    while todo:
        node, number, rows = todo.pop()
        if node is None or not len(rows):
            out[rows] = number
            continue
        left, right = 2 * number + 1, 2 * number + 2
        if left in boxes and right in boxes:
            gaps = [_box_gap(points[rows], boxes[n]) for n in (left, right)]
            below = (gaps[0] < gaps[1]) | ((gaps[0] == gaps[1]) & (points[rows, node[0]] < node[1]))
        else:
            below = np.full(len(rows), left in boxes)
        todo.append((node[2], left, rows[below]))
        todo.append((node[3], right, rows[~below]))
    return out


def _leaves_within(tree, points: np.ndarray, bound: np.ndarray, boxes: dict | None = None):
    """(row, leaf) pairs where the leaf's region is no further than the bound.

    Without ``boxes`` a leaf is bounded along the axes it was cut on, so the gap on these
    alone is less than any distance to its points; boxes are smaller and bounded outwards
    too. What turning rounds is far below the bound's room.
    """
    todo = [(tree, 0, np.arange(len(points)), None if boxes else np.zeros_like(points))]
    while todo:
        node, number, rows, gap = todo.pop()
        if not len(rows):
            continue
        if node is None:
            yield rows, np.full(len(rows), number, dtype=np.int64)
            continue
        if boxes:
            for child, inner in ((2, 2 * number + 1), (3, 2 * number + 2)):
                if inner in boxes:
                    near = _box_gap(points[rows], boxes[inner]) <= bound[rows]
                    todo.append((node[child], inner, rows[near], None))
            continue
        offset = points[rows, node[0]] - node[1]
        for child, step, away in ((2, 1, np.maximum(offset, 0)), (3, 2, np.maximum(-offset, 0))):
            g = gap.copy()
            g[:, node[0]] = np.maximum(g[:, node[0]], away)
            near = np.sqrt((g * g).sum(axis=1)) <= bound[rows]
            todo.append((node[child], 2 * number + step, rows[near], g[near]))


def _compared(points: np.ndarray, asked: np.ndarray, k: int, digits: int, bound: np.ndarray):
    """(query, point, distance) of the k nearest points of each query, by all pairs; those
    beyond the query's bound may be missing.

    Products of matrices find what can be among the k nearest; exact differences
    decide. As many queries are looked at as make PAIRS_AT_ONCE pairs, and each is cut
    to k before the next, so that ties need no more memory than that.
    """
    k, unit = min(k, len(points)), 10.0 ** -digits
    chunk = max(1, PAIRS_AT_ONCE // len(points))
    middle = points.mean(axis=0)  # products lose less near the origin
    centred = points - middle
    squares = np.einsum("ij,ij->i", centred, centred)
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    for start in range(0, len(asked), chunk):
        part = asked[start:start + chunk]
        moved = part - middle
        rough = squares[None, :] - 2 * (moved @ centred.T)
        own = np.einsum("ij,ij->i", moved, moved)
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
        most = bound[start:start + chunk]
        kth = np.minimum(kth, most * most - own)
        # Room for what the products lose, and for distances that round to one value.
        far = np.sqrt(np.maximum(kth + own, 0))
        room = 1e-11 * (own + squares.max()) + 4 * unit * far + 4 * unit * unit
        row, col = np.nonzero(rough <= (kth + room)[:, None])
        total = np.zeros(len(row))
        for j in range(points.shape[1]):
            step = part[row, j] - points[col, j]
            total += step * step
        found.append(_first_k(row + start, col, np.round(np.sqrt(total), digits), k))
    return tuple(map(np.concatenate, zip(*found)))


def _inner_leaves(points: np.ndarray) -> list[np.ndarray]:
    """Rows of a block by small leaves, each in the order of its rows; of equal points one leaf."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        part = points[rows]
        dim = int(np.argmax(np.ptp(part, axis=0)))
        below = part[:, dim] < np.median(part[:, dim]) if len(rows) > INNER_ROWS else np.zeros(0, dtype=bool)
        if not below.any():  # few rows, or half of them share the least value
            below = part[:, dim] <= part[:, dim].min() if len(rows) > INNER_ROWS else below
            if not below.any() or below.all():
                out.append(rows)
                continue
        todo += [rows[below], rows[~below]]
    return out


def _nearest(points: np.ndarray, asked: np.ndarray, k: int, digits: int, bound: np.ndarray | None = None):
    """(query, point, distance) of the k nearest points of each query; those beyond the
    query's bound, if there is one, may be missing.

    The points are cut into small leaves with boxes. Each query looks into the leaves in
    the order of their boxes' distances, in rounds, until no further one is within the
    distance of its k-th neighbour so far.
    """
    bound = np.full(len(asked), np.inf) if bound is None else bound
    leaves = _inner_leaves(points) if len(points) > 2 * INNER_ROWS else []
    if len(leaves) < 3:
        return _compared(points, asked, k, digits, bound)
    low = np.array([points[rows].min(axis=0) for rows in leaves])
    high = np.array([points[rows].max(axis=0) for rows in leaves])
    chunk = max(1, PAIRS_AT_ONCE // len(leaves))
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    for start in range(0, len(asked), chunk):
        part, most = asked[start:start + chunk], bound[start:start + chunk].copy()
        gap = np.zeros((len(part), len(leaves)))
        for j in range(points.shape[1]):
            x = part[:, j, None]
            gap += np.square(np.maximum(np.maximum(low[:, j] - x, x - high[:, j]), 0))
        gap = np.sqrt(gap)
        order = np.argsort(gap, axis=1, kind="stable")
        best, done = found[0], 0
        while done < len(leaves):
            upto = 4 * done if done else 1
            leaf = order[:, done:upto]
            within = np.take_along_axis(gap, leaf, axis=1) <= most[:, None]
            done = upto
            row, place = np.nonzero(within)
            if not len(row):
                break  # all further leaves are further away
            leaf = leaf[row, place]
            by_leaf = np.argsort(leaf, kind="stable")
            row, leaf = row[by_leaf], leaf[by_leaf]
            cuts = np.flatnonzero(np.diff(leaf)) + 1
            new = [best]
            for at, who in zip(leaf[np.r_[0, cuts]], np.split(row, cuts)):
                r, c, d = _compared(points[leaves[at]], part[who], k, digits, most[who])
                new.append((who[r], leaves[at][c], d))
            best = _first_k(*map(np.concatenate, zip(*new)), k)
            last = np.flatnonzero(_place(best[0]) == k - 1)
            most[best[0][last]] = np.minimum(most[best[0][last]], _beyond(best[2][last], digits))
        found.append((best[0] + start, *best[1:]))
    return tuple(map(np.concatenate, zip(*found)))


def _beyond(far, digits: int):
    """A distance with room for what rounding and turning do to one of ``far``."""
    return far * (1 + 1e-9) + 4 * 10.0 ** -digits


def _place(row: np.ndarray) -> np.ndarray:
    """Position 0, 1, ... of each entry within its run of equal rows."""
    at = np.arange(len(row))
    first = np.r_[True, row[1:] != row[:-1]][: len(row)]
    return at - np.maximum.accumulate(np.where(first, at, 0))


def _first_k(row, col, dist, k):
    """The k best per row by (distance, point); points are in id order."""
    order = np.lexsort((col, dist, row))
    row, col, dist = row[order], col[order], dist[order]
    keep = _place(row) < k
    return row[keep], col[keep], dist[keep]


def _matrix(vectors) -> np.ndarray:
    """Rows of a list column of one length, of pandas or Arrow."""
    if isinstance(vectors, pd.Series):
        return np.concatenate(vectors.to_numpy()).reshape(len(vectors), -1)
    vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _nearest_in_block(history: pa.Table, queries: pa.Table, k: int, found: pa.DataType) -> pa.Table:
    """Queries of one block with their k nearest rows in it, as a list in order of rank, and
    the bound that these set."""
    history = history.sort_by("hist_id")
    digits = history.column("digits")[0].as_py()
    bound = queries.column("bound").to_numpy()
    row, col, dist = _nearest(_matrix(history.column("vec")), _matrix(queries.column("vec")), k, digits, bound)
    taken = pa.array(col)
    entries = pa.StructArray.from_arrays(
        [pa.array(dist) if f.name == "distance" else history.column(f.name).take(taken).combine_chunks().cast(f.type) for f in found.value_type],
        fields=list(found.value_type),
    )
    ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(queries)))]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries, type=found)
    full = np.diff(ends) >= k
    bound = bound.copy()
    bound[full] = np.minimum(bound[full], _beyond(dist[ends[1:][full] - 1], digits))
    at = queries.column_names.index("bound")
    return queries.set_column(at, queries.schema.field("bound"), pa.array(bound)).append_column(pa.field("found", found), lists)


# --- the plan ----------------------------------------------------------------

def _group_key(by: list[str]) -> Column:
    """Group and vector length as text."""
    size = F.size("vec")
    return F.to_json(F.struct(*by, size.alias("_size"))) if by else size.cast("string")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _usable(features: list[Column] | None) -> Column:
    """Whether ``vec`` can be compared; ``features`` are the columns that it is made of, if any."""
    if features is None:
        return F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", _finite)
    return reduce(lambda a, b: a & b, map(_finite, features), F.lit(len(features) > 0))


def _fit_trees(history: DataFrame, rows: int, dims: int, k: int, block_rows: int):
    """Trees of the groups worth splitting, from a sample of at most SAMPLE_BYTES."""
    per_leaf = SAMPLE_PER_LEAF * max(1, k // 8)
    leaves = min(-(-rows // block_rows), max(1, SAMPLE_BYTES // (8 * max(dims, 1) * per_leaf)))
    if leaves < 2:
        return {}
    share = min(1.0, leaves * per_leaf / rows)
    pick = F.pmod(F.xxhash64("g", "vec"), F.lit(1_000_000_000)) < F.lit(int(share * 1e9))
    sample = history.filter(pick).select("g", "vec").toArrow().to_pandas()
    trees = {}
    for g, part in sample.groupby("g"):
        points = np.unique(_matrix(part["vec"]), axis=0)
        budget = max(1, round(leaves * len(part) / len(sample)))
        tree = _fitted(points, 1 << (budget - 1).bit_length(), max(2 * k, SAMPLE_PER_LEAF // 4))
        if tree is not None:
            trees[g] = tree
    return trees


def _each_group(batch: pa.RecordBatch, trees: dict):
    """(group, row numbers, vectors) of the rows whose group has a tree."""
    vec, groups = batch.column("vec"), batch.column("g").to_pandas()
    for g, rows in groups.groupby(groups).indices.items():
        if g in trees:  # vectors of a group are of one length
            flat = vec.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
            yield g, rows, flat.reshape(len(rows), -1)


def _with_leaf(df: DataFrame, trees: dict, boxes: dict | None = None) -> DataFrame:
    """The leaf that a row lies in, or with ``boxes`` the one that lies nearest."""
    if not trees:
        return df.withColumn("leaf", F.lit(0).cast("bigint"))

    def assign(batches):
        for batch in batches:
            leaf = np.zeros(batch.num_rows, dtype=np.int64)
            for g, rows, points in _each_group(batch, trees):
                axes, tree = trees[g]
                turned = points @ axes
                leaf[rows] = _nearest_leaf(tree, turned, boxes[g]) if boxes else _leaf_of(tree, turned)
            yield batch.append_column("leaf", pa.array(leaf))

    schema = T.StructType([*df.schema.fields, T.StructField("leaf", T.LongType())])
    return df.mapInArrow(assign, schema)


def _fit_boxes(points: DataFrame, trees: dict) -> dict:
    """Group -> node number -> box around its rows. There are few leaves, so also few boxes."""
    axes_of = {g: axes for g, (axes, _) in trees.items()}
    names = ["g", "leaf", "axis", "low", "high"]

    def measure(batches):
        known = {}
        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            for g, rows, part in _each_group(batch, axes_of):
                turned, at = part @ axes_of[g], leaf[rows]
                order = np.argsort(at, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
                low, high = (f.reduceat(turned[order], starts, axis=0) for f in (np.minimum, np.maximum))
                for i, number in enumerate(at[order][starts].tolist()):
                    a, b = known.get((g, number), (low[i], high[i]))
                    known[g, number] = np.minimum(a, low[i]), np.maximum(b, high[i])
        for (g, number), (low, high) in known.items():
            n = len(low)
            yield pa.RecordBatch.from_arrays([pa.array([g] * n), pa.array([number] * n), pa.array(range(n)), pa.array(low), pa.array(high)], names)

    parts = points.select("g", "leaf", "vec").mapInArrow(measure, "g string, leaf bigint, axis bigint, low double, high double")
    ends = parts.groupBy("g", "leaf", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow().to_pandas()
    leaves = {g: {} for g in trees}
    for (g, number), part in ends.sort_values("axis").groupby(["g", "leaf"]):
        leaves[g][int(number)] = part["low"].to_numpy(), part["high"].to_numpy()
    return {g: _node_boxes(trees[g][1], found) for g, found in leaves.items()}


def _visits(near: DataFrame, trees: dict, boxes: dict, salts: dict, count: bool) -> DataFrame:
    """Queries (g, leaf, salt, qid, vec, bound) for each further block within their bound, or
    (g, leaf, salt, n) with their number in each task. ``salts``: those of the leaves that
    are cut into several blocks."""
    fields = "g string, leaf bigint, salt int, " + ("n bigint" if count else "qid binary, vec array<double>, bound double")

    def hits(batch):
        """(group, rows, leaf, salt) of visits, a leaf and salt at a time."""
        bound = batch.column("bound").to_numpy()
        own, done = batch.column("leaf").to_numpy(), batch.column("salt").to_numpy()
        for g, rows, points in _each_group(batch, trees):
            axes, tree = trees[g]
            for hit, leaf in _leaves_within(tree, points @ axes, bound[rows], boxes[g]):
                number, at = int(leaf[0]), rows[hit]
                for salt in range(salts.get((g, number), 1)):
                    yield g, at[(own[at] != number) | (done[at] != salt)], number, salt
        groups = batch.column("g").to_pandas()
        for g, rows in groups.groupby(groups).indices.items():
            for salt in range(salts.get((g, 0), 1) if g not in trees else 0):
                yield g, rows[done[rows] != salt], 0, salt

    def route(batches):
        total = {}
        for batch in batches:
            for g, at, leaf, salt in hits(batch):
                if not len(at):
                    continue
                if count:
                    total[g, leaf, salt] = total.get((g, leaf, salt), 0) + len(at)
                    continue
                part, n = batch.select(["qid", "vec", "bound"]).take(pa.array(at)), len(at)
                place = [pa.array([g] * n), pa.array(np.full(n, leaf, dtype=np.int64)), pa.array(np.full(n, salt, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays([*place, *part.columns], ["g", "leaf", "salt", "qid", "vec", "bound"])
        if total:
            g, leaf, salt = zip(*total)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(leaf, pa.int64()), pa.array(salt, pa.int32()), pa.array(total.values(), pa.int64())], ["g", "leaf", "salt", "n"])

    return near.select("g", "leaf", "salt", "qid", "vec", "bound").mapInArrow(route, fields)


def _ask_blocks(blocks: DataFrame, asked: DataFrame, counts: DataFrame, k: int, block_queries: int) -> DataFrame:
    """Answer queries (g, leaf, salt, qid, vec, bound) within their blocks; ``counts`` (g,
    leaf, salt, n) has their numbers, in any number of parts."""
    place = ["g", "leaf", "salt"]
    load = counts.groupBy(*place).agg(F.sum("n").alias("n"))
    # Crowded blocks are copied, one copy per share of their queries; blocks
    # nobody asks drop out.
    load = materialise(load.select(*place, F.ceil(F.col("n") / block_queries).cast("int").alias("shares")))
    shares = load.agg(F.sum("shares")).first()[0] or 0
    history = blocks.join(load, place).withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    ).drop("shares")
    queries = asked.join(load, place).withColumn(
        "share", F.pmod(F.xxhash64("qid", F.lit("share")), F.col("shares")).cast("int")
    ).drop("shares")
    entry = [f for f in history.schema.fields if f.name == "hist_id" or f.name.startswith("p_")]
    found = T.ArrayType(T.StructType([T.StructField("distance", T.DoubleType()), *entry]))
    schema = T.StructType([*queries.schema.fields, T.StructField("found", found)])
    at, whole = [*place, "share"], to_arrow_schema(schema)
    empty, kind = whole.empty_table(), whole.field("found").type
    # Spread by block and share; a join above may have left all shares together. A number
    # of tasks is given, because AQE would merge by bytes what is costly to compute. Up to
    # FEW_TASKS, Spark writes each straight to a file of its own; beyond, a writing task
    # holds its rows in memory, and there are few such tasks, as blocks are small on disk.
    cores = history.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(2 * int(shares), max(FEW_TASKS, 2 * cores)))
    return (
        history.repartition(tasks, *at)
        .groupBy(*at)
        .cogroup(queries.repartition(tasks, *at).groupBy(*at))
        .applyInArrow(
            lambda h, q: _nearest_in_block(h, q, k, kind) if len(h) and len(q) else empty,
            schema,
        )
        .drop("share")
    )


def dealt_by_rows(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of some number of rows dealt by ``keys`` over tasks of TASK_ROWS rows. AQE would
    merge by bytes on disk what is far larger in memory."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(-(-rows // TASK_ROWS), min(cores, 1 + 10 * rows // TASK_ROWS)), *keys)


def _without_extra_copies(points: DataFrame, k: int) -> DataFrame:
    """Points with at most k copies of each vector, those of the smallest ids.

    Counts of hashes, added up in each task before they move, find the vectors with more
    than k copies; two vectors of one hash are merely looked at. No other row is sorted.
    Copies are cut in shares of some COPY_ROWS rows first, so neither a task nor a share
    grows with them.
    """
    h = F.xxhash64("g", "vec")
    counts = points.select(h.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    shares = F.when(F.col("n") > COPY_ROWS, F.greatest(F.lit(COPY_SALTS), F.ceil(F.col("n") / COPY_ROWS))).otherwise(1)
    heavy = materialise(counts.filter(F.col("n") > k).withColumn("shares", shares))
    rows, kept = heavy.agg(F.sum("n"), F.sum(k * F.col("shares"))).first()
    if rows is None:
        return points
    known = points.withColumn("h", h)
    copies = known.join(heavy.drop("n"), "h").withColumn("share", F.pmod(F.xxhash64("hist_id"), "shares"))
    for few, at in ((rows, ["g", "vec", "share"]), (kept, ["g", "vec"])):
        first = F.row_number().over(Window.partitionBy(*at).orderBy("hist_id"))
        copies = dealt_by_rows(copies, few, *at).withColumn("copy", first).filter(F.col("copy") <= k).drop("copy")
    once = known.join(heavy, "h", "left_anti").select(*points.columns)
    return materialise(once.unionByName(copies.select(*points.columns)))


def _answer(points: DataFrame, asked: DataFrame, k: int, block_rows: int, block_queries: int) -> DataFrame:
    """Answer queries (g, qid, vec) block by block (steps 1 to 4), with lists (qid, found)
    in order of rank, one for each block visited."""
    points = _without_extra_copies(materialise(points), k)
    largest = F.max(F.greatest(F.array_max("vec"), -F.array_min("vec")))
    digits = F.lit(DIGITS) - F.floor(F.log10(F.greatest(largest, F.lit(1e-250))))
    groups = materialise(points.groupBy("g").agg(
        digits.cast("int").alias("digits"), F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims")
    ))
    rows, dims = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("dims"), F.lit(1))).first()
    most = max(1, BLOCK_BYTES // (8 * max(dims, 1)))
    block_rows, block_queries = min(block_rows, most), min(block_queries, most)
    trees = _fit_trees(points, rows, dims, k, block_rows)
    points = _with_leaf(points.join(groups.select("g", "digits"), "g"), trees)
    # Written, so that all passes see a row in the same leaf, however products round.
    points = materialise(points) if trees else points
    boxes = _fit_boxes(points, trees) if trees else {}
    leaf, place = ["g", "leaf"], ["g", "leaf", "salt"]
    salts = F.ceil(F.count(F.lit(1)) / block_rows).cast("int")
    cut = materialise(points.groupBy(*leaf).agg(salts.alias("salts")).filter("salts > 1"))

    def salted(df, key):
        salt = F.pmod(F.xxhash64(key), F.coalesce("salts", F.lit(1))).cast("int")
        return df.join(cut, leaf, "left").withColumn("salt", salt).drop("salts")

    blocks = salted(points, "hist_id")
    home = salted(_with_leaf(asked.join(groups.select("g"), "g"), trees, boxes), "qid")
    home = materialise(home.withColumn("bound", F.lit(float("inf"))))
    counts = home.groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    near = _ask_blocks(blocks, home, counts, k, block_queries)
    # Of the leaves that are cut into blocks there are fewer than blocks.
    several = {(r.g, r.leaf): r.salts for r in cut.collect()}
    if not trees and not several:
        return near.select("qid", "found")  # one block a group: there are no others to visit
    near = materialise(near)
    counts, visits = (_visits(near, trees, boxes, several, count) for count in (True, False))
    more = _ask_blocks(blocks, visits, counts, k, block_queries)
    return near.select("qid", "found").unionByName(more.select("qid", "found"))


def _told(named: DataFrame, asked: DataFrame, answers: DataFrame, k: int) -> DataFrame:
    """Rows (ids, qid) of ``named`` with the best k of their lists of ``answers`` (step 5).

    ``asked`` has the number n of rows of each query. The number of tasks is given by
    rows: AQE would merge by bytes on disk what is far larger in memory. A query of many
    rows has several copies of its answer, one for each share of the rows.
    """
    total = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cores = named.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-total // ASKED_ROWS), min(cores, 1 + 10 * total // ASKED_ROWS))
    often = materialise(asked.filter(F.col("n") > ASKED_ROWS).select("qid", F.ceil(F.col("n") / ASKED_ROWS).cast("int").alias("shares")))
    shares = F.coalesce("shares", F.lit(1))
    lists = answers.filter(F.size("found") > 0).repartition(tasks, "qid").groupBy("qid").agg(F.flatten(F.collect_list("found")).alias("found"))
    # Entries are ordered by their first fields, distance and id.
    lists = lists.withColumn("found", F.slice(F.array_sort("found"), 1, k))
    if not often.isEmpty():
        lists = lists.join(often, "qid", "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("shares")
        named = named.join(often, "qid", "left").withColumn("share", F.pmod(F.xxhash64("ids"), shares).cast("int")).drop("shares")
        lists, named = (df.repartition(tasks, "qid", "share") for df in (lists, named))
        return named.join(lists.hint("merge"), ["qid", "share"])
    return named.repartition(tasks, "qid").join(lists.hint("merge"), ["qid"])


def knn_join(
    history: DataFrame,
    queries: DataFrame,
    features: list[str],
    hist_id: str,
    query_id: str | list[str],
    k: int = 5,
    by: list[str] | None = None,
    payload: list[str] | None = None,
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """Rows (by, query id, hist_id, payload, rank, distance), rank 1..min(k, n).

    ``features`` are already scaled columns, or one array column. Ids are unique within
    a group; ties go to the smaller ``hist_id``. For vectors that cannot be compared
    see the module's notes. The size settings do not change the result.
    """
    by, payload = by or [], payload or []
    query_ids = [query_id] if isinstance(query_id, str) else query_id
    single = len(features) == 1 and isinstance(history.schema[features[0]].dataType, T.ArrayType)

    parts = None if single else [F.col(f).cast("double") for f in features]
    vec = F.col(features[0]).cast("array<double>") if single else F.array(*parts)
    points = history.filter(_usable(parts)) if parts is not None else history.withColumn("vec", vec).filter(_usable(None))
    points = points.withColumn("vec", vec).select(
        _group_key(by).alias("g"),
        "vec",
        F.col(hist_id).alias("hist_id"),
        *[F.col(c).alias(f"p_{c}") for c in payload],
    )
    named = queries.filter(_usable(parts)) if parts is not None else queries.withColumn("vec", vec).filter(_usable(None))
    named = named.withColumn("vec", vec).select(
        F.struct(*by, *query_ids).alias("ids"), _group_key(by).alias("g"), "vec"
    )
    halves = F.xxhash64("g", "vec"), F.xxhash64(F.lit(1), "vec", "g")
    named = materialise(named.withColumn("qid", F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in halves]))))
    # Equal questions have one number, so each is answered once.
    asked = materialise(named.groupBy("g", "qid", "vec").agg(F.count(F.lit(1)).alias("n")))
    answers = _answer(points, asked.drop("n"), k, block_rows, block_queries)
    told = _told(named.select("ids", "qid"), asked, answers, k)
    return told.select("ids", F.posexplode("found").alias("place", "entry")).select(
        "ids.*",
        F.col("entry.hist_id").alias(hist_id),
        *[F.col(f"entry.p_{c}").alias(c) for c in payload],
        (F.col("place") + 1).cast("int").alias("rank"),
        "entry.distance",
    )
