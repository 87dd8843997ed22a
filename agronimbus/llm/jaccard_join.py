"""N-gram Jaccard join by trees over count vectors.

The shingles of a text are hashed into groups; the counts per group are a point.
For two sets the summed minima of their points bound the size of the intersection
from above, and the minima of the largest corners of two tree nodes bound it for all
sets below them. Two sets link when 100 * |A and B| >= 75 * |A or B|, which needs an
intersection of at least 3/7 (|A| + |B|).

Boxes over all groups of unrelated texts of one size nearly coincide, so one tree over
all points would compare everything with everything. The points are therefore filed
first: sets that link share at least three quarters of the larger, hence one of the
first quarter (and one) of its shingles in any fixed order of shingles. Each such
shingle has trees of the sets filed under it, one per tile of TILE sets, loaded from
above into halves down to pages; two trees are walked down together. Frequent shingles
come last in the order, so that common passages file nothing unless a text consists of
little else.

Files of up to PAGE sets give all their pairs. In larger ones sets are joined to a few hubs
first, and the trees then only look for pairs of different components. That is exact:
every two sets of a file are in one component, or bounded away, or verified.

Copies (equal sets) are one class. Texts null or without words link with nothing and
are their own component. Rows with doc_id null take part; such a row alone has the
component null.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import materialise, new_folder
from .components import connected_components
from .shipping import ship
from .text import TEXTS_AT_ONCE, mixed, shingles

#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Sets of a file that gives all its pairs, and those that one side of a comparison holds.
PAGE, TILE = 32, 1_024
#: Sets that a page of a tree holds: corners of many sets reach as far as any set.
LEAF = 16
#: First files under which a row tells where else it is filed.
FILES = 8
#: A shingle that this many sets of one batch share may be frequent; so many are kept.
LOCAL_REPEATS, MOST_FREQUENT = 4, 100_000
#: Documents that are filed at once.
AT_ONCE = 2_048
#: Parts that a frequent shingle's file is dealt into.
SALTS = 64
#: Sets that those of a large file are compared with before all others, and how often.
HUBS, TURNS = 16, 2
#: Stands for a null doc_id where the smallest is sought.
NO_ID = (1 << 63) - 1


def group_count(n: np.ndarray | int) -> np.ndarray:
    """Groups that a set of n shingles is hashed into: a power of two near n / 2."""
    return np.left_shift(1, np.clip(np.ceil(np.log2(np.maximum(n, 1))) - 1, 4, 12).astype(np.int64))


def count_vector(hashes: np.ndarray) -> bytes:
    """Count per group, one byte each (four where a count needs more)."""
    groups = int(group_count(len(hashes)))
    counts = np.bincount((mixed(hashes) & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else "<u4").tobytes()


def folded(vectors: list[bytes], sizes: np.ndarray, groups: int) -> np.ndarray:
    """Vectors x groups; groups that agree modulo ``groups`` are added up."""
    out = np.empty((len(vectors), groups), np.int32)
    for row, v, own in zip(out, vectors, group_count(sizes).tolist()):
        counts = np.frombuffer(v, np.uint8 if len(v) == own else "<u4")
        row[:] = counts if own == groups else counts.reshape(-1, groups).sum(axis=0)
    return out


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least intersection of linked sets of these sizes."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def sizes_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def bounded(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, vectors: list[bytes]) -> np.ndarray:
    """Which index pairs the summed minima leave possible."""
    keep = sizes_fit(sizes[left], sizes[right])
    at = np.flatnonzero(keep)
    groups = np.minimum(group_count(sizes[left[at]]), group_count(sizes[right[at]]))
    for g in np.unique(groups):
        for part in np.array_split(at[groups == g], max(1, (groups == g).sum() * int(g) // (1 << 22))):
            rows, where = np.unique(np.concatenate([left[part], right[part]]), return_inverse=True)
            points = folded([vectors[i] for i in rows], sizes[rows], int(g))
            i, j = where[: len(part)], where[len(part) :]
            keep[part] = np.minimum(points[i], points[j]).sum(axis=1) >= needed(sizes[left[part]], sizes[right[part]])
    return keep


class Node:
    """A node of a count-vector R-tree: its sets, the corner of their points, their range of sizes.

    Bulk-loaded from above: halves, whole pages each, by size while sizes alone can keep
    sets apart, else by the group whose counts differ the most. Nodes of at most LEAF
    sets are pages and keep the points.
    """

    def __init__(self, sets: np.ndarray, sizes: np.ndarray, vectors: list[bytes]):
        own = sizes[sets]
        self.sets, self.low, self.high = sets, int(own.min()), int(own.max())
        self.points = folded([vectors[i] for i in sets], own, int(group_count(self.low)))
        self.corner, self.children = self.points.max(axis=0), ()
        if len(sets) > LEAF:
            apart = 100 * self.low < PERCENT * self.high
            order = sets[np.argsort(own if apart else self.points[:, self.points.var(axis=0).argmax()], kind="stable")]
            half = -(-len(sets) // LEAF) // 2 * LEAF
            self.points, self.children = None, (Node(order[:half], sizes, vectors), Node(order[half:], sizes, vectors))

    def may_link(self, other: Node) -> bool:
        """Whether sizes and the summed minima of the corners leave a link possible."""
        if 100 * self.high < PERCENT * other.low or 100 * other.high < PERCENT * self.low:
            return False
        groups = min(len(self.corner), len(other.corner))
        reach = np.minimum(self.corner.reshape(-1, groups).sum(axis=0), other.corner.reshape(-1, groups).sum(axis=0)).sum()
        return bool(reach >= needed(np.int64(self.low), np.int64(other.low)))


def near_pages(one: Node, other: Node) -> Iterator[tuple[Node, Node]]:
    """Pairs of pages, one below each node, that no pair of corners above them rules out."""
    rest = [(one, other)]
    while rest:
        x, y = rest.pop()
        if x is not y and not x.may_link(y):
            continue
        if not x.children and not y.children:
            yield x, y
        elif x is y:
            u, v = x.children
            rest += [(u, u), (u, v), (v, v)]
        elif len(x.sets) >= len(y.sets):
            rest += [(u, y) for u in x.children]
        else:
            rest += [(x, v) for v in y.children]


def tree_pairs(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, vectors: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs, one of each side, that node corners and summed minima leave possible.

    Each side is one tree; both are walked down together. ``left is right`` asks for
    pairs inside one side, each once.
    """
    found_i, found_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(left) and len(right):
        one = Node(left, sizes, vectors)
        other = one if left is right else Node(right, sizes, vectors)
        for x, y in near_pages(one, other):
            p, q = x.sets, y.sets
            groups = min(x.points.shape[1], y.points.shape[1])
            a, b = (v.points.reshape(len(v.points), -1, groups).sum(axis=1) for v in (x, y))
            reach = np.minimum(a[:, None], b[None]).sum(axis=2)
            fits = (reach >= needed(sizes[p][:, None], sizes[q][None])) & sizes_fit(sizes[p][:, None], sizes[q][None])
            i, j = np.nonzero(np.triu(fits, 1) if x is y else fits)
            found_i.append(p[i])
            found_j.append(q[j])
    return np.concatenate(found_i), np.concatenate(found_j)


def repeated(sets: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that at least so many of the sets hold, ascending, and how many do. Empties ``sets``."""
    every = np.concatenate([np.empty(0, np.uint64), *sets])
    sets.clear()
    every.sort()
    found = every[least - 1 :][every[least - 1 :] == every[: max(len(every) - least + 1, 0)]]
    found = found[np.r_[True, found[1:] != found[:-1]][: len(found)]]
    return found, np.searchsorted(every, found, "right") - np.searchsorted(every, found, "left")


def shingle_sets(docs: DataFrame, text: str = "text") -> tuple[DataFrame, np.ndarray]:
    """(doc_id, key, n, cls, counts) of each document, and the frequent shingles.

    cls is a hash of the set (null without words), key one of the row. The frequent
    shingles are those repeated most inside batches, most frequent last; they only
    set the order of filing, no result depends on them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[int] = set()
            sets: list[np.ndarray] = []
            n, cls, counts = [], [], []
            texts = (b.column("text").slice(i, TEXTS_AT_ONCE) for i in range(0, b.num_rows, TEXTS_AT_ONCE))
            for x in chain.from_iterable(part.to_pylist() for part in texts):
                found = shingles(x)
                n.append(len(found))
                c = xxhash.xxh3_64_intdigest(found.tobytes()) if len(found) else None
                cls.append(None if c is None else c - (1 << 64) * (c >> 63))
                counts.append(count_vector(found) if len(found) else None)
                if c is not None and c not in seen:
                    seen.add(c)
                    sets.append(found)
            often, times = repeated(sets, LOCAL_REPEATS)
            yield pa.record_batch(
                [
                    pa.array([False] * len(n) + [True] * len(often), pa.bool_()),
                    pa.concat_arrays([b.column("doc_id").cast(pa.int64()), pa.nulls(len(often), pa.int64())]),
                    pa.concat_arrays([b.column("key"), pa.nulls(len(often), pa.int64())]),
                    pa.concat_arrays([pa.array(n, pa.int64()), pa.array(times, pa.int64())]),
                    pa.concat_arrays([pa.array(cls, pa.int64()), pa.array(often.view(np.int64), pa.int64())]),
                    pa.concat_arrays([pa.array(counts, pa.binary()), pa.nulls(len(often), pa.binary())]),
                ],
                ["frequent", "doc_id", "key", "n", "cls", "counts"],
            )

    rows = _keyed(docs, text).mapInArrow(run, "frequent boolean, doc_id bigint, key bigint, n bigint, cls bigint, counts binary")
    both = materialise(rows)
    often = both.filter("frequent").groupBy("cls").agg(F.sum("n").alias("times"))
    often = often.orderBy(F.col("times").desc(), "cls").limit(MOST_FREQUENT).select("cls").toArrow()
    # At most MOST_FREQUENT numbers, whatever the corpus.
    ranked = often.column("cls").to_numpy().view(np.uint64)[::-1].copy()
    return both.filter("not frequent").drop("frequent"), ranked


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    shown = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), shown, row_key(docs, text).alias("key"))


def first_shingles(found: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles a set is filed under; ``order``: frequent ones sorted, ``rank``: their ranks."""
    first = len(found) - (-(-PERCENT * len(found) // 100)) + 1
    usual, late = found, found[:0]
    if len(order):
        at = np.searchsorted(order, found)
        at[at == len(order)] = 0
        known = order[at] == found
        late = found[known][np.argsort(rank[at[known]])]
        usual = found[~known]
    if len(usual) > first:  # the numbers compared are as different as the shingles
        usual = usual[np.argpartition(mixed(usual), first - 1)[:first]]
    return np.concatenate([usual, late[: first - len(usual)]])


def filed_sets(docs: DataFrame, frequent: np.ndarray, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pairs of sets that share a file, and the files too large for that.

    A file of up to PAGE sets gives its pairs (a, b) whose sizes allow a link. Larger ones, and
    those of frequent shingles, give rows (grp, cls, n), n being a set's size. Files are
    gathered once, in order, and a task holds one batch of rows at a time; files of
    frequent shingles are dealt out in SALTS parts.
    """
    by_value = np.argsort(frequent)
    order, rank = frequent[by_value], by_value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Few documents at a time: what is gathered of them is all that a worker holds.
        parts = (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE))
        for b in parts:
            groups, classes, sizes, seen = [], [], [], set()
            for x in b.column("text").to_pylist():
                found = shingles(x)
                c = xxhash.xxh3_64_intdigest(found.tobytes())
                if len(found) and c not in seen:
                    seen.add(c)
                    first = first_shingles(found, order, rank)
                    groups.append(first)
                    classes.append(np.full(len(first), c, np.uint64))
                    sizes.append(np.full(len(first), len(found), np.int32))
            if groups:
                g, c = np.concatenate(groups), np.concatenate(classes)
                known = np.isin(g, order) if len(order) else np.zeros(len(g), bool)
                salt = np.where(known, 1 + (c % np.uint64(SALTS)).astype(np.int32), 0).astype(np.int32)
                yield pa.record_batch(
                    [pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), pa.array(np.concatenate(sizes)), pa.array(salt)],
                    ["grp", "cls", "n", "salt"],
                )

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["grp", "salt", "cls", "n"]
        held = {k: np.empty(0, np.int64) for k in names}  # rows of a file that may not be whole
        going: tuple | None = None  # a large file whose rows still come
        for b in chain(batches, [None]):
            rows = held if b is None else {k: np.concatenate([held[k], b.column(k).to_numpy()]) for k in names}
            held = {k: v[:0] for k, v in rows.items()}
            if not len(rows["grp"]):
                continue
            same = (rows["grp"][1:] == rows["grp"][:-1]) & (rows["salt"][1:] == rows["salt"][:-1])
            fresh = np.r_[True, ~(same & (rows["cls"][1:] == rows["cls"][:-1]))]
            start = np.r_[True, ~same][fresh]
            rows = {k: v[fresh] for k, v in rows.items()}
            run, first = np.cumsum(start) - 1, np.flatnonzero(start)
            size = np.diff(np.r_[first, len(run)])
            large = (size > PAGE) | (rows["salt"][first] > 0)
            large[0] |= going == (rows["grp"][0], rows["salt"][0])
            going = None
            ready = np.ones(len(run), bool)
            if b is not None and large[-1]:
                going = (rows["grp"][-1], rows["salt"][-1])
            elif b is not None:
                ready = run < run[-1]
                held = {k: v[~ready] for k, v in rows.items()}
            a = np.flatnonzero(ready & large[run])
            found = rows["grp"][a], rows["cls"][a], rows["n"][a]
            small = ready & ~large[run]
            pairs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for d in range(1, min(PAGE, len(run))):
                i = np.flatnonzero((run[d:] == run[:-d]) & small[d:])
                i = i[sizes_fit(rows["n"][i], rows["n"][i + d])]
                pairs[0].append(rows["cls"][i])  # the smaller one: rows are sorted
                pairs[1].append(rows["cls"][i + d])
            left, right = map(np.concatenate, pairs)
            order = np.lexsort((right, left))
            left, right = left[order], right[order]
            new = np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])][: len(left)]
            left, right = left[new], right[new]
            columns = [np.concatenate([x, y]).astype(np.int64) for x, y in zip(found, (right, left, 0 * left))]
            is_pair = np.r_[np.zeros(len(a), bool), np.ones(len(left), bool)]
            yield pa.record_batch([pa.array(is_pair), *map(pa.array, columns)], ["pair", "grp", "cls", "n"])

    filed = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(
        run, "grp bigint, cls bigint, n int, salt int"
    )
    rows = filed.repartition("grp", "salt").sortWithinPartitions("grp", "salt", "cls")
    both = materialise(rows.mapInArrow(shared, "pair boolean, grp bigint, cls bigint, n bigint"))
    return both.filter("pair").select(F.col("cls").alias("a"), F.col("grp").alias("b")), both.filter("not pair").drop("pair")


def _bound_stage(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that the summed minima of their count vectors leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.num_rows
            sizes = np.concatenate([b.column("n_a").to_numpy(), b.column("n_b").to_numpy()])
            vectors = b.column("v_a").to_pylist() + b.column("v_b").to_pylist()
            keep = bounded(np.arange(k), np.arange(k, 2 * k), sizes, vectors)
            yield b.select(["a", "b", "key_a", "key_b"]).filter(pa.array(keep))

    for side in "ab":
        known = classes.select(
            F.col("cls").alias(f"_{side}"), F.col("least.key").alias(f"key_{side}"), F.col("n").alias(f"n_{side}"), F.col("counts").alias(f"v_{side}")
        )
        pairs = pairs.join(known, F.col(side) == F.col(f"_{side}")).drop(f"_{side}")
    rows = pairs.select("a", "b", "key_a", "key_b", "n_a", "n_b", "v_a", "v_b")
    return rows.mapInArrow(run, "a bigint, b bigint, key_a bigint, key_b bigint")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link.

    ``pairs``: a, b, key_a, key_b; ``texts``: key, text, in buckets by key, so that only
    pairs move.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for b in batches:
            keep = []
            for a, x, y in zip(b.column("a").to_pylist(), b.column("text_a"), b.column("text_b")):
                if a != last:
                    last, own = a, shingles(x.as_py())
                other = shingles(y.as_py())
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(own) + len(other) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs
    for side in "ba":
        there = texts.select(F.col("key").alias(f"_{side}"), F.col("text").alias(f"text_{side}"))
        both = both.join(there, F.col(f"key_{side}") == F.col(f"_{side}")).drop(f"_{side}")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _open_files(filed: DataFrame, labels: DataFrame) -> DataFrame:
    """(grp, cls, n, comp, k) of the files with two components or more; k is their size."""
    rows = filed.select("grp", "cls", "n").join(labels.withColumnRenamed("cls", "_cls"), F.col("cls") == F.col("_cls"), "left")
    rows = rows.select("grp", "cls", "n", F.coalesce("comp", "cls").alias("comp"))
    files = rows.groupBy(F.col("grp").alias("_grp")).agg(F.count("cls").alias("k"), F.min("comp").alias("_x"), F.max("comp").alias("_y"))
    files = files.filter("_x <> _y").select("_grp", "k")
    return materialise(rows.join(files, F.col("grp") == F.col("_grp")).select("grp", "cls", "n", "comp", "k"))


def _hub_pairs(files: DataFrame, turn: int) -> DataFrame:
    """(a, b): each set with the HUBS sets that come first in one of its files.

    Which file and which sets is drawn by a hash that differs from turn to turn but not
    from file to file, so that sets with many common files meet the same hubs. Only
    sets of different components, whose sizes allow a link, are paired.
    """
    draw = F.xxhash64("cls", F.lit(turn))
    hubs = files.withColumn("_rank", F.row_number().over(Window.partitionBy("grp").orderBy(draw))).filter(F.col("_rank") <= HUBS)
    hubs = hubs.select(F.col("grp").alias("_grp"), F.col("cls").alias("hub"), F.col("n").alias("n_hub"), F.col("comp").alias("_comp"))
    one = files.groupBy("cls").agg(F.min_by("grp", F.xxhash64("grp", F.lit(turn))).alias("grp"), F.first("n").alias("n"), F.first("comp").alias("comp"))
    fits = 100 * F.least("n", "n_hub") >= PERCENT * F.greatest("n", "n_hub")
    pairs = one.join(hubs, (F.col("grp") == F.col("_grp")) & (F.col("comp") != F.col("_comp")) & fits)
    return pairs.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b"))


def _tiles(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of every tile pair of open files: what the trees need."""
    first = _first_files(rows)
    known = classes.select(F.col("cls").alias("_cls"), F.col("least.key").alias("key"), "counts").join(first, F.col("_cls") == F.col("_c")).drop("_c")
    rows = rows.select("grp", "cls", "n", "comp", F.ceil(F.col("k") / TILE).cast("int").alias("tiles"))
    rows = rows.join(known, F.col("cls") == F.col("_cls")).drop("_cls")
    rows = rows.withColumn("t", F.pmod(F.xxhash64("cls", "grp"), F.col("tiles")).cast("int"))
    # Each tile meets the later ones and itself; with one tile that is one row.
    meets = F.explode(F.expr("transform(sequence(0, tiles - 1), o -> struct(least(t, o) as i, greatest(t, o) as j))")).alias("at")
    rows = rows.select("grp", meets, "t", "cls", "comp", "n", "key", "counts", "files")
    return rows.select("grp", "at.i", "at.j", "t", "cls", "comp", "n", "key", "counts", "files")


def _first_files(rows: DataFrame) -> DataFrame:
    """Of each set its FILES smallest files (a set is filed a bounded number of times)."""
    files = rows.groupBy(F.col("cls").alias("_c")).agg(F.array_sort(F.collect_set("grp")).alias("files"))
    return files.select("_c", F.slice("files", 1, FILES).alias("files"))


def _search(tiles: DataFrame) -> DataFrame:
    """Pairs of different components that the trees leave possible, as far as can be told once."""

    def block(rows: dict[str, np.ndarray], vectors: list[bytes], files: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes, comp, t, j = rows["n"], rows["comp"], rows["t"], rows["j"]
        tile = rows["tile"]
        starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
        ends = np.r_[starts[1:], len(tile)]
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        small = np.repeat(ends - starts <= PAGE, ends - starts)
        for d in range(1, PAGE):
            i = np.flatnonzero((tile[d:] == tile[:-d]) & small[d:]) if len(tile) > d else np.empty(0, np.int64)
            i = i[(comp[i] != comp[i + d]) & ((rows["i"][i] == j[i]) | (t[i] != t[i + d]))]
            left.append(i)
            right.append(i + d)
        a, b = np.concatenate(left), np.concatenate(right)
        keep = bounded(a, b, sizes, vectors)
        found = [(a[keep], b[keep])]
        for s, e in zip(starts[ends - starts > PAGE], ends[ends - starts > PAGE]):
            here = np.arange(s, e)
            if rows["i"][s] == j[s]:
                x, y = tree_pairs(here, here, sizes, vectors)
            else:
                x, y = tree_pairs(here[t[here] == rows["i"][s]], here[t[here] == j[s]], sizes, vectors)
            other = comp[x] != comp[y]
            found.append((x[other], y[other]))
        a, b = (np.concatenate(z) for z in zip(*found))
        grp = rows["grp"]
        # A pair is told in the first file that both name, if that comes before this one.
        once = [not any(f < g for f in set(files[x]).intersection(files[y])) for x, y, g in zip(a, b, grp[a].tolist())]
        return a[once], b[once]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        told: set[tuple] = set()

        def out(table: pa.Table) -> pa.RecordBatch:
            rows = {c: table.column(c).to_numpy() for c in ("grp", "i", "j", "t", "cls", "comp", "n", "key")}
            change = np.zeros(len(rows["grp"]), bool)
            for c in ("grp", "i", "j"):
                change[1:] |= rows[c][1:] != rows[c][:-1]
            rows["tile"] = np.cumsum(change)
            a, b = block(rows, table.column("counts").to_pylist(), table.column("files").to_pylist())
            a, b = np.where(rows["cls"][a] < rows["cls"][b], a, b), np.where(rows["cls"][a] < rows["cls"][b], b, a)
            pairs = set(zip(*(rows[c][i].tolist() for c in ("cls", "key") for i in (a, b)))) - told
            if len(told) > 500_000:
                told.clear()
            told.update(pairs)
            columns = list(zip(*pairs)) or [()] * 4
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["a", "b", "key_a", "key_b"])

        for b in batches:
            new = pa.Table.from_batches([b])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows < 4 * TILE:
                continue
            at = np.stack([held.column(c).to_numpy() for c in ("grp", "i", "j")])
            change = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0))
            if len(change):
                yield out(held.slice(0, change[-1] + 1))
                held = held.slice(change[-1] + 1)
        if held is not None and held.num_rows:
            yield out(held)

    return tiles.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "cls").mapInArrow(
        run, "a bigint, b bigint, key_a bigint, key_b bigint"
    )


class Buckets:
    """A table written in buckets by ``key``: joins by the key leave it where it is."""

    def __init__(self, df: DataFrame, key: str):
        self.spark, self.name = df.sparkSession, f"agronimbus_{uuid.uuid4().hex}"
        count = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(count, key).option("path", new_folder(self.spark)).saveAsTable(self.name)
        self.table = self.spark.table(self.name)

    def drop(self) -> None:
        """Forget the name; the files go with the session's other tables."""
        self.spark.sql(f"DROP TABLE {self.name}")


def row_key(docs: DataFrame, text: str = "text") -> Column:
    """The row_key of a document, from its doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce(F.col(text).cast("string"), F.lit("")))


def _labels(links: DataFrame) -> DataFrame:
    found = connected_components(links)
    return materialise(found.select(F.col("node").alias("cls"), F.col("component").alias("comp")))


def jaccard_components(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, row_key.

    ``docs``: doc_id and the text column. component_id is the smallest doc_id that can
    be reached by links. kept marks one row of each component, that with its
    component_id (of equal doc_ids the least row_key, a hash of doc_id and text; equal
    rows share the mark), and every row without words.
    """
    ship(docs.sparkSession)
    sets, frequent = shingle_sets(docs, text)
    worded = sets.filter("cls is not null")
    place = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("key").alias("key"))
    classes = materialise(
        worded.groupBy("cls").agg(F.min(place).alias("least"), F.first("n").alias("n"), F.first("counts").alias("counts"))
    )
    pairs, large = filed_sets(docs, frequent, text)
    # The pairs of small files, and of large ones first each set with its hub.
    hubs = _hub_pairs(large.withColumn("comp", F.col("cls")), 0)
    first = materialise(_bound_stage(pairs.unionByName(hubs).distinct(), classes))
    keys = classes.select("cls", F.col("least.key").alias("_key")).join(large.select("cls").distinct(), "cls").select("_key")
    keys = keys.unionByName(first.select(F.explode(F.array("key_a", "key_b")).alias("_key"))).distinct()
    # Joined and thinned by the same key, so that texts are shuffled once.
    texts = _keyed(docs, text).select("key", "text").join(keys, F.col("key") == F.col("_key"), "left_semi")
    texts = Buckets(texts.select("key", "text").dropDuplicates(["key"]), "key")

    # Of the large files then hubs of what is still apart, and all the rest by trees.
    links = materialise(verified(first, texts.table))
    still_open = _open_files(large, _labels(links))
    for turn in range(1, TURNS):
        more = materialise(verified(_bound_stage(_hub_pairs(still_open, turn).distinct(), classes), texts.table))
        links = links.unionByName(more)
        still_open = _open_files(still_open, _labels(links))
    rest = materialise(_search(_tiles(still_open, classes)).distinct())
    labels = _labels(links.unionByName(materialise(verified(rest, texts.table))))
    texts.drop()

    member = classes.select("cls", "least").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    first = member.groupBy(F.col("comp").alias("_comp")).agg(F.min("least").alias("first"))
    member = member.join(first, F.col("comp") == F.col("_comp")).select(F.col("cls").alias("_cls"), "first")
    placed = sets.select("doc_id", "key", "n", "cls").join(member, F.col("cls") == F.col("_cls"), "left")
    return placed.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.nullif("first.id", F.lit(NO_ID))).alias("component_id"),
        F.coalesce(F.col("key") == F.col("first.key"), F.lit(True)).alias("kept"),
        F.col("key").alias("row_key"),
    )


def document_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


QUERY = ("op2_jaccard_join", document_components)
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared WHERE 100 * k >= 75 * (n + m - k)),
ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.other)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""
