import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from agronimbus.operators import neighbours as N
from agronimbus.operators.neighbours import knn_join


def brute(history, queries, k):
    """history: (g, id, vector); queries: (g, id, vector)."""
    out = []
    for g, qid, q in queries:
        largest = max((abs(x) for gg, _, h in history if gg == g for x in h), default=1)
        digits = N.DIGITS - math.floor(math.log10(largest or 1e-250))
        near = sorted(
            (round(float(np.sqrt(sum((a - b) ** 2 for a, b in zip(h, q)))), digits), hid) for gg, hid, h in history if gg == g
        )
        out += [(g, qid, hid, i + 1, d) for i, (d, hid) in enumerate(near[:k])]
    return sorted(out)


def run(spark, history, queries, k, **sizes):
    names = [f"x{i}" for i in range(len(history[0][2]))]
    cols = ", ".join(f"{n} double" for n in names)
    h = spark.createDataFrame([(g, i, *map(float, v)) for g, i, v in history], f"crop string, hid long, {cols}")
    q = spark.createDataFrame([(g, i, *map(float, v)) for g, i, v in queries], f"crop string, qid long, {cols}")
    found = knn_join(h, q, names, "hid", "qid", k, ["crop"], **sizes).collect()
    return sorted((r.crop, r.qid, r.hid, r["rank"], r.distance) for r in found)


SIZES = [
    {},  # one block per group
    {"block_rows": 40, "block_queries": 7},  # leaves and shares
    {"block_rows": 11, "block_queries": 500},
]


@pytest.fixture(params=[None, 8])
def sample(request, monkeypatch):
    """With so few sampled bytes no tree can be fitted, and groups are cut by hash only."""
    if request.param:
        monkeypatch.setattr(N, "SAMPLE_BYTES", request.param)


@pytest.mark.parametrize("sizes", SIZES)
def test_every_way_gives_the_brute_force_rows(spark, sizes, sample):
    rng = np.random.default_rng(7)
    spread = rng.normal(size=(300, 3)).round(2)
    copies = np.tile([[0.5, 0.5, 0.5]], (150, 1))  # one point is a third of the rows
    far = np.array([[50.0, 0, 0], [0, -80, 3]])
    points = np.vstack([spread, copies, far])
    history = [("a" if i % 5 else "b", int(i), tuple(p)) for i, p in enumerate(points)]
    asked = np.vstack([rng.normal(size=(60, 3)).round(2), np.tile([[0.5, 0.5, 0.5]], (30, 1)), [[200.0, 0, 0]]])
    queries = [("a" if i % 2 else "b", int(i), tuple(p)) for i, p in enumerate(asked)]
    assert run(spark, history, queries, 5, **sizes) == brute(history, queries, 5)


@pytest.mark.parametrize("sizes", SIZES)
def test_ties_go_to_the_smaller_id_and_k_is_cut_to_the_group(spark, sizes):
    history = [("a", 9, (1.0,)), ("a", 2, (-1.0,)), ("a", 5, (1.0,)), ("b", 1, (0.0,))]
    queries = [("a", 1, (0.0,)), ("b", 1, (3.0,)), ("c", 1, (0.0,))]
    assert run(spark, history, queries, 5, **sizes) == [
        ("a", 1, 2, 1, 1.0), ("a", 1, 5, 2, 1.0), ("a", 1, 9, 3, 1.0), ("b", 1, 1, 1, 3.0),
    ]


def test_partitioning_does_not_change_rows(spark):
    rng = np.random.default_rng(3)
    h = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(400, 2)))], "hid long, x double, y double")
    q = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(20, 2)))], "qid long, x double, y double")
    got = [
        sorted(map(tuple, knn_join(h.repartition(n), q.repartition(n), ["x", "y"], "hid", "qid", 4).collect())) for n in (1, 7)
    ]
    assert got[0] == got[1] and len(got[0]) == 80


def test_payload_travels_with_the_neighbour(spark):
    h = spark.createDataFrame([("k1", 0.0, 1), ("k2", 5.0, 0)], "hid string, x double, result int")
    q = spark.createDataFrame([(1, 4.0)], "qid int, x double")
    for sizes in SIZES:
        out = knn_join(h, q, ["x"], "hid", "qid", 1, payload=["result"], **sizes).collect()
        assert [(r.qid, r.hid, r.result, r.distance) for r in out] == [(1, "k2", 0, 1.0)]


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(st.integers(-4, 4), st.integers(-4, 4)), min_size=1, max_size=120),
    st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=20),
    st.integers(1, 7),
)
def test_search_in_a_block_is_exact(points, asked, k):
    before = N.PAIRS_AT_ONCE
    N.PAIRS_AT_ONCE = 50
    try:
        p, q = np.array(points, dtype=float), np.array(asked, dtype=float)
        row, col, dist = N._nearest(p, q, k, 9)
    finally:
        N.PAIRS_AT_ONCE = before
    got = sorted(zip(row.tolist(), col.tolist(), dist.tolist()))
    full = np.round(np.sqrt(((q[:, None, :] - p[None, :, :]) ** 2).sum(axis=2)), 9)
    wanted = []
    for i in range(len(q)):
        order = sorted(range(len(p)), key=lambda j: (full[i, j], j))[:k]
        wanted += [(i, j, full[i, j]) for j in order]
    assert got == sorted(wanted)


def test_vectors_that_cannot_be_compared(spark):
    nan, inf = float("nan"), float("inf")
    schema = "id long, v array<double>"
    h = spark.createDataFrame([(1, [1.0, 2.0]), (2, [None, 1.0]), (3, [nan, 4.0]), (4, [9.0, 9.0]), (5, None), (6, []), (7, [1.0]), (8, [inf, 0.0])], schema)
    q = spark.createDataFrame([(10, [1.0, 2.0]), (11, None), (12, [None, 1.0]), (13, [2.0]), (14, [nan, 1.0]), (15, [])], schema)
    for sizes in SIZES:
        out = knn_join(h.withColumnRenamed("id", "hid"), q.withColumnRenamed("id", "qid"), ["v"], "hid", "qid", 3, **sizes).collect()
        assert sorted((r.qid, r.hid) for r in out) == [(10, 1), (10, 4), (13, 7)]


@pytest.mark.parametrize("scale", [1e-10, 1e-3, 1.0, 1e12])
def test_scale_does_not_change_who_is_near(spark, scale):
    history = [("a", 1, (9 * scale, 0.0)), ("a", 2, (3 * scale, 0.0)), ("a", 3, (1 * scale, 0.0))]
    for sizes in SIZES:
        assert [r[2] for r in run(spark, history, [("a", 1, (1 * scale, 0.0))], 1, **sizes)] == [3]


def test_a_block_of_equal_points_needs_little_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    points = np.vstack([np.tile([[1.0, 2.0, 3.0]], (18_000, 1)), rng.normal(size=(2_000, 3))])
    asked = rng.normal(size=(400, 3))
    tracemalloc.start()
    row, col, dist = N._nearest(points, asked, 5, 9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(row) == 2_000 and peak < 250e6


def test_copies_of_a_point_are_cut_before_the_search(spark):
    history = [("a", i, (0.0, 0.0)) for i in range(3_000)] + [("a", 5_000 + i, (float(i), 1.0)) for i in range(50)]
    queries = [("a", i, (0.1 * i, 0.0)) for i in range(20)]
    for sizes in SIZES:
        assert run(spark, history, queries, 3, **sizes) == brute(history, queries, 3)


def test_clusters_of_many_features_are_pruned():
    from agronimbus.operators import neighbours as N

    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    middles = rng.normal(size=(40, 64)) * np.r_[np.full(4, 30.0), np.full(60, 0.01)] @ turn
    points = (middles[:, None] + rng.normal(size=(40, 100, 64)) * 0.05).reshape(-1, 64)
    axes, tree = N._fitted(points[::3], 64, 8)
    leaf = N._leaf_of(tree, points @ axes)
    asked = points[::7] + 0.01
    exact = np.sqrt(((asked[:, None] - points[None]) ** 2).sum(axis=2))
    bound = np.sort(exact, axis=1)[:, 4] + 1e-9
    visits = {(r, v) for rows, leaves in N._leaves_within(tree, asked @ axes, bound) for r, v in zip(rows.tolist(), leaves.tolist())}
    near = {(i, int(leaf[j])) for i, j in zip(*np.nonzero(exact <= bound[:, None] - 1e-9))}
    assert near <= visits  # no neighbour lies in a leaf that is not visited
    assert len(np.unique(leaf)) > 30 and len(visits) < 0.1 * len(asked) * len(np.unique(leaf))


def test_only_rows_of_vectors_with_more_than_k_copies_are_sorted(spark, rows):
    from agronimbus.operators import neighbours as N

    points = rows([("g", [float(i), 0.0], i) for i in range(50)] + [("g", [1.0, 0.0], 100 + i) for i in range(300)], "g string, vec array<double>, hist_id int")
    kept = N._without_extra_copies(points, 3).collect()
    copies = sorted(r.hist_id for r in kept if r.vec == [1.0, 0.0])
    assert copies[:3] == [1, 100, 101] and len(copies) <= 3 * N.COPY_SALTS and len(kept) == 49 + len(copies)
    light = points.filter("hist_id < 50")
    assert N._without_extra_copies(light, 3) is light


def test_shares_of_blocks_are_not_written_through_memory(spark):
    """Beyond 200 partitions a task holds what it writes: blocks times shares, from few tasks."""
    import re

    rng = np.random.default_rng(11)
    h = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(900, 2)))], "hid long, x double, y double")
    q = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(300, 2)))], "qid long, x double, y double")
    found = knn_join(h, q, ["x", "y"], "hid", "qid", 2, block_rows=4, block_queries=1)
    plan = found._jdf.queryExecution().toString()
    assert max(map(int, re.findall(r"hashpartitioning\([^\n]*, (\d+)\)", plan))) <= 200
    assert "BroadcastExchange" not in plan or not re.search(r"Join \[qid[^\n]*BuildLeft|Join \[qid[^\n]*BuildRight", plan)


def test_queries_far_from_all_rows_visit_few_leaves():
    rng = np.random.default_rng(12)
    points = rng.normal(size=(4_000, 3))
    axes, tree = N._fitted(points, 64, 8)
    turned = points @ axes
    leaf = N._leaf_of(tree, turned)
    boxes = N._node_boxes(tree, {int(n): (turned[leaf == n].min(axis=0), turned[leaf == n].max(axis=0)) for n in np.unique(leaf)})
    asked = rng.normal(size=(50, 3)) * 40
    exact = np.sqrt(((asked[:, None] - points[None]) ** 2).sum(axis=2))
    bound = np.sort(exact, axis=1)[:, 4] + 1e-9
    visits = {(r, v) for rows, leaves in N._leaves_within(tree, asked @ axes, bound, boxes) for r, v in zip(rows.tolist(), leaves.tolist())}
    near = {(i, int(leaf[j])) for i, j in zip(*np.nonzero(exact <= bound[:, None] - 1e-9))}
    assert near <= visits and len(visits) < 0.15 * len(asked) * len(np.unique(leaf))
    unbounded = sum(len(rows) for rows, _ in N._leaves_within(tree, asked @ axes, bound))
    assert len(visits) < unbounded / 2
    assert set(N._nearest_leaf(tree, asked @ axes, boxes).tolist()) <= set(leaf.tolist())


@pytest.mark.parametrize("dims", [1, 3, 20])
def test_small_leaves_inside_a_block_lose_no_neighbour(dims):
    rng = np.random.default_rng(13)
    points = np.vstack([rng.normal(size=(3_000, dims)).round(1), np.zeros((1_500, dims))])
    asked = np.vstack([rng.normal(size=(40, dims)).round(1), rng.normal(size=(10, dims)) * 100, np.zeros((2, dims))])
    row, col, dist = N._nearest(points, asked, 5, 9)
    full = np.round(np.sqrt(((asked[:, None] - points[None]) ** 2).sum(axis=2)), 9)
    wanted = [(i, j) for i in range(len(asked)) for j in np.lexsort((np.arange(len(points)), full[i]))[:5].tolist()]
    assert list(zip(row.tolist(), col.tolist())) == wanted
    bound = full[row, col].reshape(-1, 5)[:, 4]
    again = N._nearest(points, asked, 5, 9, N._beyond(bound, 9))
    assert list(zip(again[0].tolist(), again[1].tolist())) == wanted


def test_spread_alike_in_all_directions_is_cut_along_the_features():
    """Queries beyond a side of a cube reach the leaves at that side only."""
    rng = np.random.default_rng(14)
    points = rng.uniform(-1, 1, size=(16_000, 3))
    axes, tree = N._fitted(points[::4], 32, 8)
    turned = points @ axes
    leaf = N._leaf_of(tree, turned)
    boxes = N._node_boxes(tree, {int(n): (turned[leaf == n].min(axis=0), turned[leaf == n].max(axis=0)) for n in np.unique(leaf)})
    asked = np.column_stack([rng.uniform(2, 6, 200), rng.uniform(-1, 1, (200, 2))])
    exact = np.sqrt(((asked[:, None] - points[None]) ** 2).sum(axis=2))
    bound = N._beyond(exact.min(axis=1), 9)
    visits = [(r, v) for rows, leaves in N._leaves_within(tree, asked @ axes, bound, boxes) for r, v in zip(rows.tolist(), leaves.tolist())]
    assert set(zip(range(200), leaf[exact.argmin(axis=1)].tolist())) <= set(visits)
    assert len(visits) < 3 * len(asked)


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 20, "block_queries": 30}])
def test_answers_meet_bounded_shares_of_the_rows_that_asked(spark, monkeypatch, sizes):
    """Also where most rows ask the same; tasks are not merged by their bytes on disk."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(N, "ASKED_ROWS", 50, raising=False)
    rng = np.random.default_rng(15)
    history = [("a", i, tuple(v)) for i, v in enumerate(rng.normal(size=(200, 2)).round(2).tolist())]
    queries = [("a", i, (0.5, 0.25) if i % 4 else tuple(v)) for i, v in enumerate(rng.normal(size=(800, 2)).round(2).tolist())]
    assert run(spark, history, queries, 3, **sizes) == sorted(brute(history, queries, 3))
    h = spark.createDataFrame([(i, *v) for _, i, v in history], "hid long, x double, y double")
    q = spark.createDataFrame([(i, *v) for _, i, v in queries], "qid long, x double, y double")
    found = knn_join(h, q, ["x", "y"], "hid", "qid", 3, **sizes)
    each = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(each) == 2_400 and max(each) < 1_000


def test_copies_are_cut_in_tasks_of_bounded_rows(spark, rows, monkeypatch):
    import re

    monkeypatch.setattr(N, "TASK_ROWS", 100)
    monkeypatch.setattr(N, "COPY_ROWS", 50)
    written, write = [], N.materialise
    monkeypatch.setattr(N, "materialise", lambda df: written.append(df) or write(df))
    many = [("g", [1.0, 0.0], i) for i in range(900)] + [("g", [float(i % 100), 2.0], 900 + i) for i in range(700)]
    points = rows(many + [("g", [7.0, 7.0], 5000), ("h", [1.0, 0.0], 1)], "g string, vec array<double>, hist_id int").coalesce(1)
    kept = sorted((r.g, *r.vec, r.hist_id) for r in N._without_extra_copies(points, 3).collect())
    few = [("g", 1.0, 0.0, i) for i in range(3)] + [("g", float(i % 100), 2.0, 900 + i) for i in range(300)]
    assert kept == sorted([*few, ("g", 7.0, 7.0, 5000), ("h", 1.0, 0.0, 1)])
    plan = written[-1]._jdf.queryExecution().executedPlan().toString()
    tasks = re.findall(r"hashpartitioning\(g[^\n]*, (\d+)\), REPARTITION_BY_NUM", plan)
    assert max(map(int, tasks)) == 16  # of 1,600 copies
