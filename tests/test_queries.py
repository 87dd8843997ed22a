"""Every registered query against its SQL on the smallest folder of driver tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import differences, duck

FOLDER = os.environ.get("AGRONIMBUS_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables here")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_its_sql(spark, con, name):
    wrong, n, _ = differences(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql().get(name))
    assert not wrong and n > 0


@pytest.fixture
def plans(monkeypatch, spark):
    """Plans of everything that is written while the test runs."""
    from pyspark.sql.readwriter import DataFrameWriter

    seen = []
    for how in ("parquet", "save"):
        original = getattr(DataFrameWriter, how)

        def spy(self, *args, _original=original, **kwargs):
            seen.append(self._df._jdf.queryExecution().executedPlan().toString())
            return _original(self, *args, **kwargs)

        monkeypatch.setattr(DataFrameWriter, how, spy)
    return seen


@pytest.mark.parametrize("name", ["crop_comparison", "knn_join_pruned", "match_sequence", "resolve_crop", "season_etl",
                                  "similarity_requests", "start_date_recommendations", "planting_advice", "clean_series"])
def test_no_plan_pairs_everything_with_everything(spark, plans, name):
    """Only the candidate table is a product: of site keys and crop names, nothing else."""
    entry.queries()[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    assert plans
    for plan in plans:
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            assert "temp" not in plan.split("BroadcastNestedLoopJoin")[0].split("CartesianProduct")[0]
            assert plan.count("NestedLoopJoin") + plan.count("CartesianProduct") == 1
        # No product in disguise either: no list gathered from a whole table and exploded.
        assert not ("collect_set" in plan and "Subquery" in plan and "Generate explode" in plan)


def test_scans_read_only_the_columns_they_need(spark, plans):
    entry.queries()["start_window_join"](spark, FOLDER).write.format("noop").mode("overwrite").save()
    assert "event_type" not in plans[-1] and "PushedFilters: [IsNotNull(user_id)" in plans[-1]


def test_every_sql_text_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    out = entry.entry(spark)
    assert {"crop", "site_id", "similarity_score", "rank"} <= set(out.columns)
