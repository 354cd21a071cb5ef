"""The plans the jobs should get: pruned scans, no cross joins, bounded shuffles."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tidewright.plans import registry
from tests.conftest import ts
from tidewright.operators import change_data as cd
from tidewright.operators import retention as rt
from tidewright.operators import workload as wl
from tidewright.plans.tables import feed
from tidewright.sources.change_feed import read_feed


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scan_of(df):
    return [line for line in plan_of(df).splitlines() if "FileScan" in line]


def test_change_filter_reaches_the_scan(spark, sf_dir, tmp_path):
    path = str(tmp_path / "feed")
    feed(spark, sf_dir).write.parquet(path)
    kept = cd.filter_changes(read_feed(spark, path), "2024-01-05 00:00:00", "2024-01-06 00:00:00", "update", ["accounts"])
    (scan,) = scan_of(kept.select("log_pos"))
    for part in ("GreaterThanOrEqual(event_time", "LessThanOrEqual(event_time", "EqualTo(op,update)"):
        assert part in scan
    assert "before" not in scan


@pytest.mark.parametrize("name", ["completeness_check", "history_expiry", "incremental_copy_plan"])
def test_time_ranges_reach_the_scan(spark, sf_dir, name):
    scans = scan_of(contract.queries()[name](spark, sf_dir))
    assert all("PushedFilters: []" not in s for s in scans)
    assert any("LessThan" in s or "GreaterThan" in s for s in scans)


def test_ranges_equal_the_age(spark):
    now = ts("2024-07-15 00:00:00")
    files = spark.range(0, 40 * 86400, 43_199).select(
        F.timestamp_add("SECOND", -F.col("id"), now).alias("mtime")
    ).union(spark.sql("SELECT timestamp_ntz'2024-07-08 00:00:00.5' UNION ALL SELECT timestamp_ntz'2024-07-07 00:00:00.25'"))
    checked = files.select(
        rt.age_days(F.col("mtime"), now).alias("age"), rt.younger_than(F.col("mtime"), 7, now).alias("young"),
        rt.older_than(F.col("mtime"), 7, now).alias("old"),
    )
    assert checked.filter((F.col("young") != (F.col("age") < 7)) | (F.col("old") != (F.col("age") > 7))).count() == 0


# Building these runs streams or writes tables, which other tests cover.
WRITING = {"cdc_stream_upsert", "undo_stream_tail", "counter_rates_stream", "edges_known_entities",
           "batch_replace", "dated_state_dump", "job_log_append", "query_batch_export"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - WRITING))
def test_no_pairwise_joins_and_no_python_rows(spark, sf_dir, name):
    plan = plan_of(contract.queries()[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "MapInPandas", "ArrowEvalPython"):
        assert bad not in plan


def test_latest_state_combines_before_the_shuffle(spark, sf_dir):
    plan = plan_of(cd.state_as_of(feed(spark, sf_dir, before=False), "id"))
    below = plan.split("Exchange hashpartitioning")[1]
    assert "partial_max_by" in below and plan.count("Exchange") == 1


def test_first_rows_are_cut_before_the_shuffle(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = plan_of(wl.first_rows(events, "event_type", "event_id", 10))
    assert "Partial" in plan.split("Exchange")[1] and "WindowGroupLimit" in plan
