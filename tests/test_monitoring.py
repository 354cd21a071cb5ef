import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows, ts
from tidewright.functions.measures import half_even, pages_to_gib, ratio_percent
from tidewright.functions.text import clock_text, host_part, port_part, version_prefix
from tidewright.operators import monitoring as mon
from tidewright.sources.status import key_value_rows, metric_rows, read_metric_log, read_status


def t(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


SAMPLE = "ts timestamp_ntz, instance string, item string, value bigint, uptime bigint"


def rates(spark, *samples, **kw):
    df = spark.createDataFrame([(t(i), "3306", item, v, up) for i, (item, v, up) in enumerate(samples)], SAMPLE)
    return [(r.rate, r.reset) for r in mon.counter_rates(df, **kw).orderBy("ts").collect()]


def test_rates(spark):
    assert rates(spark, ("Queries", 1000, 100), ("Queries", 1600, 160)) == [(10, False)]
    assert rates(spark, ("Queries", 1000, 100), ("Queries", 1600, 100)) == [(600, False)]
    assert rates(spark, ("Queries", 1000, 100)) == []
    assert rates(spark, ("bytes_sent", 0, 0), ("bytes_sent", 122880, 60)) == [(2, False)]
    assert rates(spark, ("q", 500, 0), ("q", 100, 10)) == [(-40, True)]


def test_half_even_and_ratios(spark):
    df = spark.range(1).select(
        half_even(F.lit(0.5)), half_even(F.lit(1.5)), half_even(F.lit(2.5)),
        ratio_percent(F.lit(1), F.lit(8)), ratio_percent(F.lit(1), F.lit(0)), pages_to_gib(F.lit(131072)),
    )
    assert tuple(df.first()) == (0, 2, 2, 12, None, 2)


def eta(spark, *pending):
    df = spark.createDataFrame(
        [(1, t(i), p, i * 5) for i, p in enumerate(pending)], "id int, ts timestamp_ntz, pending bigint, seconds bigint"
    )
    return [(r.pending, r.eta) for r in mon.backlog_eta(df, ["id"]).orderBy("ts").collect()]


def test_backlog_eta(spark):
    assert eta(spark, 1000, 800) == [(800, "00:00:20")]
    assert eta(spark, 1000, 1000) == [(1000, None)]
    assert eta(spark, 10, 0) == [(0, "00:00:00")]
    assert eta(spark, 100, 110) == [(110, "-00:00:55")]


def test_clock_text(spark):
    values = [(0, "00:00:00"), (3661, "01:01:01"), (360000, "100:00:00"), (10**9, "838:59:59"), (-20, "-00:00:20")]
    df = spark.createDataFrame([(v,) for v, _ in values], "v bigint")
    assert [r[0] for r in df.select(clock_text(F.col("v"))).collect()] == [w for _, w in values]


def test_host_port_version(spark):
    df = spark.createDataFrame([("10.0.0.5:51022",), ("localhost",)], "h string")
    assert rows(df.select(host_part(F.col("h")), port_part(F.col("h")))) == [("", "localhost"), ("10.0.0.5", "51022")]
    assert spark.range(1).select(version_prefix(F.lit("8.0.36"))).first()[0] == "8.0"


PROCESS = "id bigint, user string, host string, command string, time bigint, state string, info string, instance string"


def test_gauges_are_zero_without_rows_and_max_with(spark):
    processes = spark.createDataFrame(
        [(1, "app", "h:1", "Query", 3, "x", "q", "a"), (2, "app", "h:2", "Execute", 9, "x", "q", "a"),
         (3, "system user", "h", "Query", 99, "x", "q", "a"), (4, "app", "h:4", "Sleep", 50, "x", None, "b")],
        PROCESS,
    )
    trx = spark.createDataFrame(
        [("RUNNING", 4)] * 5 + [("LOCK WAIT", 1), ("RUNNING", 2)], "trx_state string, trx_mysql_thread_id bigint"
    )
    got = {r.instance: r for r in mon.session_gauges(processes, trx).collect()}
    assert (got["a"].conn_active_sec, got["a"].trans_active, got["a"].trans_active_sec) == (9, 1, 9)
    assert (got["a"].trans_uncommited, got["a"].lock_flush_sec) == (0, 0)
    assert (got["b"].conn_active_sec, got["b"].trans_uncommited, got["b"].trans_uncommited_sec) == (0, 5, 50)
    lost = trx.union(spark.createDataFrame([("RUNNING", 77), ("RUNNING", 77)], trx.schema))
    alone = {r.instance: r for r in mon.session_gauges(processes, lost).collect()}[None]
    assert (alone.trans_active, alone.conn_cur, alone.conn_active_sec, alone.lock_flush_sec) == (2, 0, 0, 0)
    long = mon.long_form(mon.session_gauges(processes, trx), ts("2024-01-01 00:00:00"))
    assert long.count() == 2 * 10
    assert (got["a"].conn_cur, got["a"].conn_max, got["a"].conn_ratio) == (3, 2000, 0)


def test_lock_waits_of_one_hot_blocker(spark):
    now = ts("2024-01-01 01:00:00")
    n = 200
    trx = spark.createDataFrame(
        [(0, 7, t(0), "blocker")] + [(i, 100 + i, t(30), "waiter") for i in range(1, n + 1)],
        "trx_id bigint, trx_mysql_thread_id bigint, trx_wait_started timestamp_ntz, trx_query string",
    )
    waits = spark.createDataFrame(
        [(i, 0, f"L{i}") for i in range(1, n + 1)],
        "requesting_trx_id bigint, blocking_trx_id bigint, requested_lock_id string",
    )
    locks = spark.createDataFrame([(f"L{i}", "db.t") for i in range(1, n + 1)], "lock_id string, lock_table string")
    processes = spark.createDataFrame([(7, "u", "h:99", "Sleep", 42, "", None, "a")], PROCESS)
    got = mon.lock_wait_graph(waits, trx, locks, processes, now).collect()
    assert len(got) == n
    assert {(r.blocking_host, r.blocking_port, r.idle_in_trx, r.wait_time) for r in got} == {("h", "99", 42, 1800)}


def test_probe_codes(spark):
    a, b = t(1), t(2)
    probes = spark.createDataFrame(
        [(1, a, a, "ok", "ok"), (2, a, None, "ok", "ok"), (3, a, b, "ok", "ok"), (4, a, a, "timeout", "ok"),
         (5, a, a, "request_error", "ok"), (6, a, a, "failed", "ok"), (7, a, a, "ok", "timeout"), (8, a, a, "ok", "error")],
        "i int, sent_ts timestamp_ntz, seen_ts timestamp_ntz, load_outcome string, query_outcome string",
    )
    got = [r.status_code for r in mon.probe_codes(probes).orderBy("i").collect()]
    assert got == [1, 4, 4, 2, 3, 4, 5, 6]


def test_health_notices(spark):
    states = [True, True, False, False, True, True, False]
    df = spark.createDataFrame([("a", t(i), s) for i, s in enumerate(states)], "instance string, ts timestamp_ntz, healthy boolean")
    got = [(r.ts.minute, r.notice) for r in mon.health_notices(df).orderBy("ts").collect()]
    assert got == [(0, "healthy"), (2, "error"), (3, "error"), (4, "healthy"), (6, "error")]


def test_throughput(spark):
    lines = [("1.2 GB/s", 1228.8, "excellent"), ("2048 KB/s", 2.0, "fair"), ("100 MB/s", 100.0, "good"),
             ("50 MB/s", 50.0, "fair"), ("1023 KB/s", 0.99, "fair"), ("n/a", None, None)]
    df = spark.createDataFrame([(x,) for x, _, _ in lines], "l string")
    got = [tuple(r) for r in mon.throughput(df, "l").select(F.col("mbps").cast("double"), "rating").collect()]
    assert got == [(m, r) for _, m, r in lines]


METRIC = "snap_id bigint, metric_name string, average double, end_time timestamp_ntz"


def test_peak_ties_other_metrics_and_old_rows(spark):
    now = ts("2024-01-10 00:00:00")
    day = [dt.datetime(2024, 1, d) for d in range(1, 10)]
    df = spark.createDataFrame(
        [(1, "aas", 99.0, day[0]), (5, "aas", 7.0, day[5]), (6, "aas", 7.0, day[6]), (4, "other", 7.0, day[4])], METRIC
    )
    peak = mon.peak_interval(df, "aas", now)
    assert rows(peak, "begin_snap", "end_snap") == [(4, 5)]
    instances = spark.createDataFrame([("a",), ("b",)], "instance string")
    plan = mon.peak_report_plan(peak, instances, now)
    assert rows(plan, "instance", "file_name") == [
        ("a", "awr_2024_JAN_10_00_00_a.html"), ("b", "awr_2024_JAN_10_00_00_b.html")
    ]
    empty = mon.peak_interval(df.filter("snap_id = 1"), "aas", now)
    assert mon.peak_report_plan(empty, instances, now).count() == 0


def test_usage_and_labels(spark):
    df = spark.createDataFrame(
        [("a", 3, 80.005, 60.0), ("b", 1, 99.0, 1.0), ("c", 3, 80.0, 1.0)], "n string, con_id int, pre double, post double"
    ).select("n", "con_id", F.col("pre").cast("decimal(10,2)").alias("pre_usage"), F.col("post").cast("decimal(10,2)").alias("post_usage"))
    got = mon.usage_over(df, 80.0).collect()
    assert [(r.n, float(r.diff)) for r in got] == [("a", 20.01)]
    labels = spark.range(1).select(mon.state_label(F.lit(50), 50), mon.state_label(F.lit(51), 50)).first()
    assert tuple(labels) == ("normal", "abnormal")


def test_replica_items_and_status_text(spark):
    text = "** 1. row **\n  Slave_IO_Running: No\n Slave_SQL_Running: Yes\n Seconds_Behind_Master: 12\nnoise"
    df = spark.createDataFrame([("a", text), ("b", "x: y")], "id string, s string")
    items = mon.replica_items(key_value_rows(df, "id", "s"), "id")
    assert rows(items) == [("a", 12, 1, 0), ("b", 0, 0, 0)]


def test_metric_lines_and_status_file(spark, tmp_path):
    lines = ["2024-01-01 00:00:05 | 3306 | conn_cur 12", "garbage", "2024-01-01 00:00:05  |  3307 |  net_kb   1.5"]
    df = metric_rows(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows(df, "instance", "item", "value") == [("3306", "conn_cur", 12.0), ("3307", "net_kb", 1.5)]
    (tmp_path / "log").write_text("\n".join(lines))
    assert rows(read_metric_log(spark, str(tmp_path / "log"))) == rows(df)
    (tmp_path / "status").write_text("Variable_name\tValue\nUptime\t100\nName\tx\n")
    got = {r.item: r.value for r in read_status(spark, str(tmp_path / "status")).collect()}
    assert got["Uptime"] == 100.0 and got["Name"] is None


def test_check_lag_uses_the_latest_day(spark):
    df = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1, 5)), ("a", dt.datetime(2024, 1, 2, 3)), ("a", dt.datetime(2024, 1, 2, 4))],
        "instance string, ts timestamp_ntz",
    )
    assert rows(mon.check_lag(df, ts("2024-01-02 05:00:00"))) == [("a", 7200)]
