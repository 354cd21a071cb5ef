import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewright.operators.monitoring import counter_rates
from tidewright.streaming.rates import last_samples, rates_available
from tidewright.sources.change_feed import stream_feed
from tidewright.streaming.bucketed import BucketedTable, Flush, start_bucketed
from tidewright.streaming.freshness import follow, probe_status
from tidewright.streaming.tail import undo_available, undo_slice
from tidewright.streaming.upsert import compact, current_rows, start_upsert, upsert_available

CHANGE = "id int, op string, log_pos bigint, v string"
KEYS, ORDER = ["id"], ["log_pos"]


def add(spark, path, *changes):
    spark.createDataFrame(changes, CHANGE).coalesce(1).write.mode("append").parquet(path)


def ingest(spark, base, **kw):
    stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    upsert_available(stream, KEYS, ORDER, f"{base}/t", f"{base}/cp", **kw)


def test_upsert_over_batches_resumes_and_keeps_late_changes_out(spark, tmp_path):
    base = str(tmp_path)
    add(spark, f"{base}/in", (1, "insert", 1, "222"), (2, "insert", 2, "333"))
    add(spark, f"{base}/in", (1, "update", 3, "223"))
    ingest(spark, base)
    assert rows(current_rows(spark, f"{base}/t", KEYS, ORDER), "id", "v") == [(1, "223"), (2, "333")]
    add(spark, f"{base}/in", (2, "delete", 4, None), (1, "update", 2, "late"))
    ingest(spark, base)
    assert rows(current_rows(spark, f"{base}/t", KEYS, ORDER), "id", "v") == [(1, "223")]
    assert len(list((tmp_path / "t").glob("batch_id=*"))) == 3
    compact(spark, f"{base}/t", KEYS, ORDER)
    assert [p.name for p in (tmp_path / "t").glob("batch_id=*")] == ["batch_id=-1"]
    add(spark, f"{base}/in", (2, "update", 3, "older than the delete"), (3, "insert", 9, "new"))
    ingest(spark, base)
    compact(spark, f"{base}/t", KEYS, ORDER)
    assert [p.name for p in (tmp_path / "t").glob("batch_id=*")] == ["batch_id=-2"]
    assert rows(current_rows(spark, f"{base}/t", KEYS, ORDER), "id", "v") == [(1, "223"), (3, "new")]


def test_a_later_slice_has_what_an_earlier_run_read(spark, tmp_path):
    base = str(tmp_path)
    day = 86_400
    feed = spark.range(10).select(
        F.lit("d").alias("db"), F.lit("t").alias("tbl"), F.lit("insert").alias("op"),
        (F.lit(1_704_067_200) + F.col("id") * day).alias("event_time"), F.lit("bin.1").alias("log_file"), F.col("id").alias("log_pos"),
        F.lit(None).cast("string").alias("gtid"), F.lit(None).cast("map<string,string>").alias("before"),
        F.create_map(F.lit("id"), F.col("id").cast("string")).alias("after"), F.create_map(F.lit("id"), F.lit("int")).alias("types"),
    )
    feed.coalesce(1).write.parquet(f"{base}/feed")
    for end, n in (("2024-01-04 00:00:00", 4), ("2024-01-08 00:00:00", 8)):
        undo_available(stream_feed(spark, f"{base}/feed"), f"{base}/undo", f"{base}/cp")
        assert undo_slice(spark, f"{base}/undo", end=end).count() == n


def test_upsert_replay_of_a_batch_changes_nothing(spark, tmp_path):
    base = str(tmp_path)
    add(spark, f"{base}/in", (1, "insert", 1, "a"), (1, "update", 2, "b"))
    ingest(spark, base)
    stream = spark.readStream.schema(CHANGE).parquet(f"{base}/in")
    upsert_available(stream, KEYS, ORDER, f"{base}/t", f"{base}/cp_again", etl_time=True)
    assert rows(current_rows(spark, f"{base}/t", KEYS, ORDER), "id", "v") == [(1, "b")]


def test_upsert_on_an_interval(spark, tmp_path):
    base = str(tmp_path)
    add(spark, f"{base}/in", (1, "insert", 1, "a"))
    stream = spark.readStream.schema(CHANGE).parquet(f"{base}/in")
    query = start_upsert(stream, KEYS, ORDER, f"{base}/t", f"{base}/cp", interval="1 second")
    try:
        query.processAllAvailable()
        add(spark, f"{base}/in", (1, "update", 2, "b"))
        query.processAllAvailable()
    finally:
        query.stop()
    assert rows(current_rows(spark, f"{base}/t", KEYS, ORDER), "id", "v") == [(1, "b")]


SAMPLE = "ts timestamp_ntz, instance string, item string, value bigint, uptime bigint"


def test_rates_over_batches_equal_the_batch_rates(spark, tmp_path):
    base = str(tmp_path)
    samples = [
        (dt.datetime(2024, 1, d, h), f"i{i}", "q", (d * 24 + h) * (i + 1) ** 2 % 977, d * 24 + h)
        for d in (1, 2, 3) for h in range(24) for i in (0, 1)
    ]
    df = spark.createDataFrame(samples, SAMPLE)
    for day in (1, 2, 3):
        df.filter(F.dayofmonth("ts") == day).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(SAMPLE).parquet(f"{base}/in")
        rates_available(stream, f"{base}/out", f"{base}/state", f"{base}/cp")
    cols = ["ts", "instance", "item", "rate", "reset"]
    assert rows(spark.read.parquet(f"{base}/out"), *cols) == rows(counter_rates(df), *cols)
    late = df.filter((F.dayofmonth("ts") == 1) & (F.col("instance") == "i0"))
    late.coalesce(1).write.mode("append").parquet(f"{base}/in")
    rates_available(spark.readStream.schema(SAMPLE).parquet(f"{base}/in"), f"{base}/out", f"{base}/state", f"{base}/cp")
    assert spark.read.parquet(f"{base}/out").count() == counter_rates(df).count()
    assert rows(last_samples(spark, f"{base}/state").current_rows(), "instance", "ts") == [
        ("i0", dt.datetime(2024, 1, 3, 23)), ("i1", dt.datetime(2024, 1, 3, 23))
    ]


def test_rates_touch_only_the_state_of_their_counters(spark, tmp_path):
    base = str(tmp_path)

    def run(*samples):
        spark.createDataFrame([(dt.datetime(2024, 1, 1, h), i, "x", v, h * 3600) for i, h, v in samples], SAMPLE).coalesce(1).write.mode("append").parquet(f"{base}/in")
        rates_available(spark.readStream.schema(SAMPLE).parquet(f"{base}/in"), f"{base}/out", f"{base}/state", f"{base}/cp", 16)

    run(*[(f"i{k}", 1, 0) for k in range(100)])
    run(("i7", 2, 3600), ("i7", 3, 3600), ("new", 3, 5))
    assert len(list((tmp_path / "state" / "version=1").glob("bucket=*"))) <= 2
    run(("new", 4, 7205))
    assert rows(spark.read.parquet(f"{base}/out"), "instance", F.hour("ts"), "rate") == [("i7", 2, 1), ("i7", 3, 0), ("new", 4, 2)]
    assert last_samples(spark, f"{base}/state", 16).current_rows().count() == 101


def test_scratch_path_is_on_shared_storage(spark):
    from tidewright.session import scratch_path

    assert scratch_path(spark, "x") != scratch_path(spark, "x")

    def cluster(**settings):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: settings.get(key.split(".")[1], default)))

    both = cluster(checkpoint="hdfs://shared/checkpoints/", sql="hdfs://shared/warehouse")
    assert scratch_path(both, "x").startswith("hdfs://shared/checkpoints/x-")
    assert scratch_path(cluster(sql="hdfs://shared/warehouse"), "x").startswith("hdfs://shared/warehouse/_scratch/x-")
    for warehouse in ("file:/home/spark-warehouse", "/home/spark-warehouse"):
        own = cluster(sql=warehouse)
        own.sparkContext = SimpleNamespace(master="spark://host:7077")
        with pytest.raises(ValueError):
            scratch_path(own, "x")
        own.sparkContext.master = "local[8]"
        assert scratch_path(own, "x").startswith(f"{warehouse}/_scratch/x-")


def bucketed(spark, base, flush=None, n=4, **kw):
    table = BucketedTable(spark, f"{base}/b", KEYS, ORDER, n, flush or Flush())
    stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    start_bucketed(stream, table, f"{base}/bcp", **kw).awaitTermination()
    return table


def live(table):
    return rows(table.current_rows(), "id", "v")


def test_bucketed_table_rewrites_touched_buckets_only(spark, tmp_path):
    base = str(tmp_path)
    add(spark, f"{base}/in", *[(i, "insert", i, "a") for i in range(200)])
    table = bucketed(spark, base, n=16)
    first = table.state().buckets
    assert set(first) == set(range(16)) and len(live(table)) == 200
    add(spark, f"{base}/in", (3, "update", 900, "b"), (3, "update", 800, "older"), (5, "delete", 901, None))
    table = bucketed(spark, base, n=16)
    second = table.state().buckets
    moved = {b for b in second if second[b] != first[b]}
    assert 1 <= len(moved) <= 2 and {p.name for p in (tmp_path / "b" / "version=1").glob("bucket=*")} == {f"bucket={b}" for b in moved}
    assert dict(live(table)) == {**{i: "a" for i in range(200) if i != 5}, 3: "b"}
    add(spark, f"{base}/in", (5, "update", 850, "before the delete"), (3, "update", 899, "late"))
    assert dict(live(bucketed(spark, base, n=16))) == {**{i: "a" for i in range(200) if i != 5}, 3: "b"}


def test_bucketed_table_is_read_without_a_shuffle(spark, tmp_path):
    base = str(tmp_path)
    for k in range(3):
        add(spark, f"{base}/in", *[(i, "insert", k * 100 + i, f"v{k}") for i in range(50)])
    table = bucketed(spark, base)
    plan = table.current_rows()._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert len(live(table)) == 50 and {v for _, v in live(table)} == {"v2"}


def test_bucketed_flush_bounds(spark, tmp_path):
    base = str(tmp_path)
    add(spark, f"{base}/in", (1, "insert", 1, "a"), (2, "insert", 2, "a"))
    table = bucketed(spark, base, Flush(rows=3, bytes=10**9))
    assert table.current_rows() is None and sum(n for n, _, _ in table.state().kept.values()) == 2
    add(spark, f"{base}/in", (2, "update", 3, "b"))
    assert live(bucketed(spark, base, Flush(rows=3, bytes=10**9))) == [(1, "a"), (2, "b")]
    add(spark, f"{base}/in", (3, "insert", 4, "c"))
    table = bucketed(spark, base, Flush(rows=3))
    assert live(table) == [(1, "a"), (2, "b")]
    table.flush_now()
    assert live(table) == [(1, "a"), (2, "b"), (3, "c")] and not table.state().kept
    add(spark, f"{base}/in", (4, "insert", 5, "d"))
    assert len(live(bucketed(spark, base, Flush(rows=100, bytes=1)))) == 4
    add(spark, f"{base}/in", (5, "insert", 6, "e"))
    assert len(live(bucketed(spark, base, Flush(seconds=0)))) == 5


def test_bucketed_batches_may_be_replayed(spark, tmp_path):
    """A batch that ran up to any point and runs again leaves what it leaves at once."""
    table = BucketedTable(spark, str(tmp_path), KEYS, ORDER, 4, Flush(rows=3))
    batches = [[(1, "insert", 1, "a"), (2, "insert", 2, "a")], [(1, "update", 3, "b")], [(2, "delete", 4, None), (3, "insert", 5, "c"), (9, "insert", 6, "d")], [(1, "update", 7, "z")]]
    for k, changes in enumerate(batches):
        batch = spark.createDataFrame(changes, CHANGE)
        for _ in range(2):
            table.take(batch, k)
    assert live(table) == [(1, "b"), (3, "c"), (9, "d")]
    table.flush_now()
    table.flush_now()
    assert live(table) == [(1, "z"), (3, "c"), (9, "d")]
    assert len(list((tmp_path / "manifest").iterdir())) <= 2


def beat(second):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


def test_deadlines_are_worked_out_from_the_streams(spark, tmp_path):
    base = str(tmp_path)
    schemas = {
        "sent": "probe long, sent_ts timestamp", "answers": "probe long, answer_ts timestamp, http int, load_status string",
        "readings": "probe long, read_ts timestamp, value timestamp, read_error string",
    }

    def arrive(**new):
        for name, schema in schemas.items():
            spark.createDataFrame(new.get(name, []), schema).coalesce(1).write.mode("append").parquet(f"{base}/{name}")
        streams = [spark.readStream.schema(schema).parquet(f"{base}/{name}") for name, schema in schemas.items()]
        follow(*streams, f"{base}/out", f"{base}/cp", "10 seconds")
        return dict(rows(probe_status(spark, f"{base}/out"), "probe", "status_code"))

    ok = [200, "Success"]
    found = arrive(
        sent=[(k, beat(10 * k)) for k in range(1, 9)],
        answers=[(1, beat(15), *ok), (1, beat(12), 500, "x"), (3, beat(35.001), *ok), (4, beat(41), 200, "Fail"), (5, beat(50), *ok), (6, beat(61), *ok), (7, beat(71), *ok), (8, beat(81), *ok)],
        readings=[(1, beat(20), beat(10), None), (5, beat(65.5), beat(50), None), (6, beat(70), beat(60), None), (6, beat(69), None, "refused"), (7, beat(80), beat(1), None)],
    )
    # Probes that are answered or whose time has passed by the watermark; the last one is still waited for.
    assert found == {1: 3, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 4}
    found = arrive(sent=[(9, beat(200))], answers=[(9, beat(201), *ok)], readings=[(8, beat(95), beat(80), None), (9, beat(206), beat(200), None)])
    # The reading of 8 came with the second run, within its time.
    assert found == {1: 3, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 4, 8: 1, 9: 1}
