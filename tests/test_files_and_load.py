import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows, ts
from tidewright.operators import retention as rt
from tidewright.operators import services as sv
from tidewright.operators import snapshots as sn
from tidewright.operators import workload as wl
from tidewright.sinks.tables import append_dated, append_table, export_queries
from tidewright.sources import csv_load, inventory
from tidewright.sources.status import key_value_rows, read_dated_log, read_snapshots, read_vertical

FILE = "path string, mtime timestamp_ntz"


def votes(spark, **columns):
    n = max(len(v) for v in columns.values())
    data = [tuple(v[i] if i < len(v) else "" for v in columns.values()) for i in range(n)]
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns)).coalesce(1)
    return csv_load.type_map(csv_load.infer_types(df))


def test_type_votes(spark):
    got = votes(
        spark, a=["1", "22", ""], b=["-3", "4"], c=["1.5", "1e5"], d=["2024-01-05", "2024-1-5"], e=["", ""],
        f=["a", ""], g=["x" * 256], h=["nan", "inf"], i=["2024-02-30"], j=[" 7 "], k=["1_0.", "+.5"],
    )
    big = "DECIMAL(36,6)"
    assert got == {"a": "BIGINT", "b": big, "c": big, "d": "DATE", "e": "BIGINT", "f": "VARCHAR(255)", "g": "TEXT",
                   "h": big, "i": "VARCHAR(255)", "j": "BIGINT", "k": big}


def test_csv_file_load(spark, tmp_path):
    path = tmp_path / "people.csv"
    lines = ['id,day,note,price'] + [f'{i},2024-1-{i % 28 + 1},"say ""{i}"", ok",{i}.50' for i in range(100)]
    lines += ['x,2024-02-30,,"nan"', ',,"two', 'lines",']
    path.write_text("\n".join(lines) + "\n")
    assert csv_load.table_name(str(path)) == "people"
    strings = csv_load.read_strings(spark, str(path), multi_line=True)
    assert csv_load.type_map(csv_load.infer_types(strings))["id"] == "VARCHAR(255)"
    types = csv_load.type_map(csv_load.infer_types(strings, sample=100))
    assert types == {"id": "BIGINT", "day": "DATE", "note": "VARCHAR(255)", "price": "DECIMAL(36,6)"}
    loaded = csv_load.load_typed(strings, types)
    assert loaded.count() == 102
    first = loaded.filter("id = 3").first()
    assert (first.day, first.note, float(first.price), first._corrupt) == (dt.date(2024, 1, 4), 'say "3", ok', 3.5, False)
    bad = loaded.filter("_corrupt").collect()
    assert [(r.id, r.day, r.note, r.price) for r in bad] == [(None, None, "", None)]
    assert bad[0]["_misfits"]["id"] == "x" and bad[0]["_misfits"]["day"] == "2024-02-30"
    blank = loaded.filter("id is null and not _corrupt").first()
    assert (blank.day, blank.note, blank.price) == (None, "two\nlines", None)
    with pytest.raises(Exception, match="does not fit"):
        csv_load.load_typed(strings, types, strict=True).collect()


def test_append_table_creates_and_appends(spark):
    name = "tidewright_append_check"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    append_table(df, name)
    append_table(df, name)
    assert spark.table(name).count() == 2
    spark.sql(f"DROP TABLE {name}")


def test_export_reports_empty_and_stops_at_a_failure(spark, tmp_path):
    t = spark.createDataFrame([(1,), (2,)], "a int")
    report = export_queries(
        spark, {"w": [("all", "select * from {t}"), ("none", "select * from {t} where a > 9"),
                      ("bad", "select nope from {t}"), ("late", "select 1")],
                "x": [("one", "select 1 as a")]}, str(tmp_path), t=t,
    )
    assert "nope" in report.filter("status = 'failed'").first().message
    assert rows(report.drop("message")) == [("w", "all", "done", 2), ("w", "bad", "failed", 0), ("w", "none", "empty", 0), ("x", "one", "done", 1)]
    assert spark.read.parquet(str(tmp_path / "w" / "all")).count() == 2
    assert not (tmp_path / "w" / "late").exists()


def test_snapshot_lists_are_bounded_and_ordered(spark):
    tables = spark.range(250).select(
        F.when(F.col("id") < 5, "sys").when(F.col("id") < 240, "big").otherwise("small").alias("table_schema"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("table_name"),
        F.when(F.col("id") % 10 == 0, "VIEW").otherwise("BASE TABLE").alias("table_type"), "id",
    )
    got = sn.snapshot_manifest(tables, "20240101000000", "id", F.floor(F.col("id") / 7), per_list=100).collect()
    assert {(r.table_schema, r.list_no): r.n_tables for r in got} == {("big", 1): 100, ("big", 2): 100, ("big", 3): 12, ("small", 1): 9}
    names = [n for r in sorted((r for r in got if r.table_schema == "big"), key=lambda r: r.list_no) for n in r.tables.split(", ")]
    assert names == [f"`t{i}`" for i in range(5, 240) if i % 10]
    assert {r.label for r in got} == {"big_20240101000000_backup", "big_20240101000000_backup_2", "big_20240101000000_backup_3", "small_20240101000000_backup"}
    listed = spark.createDataFrame([(i, r.label, "OK") for i, r in enumerate(got)] + [(90, "big_20230101000000_backup_4", "OK")], "n int, snapshot string, status string")
    assert {r.snapshot for r in sn.latest_snapshots(listed, "n").collect()} == {r.label for r in got}


def test_latest_snapshot(spark):
    listed = [
        (1, "my_db_20250101000000_backup", "OK"), (2, "my_db_20250201000000_backup", "OK"),
        (3, "my_db_20250301000000_backup", "FAILED"), (4, "my_db_latest", "OK"), (5, "x_20251301000000_backup", "OK"),
        (6, "sys_20250101000000_backup", "OK"), (7, "my_db_20250201000000_backup", "OK"),
    ]
    df = spark.createDataFrame(listed, "n int, snapshot string, status string")
    assert rows(sn.latest_snapshots(df, "n"), "db", "snapshot") == [("my_db", "my_db_20250201000000_backup")]
    assert rows(sn.invalid_names(df), "n") == [(4,), (5,)]


def test_catalog_statistics_in_one_command(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS tidewright_cat")
    spark.range(7).selectExpr("id", "id % 2 AS b", "id % 3 AS c").write.partitionBy("b", "c").mode("overwrite").saveAsTable("tidewright_cat.parted")
    spark.range(4).write.mode("overwrite").saveAsTable("tidewright_cat.unknown")
    spark.sql("ANALYZE TABLE tidewright_cat.parted COMPUTE STATISTICS")
    spark.range(1).createOrReplaceTempView("passing")
    got = inventory.catalog_statistics(spark, "tidewright_cat")
    assert rows(got, "table_name", "table_type", "is_partitioned", "partition_columns", "num_rows") == [
        ("parted", "MANAGED", True, "b,c", 7), ("unknown", "MANAGED", False, None, None)]
    assert all(r.table_schema == "tidewright_cat" and r.provider == "parquet" for r in got.collect())
    spark.sql("DROP DATABASE tidewright_cat CASCADE")


def test_snapshot_export_and_read_back(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS tidewright_snap")
    spark.sql("DROP TABLE IF EXISTS tidewright_snap.t")
    spark.range(3).write.saveAsTable("tidewright_snap.t")
    spark.sql("ANALYZE TABLE tidewright_snap.t COMPUTE STATISTICS")
    assert rows(inventory.catalog_statistics(spark, "tidewright_snap"), "table_name", "is_partitioned", "num_rows") == [("t", False, 3)]
    tables = [tuple(r) for r in inventory.catalog_tables(spark, "tidewright_snap").collect()]
    manifest = sn.export_snapshot(spark, tables, str(tmp_path), "20240101000000")
    (r,) = manifest.collect()
    assert r.label == "tidewright_snap_20240101000000_backup"
    assert sn.read_snapshot(spark, str(tmp_path), r.label, r.table_name).count() == 3
    spark.sql("DROP DATABASE tidewright_snap CASCADE")


def test_sync_plan(spark):
    now = ts("2024-03-01 00:00:00")
    schema = "path string, mtime timestamp_ntz, length long"

    def files(*listed):
        return spark.createDataFrame([(p, dt.datetime.fromisoformat(f"2024-{d}"), n) for p, d, n in listed], schema)

    source = files(
        ("hdfs://nn:8020/src/a/new", "02-28", 1), ("file:/src/same", "02-28", 2), ("/src/longer", "02-28", 3), ("/src/later", "02-29", 4),
        ("/src/old", "01-02", 5), ("/src/old_both", "01-02", 6), ("/srcx/elsewhere", "02-28", 7), ("/src/dir.v1+x/f", "02-28", 8),
    )
    target = files(("/dst/same", "02-28", 2), ("/dst/longer", "02-28", 2), ("/dst/later", "02-28", 4), ("/dst/old_both", "01-02", 6), ("/dst/own", "02-20", 9))
    plan = rt.sync_plan(source, target, "/src/", "s3a://bucket/dst".replace("s3a://bucket", ""), 30, now)
    assert {r.relative: (r.action, r.bytes, r.target) for r in plan.collect()} == {
        "a/new": ("copy", 1, "/dst/a/new"), "same": ("keep", None, None), "longer": ("copy", 3, "/dst/longer"), "later": ("copy", 4, "/dst/later"),
        "old": ("skip", None, None), "old_both": ("delete", None, None), "own": ("keep", None, None), "dir.v1+x/f": ("copy", 8, "/dst/dir.v1+x/f"),
    }
    assert rt.sync_plan(source.limit(0), target.limit(0), "/src", "/dst", 30, now).collect() == []


def test_vertical_output_and_dated_logs(spark, tmp_path):
    star = "*" * 27
    (tmp_path / "a.txt").write_text(f"{star} 1. row {star}\n  Key: x\n  Text: a | b\n   c\n\n{star} 2. row {star}\nKey: y\n")
    (tmp_path / "b.txt").write_text("nothing\n")
    got = read_vertical(spark, str(tmp_path)).collect()
    assert sorted((r.row_no, r.record.count("\n")) for r in got) == [(1, 4), (2, 1)]
    assert rows(key_value_rows(read_vertical(spark, str(tmp_path)), "row_no", "record")) == [(1, "Key", "x"), (1, "Text", "a | b"), (2, "Key", "y")]
    for day in ("05", "06", "07"):
        (tmp_path / "log" / f"dump_date=2024-01-{day}").mkdir(parents=True)
        (tmp_path / "log" / f"dump_date=2024-01-{day}" / "m.txt").write_text(f"2024-01-{day} 01:00:00 | 3306 | conn_cur   {day}\nbroken line\n")
    some = read_dated_log(spark, str(tmp_path / "log"), "2024-01-06", "2024-01-06")
    assert [(r.instance, r.item, r.value) for r in some.collect()] == [("3306", "conn_cur", 6.0)]
    assert "PartitionFilters: [isnotnull(dump_date" in some._jdf.queryExecution().toString()


def test_snapshot_is_whole_or_absent(spark, tmp_path):
    repo = str(tmp_path / "repo")
    good = {name: spark.range(k + 1) for k, name in enumerate("abcde")}
    bad = {**good, "d": spark.range(3).select(F.raise_error(F.lit("no d")).alias("id"))}
    tables = [("s", name) for name in "abcde"]

    def export(stamp, source):
        report = sn.export_snapshot(spark, tables, repo, stamp, per_list=2, at_once=3, read=lambda schema, name: source[name])
        return {r.table_name: (r.label, r.status, r.n_rows) for r in report.collect()}

    assert export("20240101000000", good)["e"] == ("s_20240101000000_backup_3", "done", 5)
    report = export("20240102000000", bad)
    assert report["d"] == ("s_20240102000000_backup_2", "failed", None) and report["c"][1] == "done"
    listed = {r.snapshot: r.status for r in sn.list_snapshots(spark, repo).collect()}
    assert {k: v for k, v in listed.items() if "0101" in k} == {f"s_20240101000000_backup{n}": "OK" for n in ("", "_2", "_3")}
    assert {v for k, v in listed.items() if "0102" in k} == {"INCOMPLETE"}
    latest = sn.latest_snapshots(sn.list_snapshots(spark, repo), "ordinal")
    assert {r.snapshot for r in latest.collect()} == {k for k in listed if "0101" in k}
    with pytest.raises(ValueError, match="not finished"):
        sn.read_snapshot(spark, repo, "s_20240102000000_backup_2", "c")
    with pytest.raises(ValueError, match="no table"):
        sn.read_snapshot(spark, repo, "s_20240101000000_backup", "d")
    tries = []

    def write(schema, name, rows):
        tries.append(name)
        if name == "b" and tries.count("b") < 3:
            rows.select(F.raise_error(F.lit("busy"))).write.format("noop").mode("overwrite").save()
        rows.write.mode("overwrite").parquet(str(tmp_path / "back" / name))

    done = sn.restore_snapshots(spark, repo, latest, write).collect()
    assert sorted((r.table_name, r.status, r.n_rows) for r in done) == [(name, "done", k + 1) for k, name in enumerate("abcde")]
    assert tries.count("b") == 3 and spark.read.parquet(str(tmp_path / "back" / "e")).count() == 5
    # A second export of the same time takes the mark away first.
    export("20240101000000", bad)
    assert "OK" not in {r.status for r in sn.list_snapshots(spark, repo).filter("snapshot LIKE '%0101%'").collect()}
    # A table whose files changed after its export is refused.
    good["a"].write.mode("append").parquet(f"{repo}/s_20240101000000_backup/a")
    with pytest.raises(ValueError, match="not those of its export"):
        sn.read_snapshot(spark, repo, "s_20240101000000_backup", "a")
    assert sn.list_snapshots(spark, str(tmp_path / "none")).collect() == []


def test_snapshot_listing_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text("snapshot,ts,status\na_20240101000000_backup,2024-01-01,OK\n")
    assert read_snapshots(spark, str(tmp_path / "s.csv")).first().status == "OK"


def test_retention(spark):
    files = [("/b/mysql/rds-1", dt.datetime(2024, 6, 14)), ("/b/mysql/rds-2", dt.datetime(2024, 6, 15)),
             ("/b/mysql/rds-3", dt.datetime(2024, 6, 1)), ("/b/mysql/x/rds-uat-4", dt.datetime(2024, 7, 10)),
             ("/b/other/rds-5", dt.datetime(2020, 1, 2))]
    df = spark.createDataFrame(files, FILE)
    rules = [("/b/mysql/", "rds-", 30), ("/b/mysql/", "rds-uat", 3)]
    got = [r.action for r in rt.retention_plan(df, rules, ts("2024-07-15 00:00:00")).orderBy("path").collect()]
    assert got == ["Deleted", "Kept", "Skipped", "Deleted", "Kept"]


def test_dated_files_of_a_year(spark):
    """One file per day: past the limit all go but the firsts of the months."""
    days = inventory.calendar_days(spark, ts("2024-07-15 00:00:00"), 100)
    assert days.count() == 101
    files = days.select(F.concat(F.lit("/d/f_"), F.date_format("day", "yyyyMMdd")).alias("path"), F.col("day").cast("timestamp_ntz").alias("mtime"))
    plan = rt.retention_plan(files, [("/d", "f_", 7)], ts("2024-07-15 00:00:00"))
    assert {r.action: r["count"] for r in plan.groupBy("action").count().collect()} == {"Kept": 8, "Skipped": 3, "Deleted": 90}


def test_copy_plan(spark):
    now = ts("2024-07-15 00:00:00")
    df = spark.createDataFrame(
        [("/src/a/1", dt.datetime(2024, 7, 8, 2, 24)), ("/src/2", dt.datetime(2024, 7, 8)), ("/elsewhere/3", dt.datetime(2024, 7, 14))], FILE
    )
    assert rows(rt.copy_plan(df, "/src/", "/dst/", 7, now), "target") == [("/dst/a/1",)]
    old = spark.createDataFrame([("/dst/x", dt.datetime(2024, 7, 7)), ("/dst/y", dt.datetime(2024, 7, 8))], FILE)
    assert rows(rt.target_cleanup(old, 7, now)) == [("/dst/x",)]


def test_idle_keys_and_expired_days(spark, tmp_path):
    (tmp_path / "k.csv").write_text("key,idle_sec,ttl_sec\na,259201,-1\nb,259200,-1\nc,999999,60\n")
    assert rows(rt.idle_keys(inventory.read_keys(spark, str(tmp_path / "k.csv"))), "key") == [("a",)]
    h = spark.createDataFrame([(dt.date(2024, 1, d),) for d in range(1, 32)], "day date")
    assert rt.expired_days(h, "day", ts("2024-02-05 10:00:00"), 30).count() == 5


def test_trim_rounds(spark):
    df = spark.range(450).select(F.lit("big").alias("l"), "id").union(spark.range(400).select(F.lit("even").alias("l"), "id"))
    got = rt.trim_rounds(df, "l", "id", F.floor(F.col("id") / 64)).groupBy("l", "round", "how").count()
    assert rows(got) == [("big", 1, "trim", 200), ("big", 2, "trim", 200), ("big", 3, "delete", 50), ("even", 1, "trim", 200), ("even", 2, "trim", 200)]


def test_generations_and_completeness(spark):
    names = spark.createDataFrame([("a", "a_7"), ("a", "a_10"), ("a", "a_x"), ("b", "b")], "g string, name string")
    assert rows(rt.next_generation(names, "g", "name", 5)) == [("a", 11), ("b", 5)]
    files = spark.createDataFrame([("p", dt.datetime(2024, 1, 2, 5)), ("q", dt.datetime(2024, 1, 1))], "pattern string, mtime timestamp_ntz")
    expected = spark.createDataFrame([("p",), ("q",)], "pattern string")
    assert rows(rt.completeness(expected, files, F.lit("2024-01-02").cast("date"))) == [("p", 1, "ok"), ("q", 0, "error")]


def test_files_by_pattern(spark):
    day = F.lit("2024-01-02").cast("date")
    listed = ["/b/db_level0_20240102_1.bak", "/b/db_level0_20240103_1.bak", "/b/db+level0_20240102_1.bak", "/b/arch_20240102.bak", "/b/x/arch_20240102.bakk"]
    files = spark.createDataFrame([(p, dt.datetime(2024, 1, 2, 5)) for p in listed], FILE)
    patterns = ["db_level0_<day>_*.bak", "arch_<day>.ba?", "none_*"]
    matched = rt.by_pattern(files, patterns, day)
    assert rows(matched, "path", "pattern") == [(listed[3], patterns[1]), (listed[0], patterns[0])]
    expected = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    assert rows(rt.completeness(expected, matched, day)) == [(patterns[1], 1, "ok"), (patterns[0], 1, "ok"), ("none_*", 0, "error")]


def test_file_inventory_reads_no_content(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a").write_text("abc")
    (tmp_path / "d" / "e" / "b").write_text("x")
    df = inventory.read_files(spark, str(tmp_path / "d"))
    assert rows(df, "length") == [(1,), (3,)]
    assert "content" not in df._jdf.queryExecution().executedPlan().toString()


def test_partition_listing(spark):
    p = spark.createDataFrame([("T", "P1", "x" * 60), ("U", "P2", "y")], "table_name string, partition_name string, high_value string")
    assert rows(inventory.partition_listing(p, "t"), "partition_name", "partition_value") == [("P1", "x" * 50)]


def test_dated_append(spark, tmp_path):
    path = str(tmp_path / "dump")
    df = spark.createDataFrame([("trx", 1)], "kind string, id int")
    append_dated(df, path, ts("2024-01-02 03:00:00"))
    append_dated(df, path, ts("2024-01-03 03:00:00"))
    assert sorted(p.name for p in (tmp_path / "dump" / "kind=trx").iterdir()) == ["dump_date=2024-01-02", "dump_date=2024-01-03"]


def test_tier_and_tags(spark):
    df = spark.createDataFrame([("prod",), ("uat",), ("fat",), ("dev",), ("lab",)], "e string")
    assert [r[0] for r in df.select(sv.tier(F.col("e"))).collect()] == ["Tier1", "Tier2", "Tier3", "Tier4", "Tier5"]
    assert spark.range(1).select(sv.group_tags(F.lit("g1:: g2 ::"))).first()[0] == ["ResourceGroup.g1", "ResourceGroup.g2"]


def test_workload_is_repeatable_and_weighted(spark):
    seq = wl.sequence_rows(spark, 20_000)
    first, again = wl.workload_actions(seq, 1), wl.workload_actions(seq.repartition(5), 1)
    assert first.exceptAll(again).count() == 0
    assert first.exceptAll(wl.workload_actions(seq, 2)).count() > 0
    share = {r.action: r["count"] / 20_000 for r in first.groupBy("action").count().collect()}
    assert share == pytest.approx({"query": 0.5, "insert": 0.2, "update": 0.3}, abs=0.02)
    low = first.agg(F.min("user_id"), F.max("user_id"), F.min("amount"), F.max("amount")).first()
    assert low[0] == 1 and low[1] == 100 and low[2] >= 10 and low[3] <= 1000


def test_run_summary(spark):
    m = [(i, "w", "插入成功：影响行数=2" if i % 2 else "插入失败：" + str(i), dt.datetime(2024, 1, 1, 0, 0, i)) for i in range(40)]
    df = spark.createDataFrame(m, "i int, run string, message string, ts timestamp_ntz")
    r = wl.run_summary(df, "run", "i").first()
    assert (r.total, r.successes, r.failures, r.affected, r.elapsed) == (40, 20, 20, 40, 39.0)
    assert r.first_failures == "; ".join(f"插入失败：{i}" for i in range(0, 20, 2))


def test_pick_changes_one_row_per_key(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"), F.when(F.col("id") < 60, "insert").otherwise("other").alias("op"))
    hit = F.col("op") == "insert"
    changed = wl.pick_and_change(df, ["k"], "id", hit, {"op": F.lit("update")}, 7)
    assert rows(changed.filter("op = 'update'").groupBy("k").count()) == [(0, 1), (1, 1), (2, 1)]
    assert wl.pick_and_remove(df, ["k"], "id", hit, 7).count() == 97
    assert wl.random_pick(df, ["k"], "id", 7).count() == 3
