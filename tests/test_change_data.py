import json
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewright.operators import change_data as cd
from tidewright.plans.tables import feed
from tidewright.sinks.tables import write_script
from tidewright.sources.change_feed import FEED_SCHEMA, canal_changes, kafka_options, read_feed

TYPES = {"id": "int", "v": "int", "name": "varchar(20)", "note": "text", "doc": "json", "day": "date"}


def event(op, before, after, pos=1, time=100, tbl="t", db="db", file="f.000001", gtid=None):
    return (db, tbl, op, time, file, pos, gtid, before, after, TYPES)


def feed_of(spark, events):
    """Events as a feed. Images pass as JSON text: Python dicts would lose their order."""
    text = [(*e[:7], *[None if m is None else json.dumps(m) for m in e[7:]]) for e in events]
    flat = re.sub(r"map<string,string>", "string", FEED_SCHEMA)
    df = spark.createDataFrame(text, flat)
    return df.withColumns({c: F.from_json(c, "map<string,string>") for c in ("before", "after", "types")})


def undo(spark, *events, **kw):
    return cd.undo_statements(feed_of(spark, events), **kw).orderBy("log_pos").collect()


def test_insert_undo_uses_is_null(spark):
    (r,) = undo(spark, event("insert", None, {"id": "1", "name": "a", "note": None}))
    assert r.sql == "INSERT INTO `db`.`t`(`id`,`name`,`note`) VALUES (1,'a',NULL);"
    assert r.rollback_sql == "DELETE FROM `db`.`t` WHERE `id`=1 AND `name`='a' AND `note` IS NULL;"
    assert r.replace_sql is None


def test_update_undo_and_replace(spark):
    (r,) = undo(spark, event("update", {"id": "1", "v": "2"}, {"id": "1", "v": "3"}))
    assert r.sql == "UPDATE `db`.`t` SET `id`=1,`v`=3 WHERE `id`=1 AND `v`=2;"
    assert r.rollback_sql == "UPDATE `db`.`t` SET `id`=1,`v`=2 WHERE `id`=1 AND `v`=3;"
    assert r.replace_sql == "REPLACE INTO `db`.`t` (`id`,`v`) VALUES (1,2);"


def test_delete_undo(spark):
    (r,) = undo(spark, event("delete", {"id": "1", "v": "2"}, None))
    assert r.sql == "DELETE FROM `db`.`t` WHERE `id`=1 AND `v`=2;"
    assert r.rollback_sql == "INSERT INTO `db`.`t`(`id`,`v`) VALUES (1,2);"


def test_quotes_json_dates_and_missing_schema(spark):
    (r,) = undo(
        spark,
        event("delete", {"name": "O'Brien", "doc": '{"k": 1}', "day": "2024-01-05"}, None, db=None),
        limit_one=True,
    )
    assert r.rollback_sql == "INSERT INTO `t`(`name`,`doc`,`day`) VALUES ('O''Brien','{\"k\": 1}','2024-01-05');"
    assert r.sql.endswith("LIMIT 1;")


def test_filter_bounds_are_inclusive_and_operation_is_checked(spark):
    events = [event("insert", None, {"id": str(i)}, pos=i, time=i) for i in range(5)]
    feed_df = feed_of(spark, events)
    kept = cd.filter_changes(feed_df, "1970-01-01 00:00:01", "1970-01-01 00:00:03", "INSERT", ["t"])
    assert [r.log_pos for r in kept.orderBy("log_pos").collect()] == [1, 2, 3]
    assert cd.filter_changes(feed_df, from_position=("f.000001", 3)).count() == 2
    with pytest.raises(ValueError):
        cd.filter_changes(feed_df, operation="truncate")


def test_feed_check_needs_both_settings():
    assert cd.feed_usable("row", "FULL")
    assert not cd.feed_usable("ROW", "MINIMAL") and not cd.feed_usable("MIXED", "FULL")


def test_script_runs_backwards_and_is_written_in_order(spark, tmp_path):
    events = [
        event("insert", None, {"id": str(i)}, pos=i % 10, time=1700000000 + i, file=f"f.{i // 10:06d}")
        for i in range(40)
    ]
    script = cd.recovery_script(feed_of(spark, events))
    got = script.orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(1, 41))
    assert [(r.log_file, r.log_pos) for r in got] == sorted(((r.log_file, r.log_pos) for r in got), reverse=True)
    lines = got[0].block.split("\n")
    assert lines[0] == "-- SQL执行时间:2023-11-15 06:13:59" and lines[-1].startswith("-- ---")
    write_script(script, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out" / "db=db" / "tbl=t").glob("part-*.txt")))
    ids = [int(x) for x in re.findall(r"WHERE `id`=(\d+);", text)]
    assert ids == list(range(39, -1, -1))


def apply_events(state, events, undo_them):
    """Replay decoded events on a dict of rows, forwards or as their undo, newest first."""
    for e in reversed(events) if undo_them else events:
        old, new = (e.after, e.before) if undo_them else (e.before, e.after)
        if old is not None:
            state.pop(old["id"], None)
        if new is not None:
            state[new["id"]] = new
    return state


def test_feed_then_undo_restores_the_state(spark):
    """Insert, update and delete on three keys; undoing backwards gives the first state."""
    a = {"id": "1", "v": "1"}
    b = {"id": "1", "v": "2"}
    c = {"id": "2", "v": "9"}
    events = [
        event("insert", None, c, pos=1, time=5), event("update", a, b, pos=2, time=5),
        event("delete", c, None, pos=3, time=6), event("insert", None, {"id": "3", "v": "0"}, pos=4, time=6),
    ]
    ordered = feed_of(spark, events).orderBy("log_pos").collect()
    start = {"1": a}
    after = apply_events(dict(start), ordered, undo_them=False)
    assert set(after) == {"1", "3"} and after["1"]["v"] == "2"
    assert apply_events(after, ordered, undo_them=True) == start


def test_latest_state_smoke(spark):
    events = [
        event("insert", None, {"id": "1", "v": "222"}, 1), event("insert", None, {"id": "2", "v": "333"}, 2),
        event("update", {"id": "1", "v": "222"}, {"id": "1", "v": "223"}, 3),
        event("delete", {"id": "2", "v": "333"}, None, 4),
    ]
    state = cd.state_as_of(feed_of(spark, events), "id")
    assert [(r.id, r.image["v"]) for r in state.collect()] == [("1", "223")]


U1, U2 = "3e11fa47-71ca-11e1-9e33-c80aa9429562", "4e11fa47-71ca-11e1-9e33-c80aa9429562"


@pytest.mark.parametrize(
    "executed,retrieved,want",
    [
        (f"{U1}:1-100,{U2}:7", f"{U1}:50-120", [(U1, 101)]),
        (f"{U1}:1-100,{U2}:7", f"{U1}:50-120,{U2}:2-9", [(U1, 101), (U2, 8)]),
        (f"{U1}:1-5:7-9", f"{U1}:1-20", [(U1, 10)]),
        ("", f"{U1}:3-9", [(U1, 10)]),
        (f"{U2}:1-5", f"{U1}:1-20", []),
    ],
)
def test_next_gtid(spark, executed, retrieved, want):
    status = spark.createDataFrame([(1, executed, retrieved)], "replica int, executed string, retrieved string")
    assert rows(cd.next_gtid(status, "replica"), "uuid", "next_no") == want


def test_repaired_replica_equals_the_source_but_for_skipped_deletes(spark, sf_dir):
    changes = feed(spark, sf_dir, before=False)
    source, replica = cd.key_state(changes, "id"), cd.state_as_of(changes, "id", "2024-01-10 00:00:00")
    plan = cd.reconcile_plan(source, replica, "id")
    repaired = {r.id: r.image for r in cd.apply_repairs(replica, plan, "id").collect()}
    skipped = {r.id for r in plan.filter("action = 'skip'").collect()}
    live = {r.id: r.image for r in cd.state_as_of(changes, "id").collect()}
    assert {k: v for k, v in repaired.items() if k not in skipped} == live
    assert skipped and skipped.isdisjoint(live)


def test_reconcile_actions(spark):
    source = spark.createDataFrame(
        [("db", "t", "1", "insert", "f", 1, {"id": "1", "v": "1"}, TYPES),
         ("db", "t", "2", "update", "f", 2, {"id": "2", "v": "2"}, TYPES),
         ("db", "t", "3", "delete", "f", 3, None, TYPES),
         ("db", "t", "4", "insert", "f", 4, {"id": "4", "v": "4"}, TYPES)],
        "db string, tbl string, id string, op string, log_file string, log_pos bigint, "
        "image map<string,string>, types map<string,string>",
    )
    replica = spark.createDataFrame(
        [("db", "t", "2", {"id": "2", "v": "0"}), ("db", "t", "3", {"id": "3", "v": "3"}),
         ("db", "t", "4", {"id": "4", "v": "4"})],
        "db string, tbl string, id string, image map<string,string>",
    )
    plan = cd.reconcile_plan(source, replica, "id")
    assert rows(plan, "id", "action", "error_code") == [
        ("1", "insert", 1032), ("2", "replace", 1062), ("3", "skip", 1032)
    ]
    assert plan.filter("id = '1'").first().repair_sql in (
        "REPLACE INTO `db`.`t` (`id`,`v`) VALUES (1,1);", "REPLACE INTO `db`.`t` (`v`,`id`) VALUES (1,1);"
    )


def test_canal_messages(spark):
    messages = [
        ('{"data":[{"id":"1","v":"222"},{"id":"2","v":null}],"database":"db","table":"t","type":"INSERT","es":5000}', "0", 1),
        ('{"data":[{"id":"1","v":"223"}],"old":[{"v":"222"}],"database":"db","table":"t","type":"UPDATE","es":6999}', "0", 2),
        ('{"data":[{"id":"2","v":null}],"database":"db","table":"t","type":"DELETE","es":7000}', "0", 3),
        ("not json", "0", 4),
        ('{"database":"db","table":"t","type":"ALTER","es":1}', "0", 5),
    ]
    out = canal_changes(spark.createDataFrame(messages, "value string, log_file string, log_pos bigint"))
    got = [(r.log_pos, r.row_no, r.op, r.event_time, r.before, r.after) for r in out.orderBy("log_pos", "row_no").collect()]
    assert got == [
        (1, 0, "insert", 5, None, {"id": "1", "v": "222"}),
        (1, 1, "insert", 5, None, {"id": "2", "v": None}),
        (2, 0, "update", 6, {"id": "1", "v": "222"}, {"id": "1", "v": "223"}),
        (3, 0, "delete", 7, {"id": "2", "v": None}, None),
    ]


def test_feed_files_and_topic_options(spark, tmp_path):
    path = str(tmp_path / "feed")
    feed_of(spark, [event("insert", None, {"id": "1"})]).write.parquet(path)
    assert read_feed(spark, path).first().after == {"id": "1"}
    assert kafka_options("h:9092", "t")["startingOffsets"] == "earliest"
    assert kafka_options("h:9092", "t", 1720144311000)["startingTimestamp"] == "1720144311000"


def test_transaction_slice(spark):
    events = [event("insert", None, {"id": str(i)}, pos=i, gtid=f"{U1}:{i // 2}") for i in range(6)]
    wanted = spark.createDataFrame([(f"{U1}:1",)], "gtid string")
    got = cd.transaction_slice(feed_of(spark, events), wanted)
    assert rows(got, "log_pos") == [(2,), (3,)]


def test_names_keep_their_order(spark):
    image = {c: "1" for c in "zyxba"}
    (r,) = undo(spark, event("delete", image, None))
    assert r.rollback_sql == "INSERT INTO `db`.`t`(`z`,`y`,`x`,`b`,`a`) VALUES ('1','1','1','1','1');"


def test_update_that_changes_the_key_removes_the_old_one(spark):
    events = [
        event("insert", None, {"id": "1", "v": "1"}, 1), event("insert", None, {"id": "2", "v": "2"}, 2),
        event("update", {"id": "1", "v": "1"}, {"id": "9", "v": "1"}, 3),
    ]
    state = cd.state_as_of(feed_of(spark, events), "id")
    assert rows(state.select("id", F.col("image")["v"])) == [("2", "2"), ("9", "1")]


LOG = "server int, log_file string, log_pos long, kind string, gtid string"


def raw_log(spark, *events):
    """``(file number, kind, gtid)`` in order; names of files change their width on the way."""
    numbered = [(7, f"bin.{file}", k, kind, gtid) for k, (file, kind, gtid) in enumerate(events)]
    return spark.createDataFrame(numbered, LOG).repartition(3)


def test_markers_are_carried_to_the_rows_behind_them(spark):
    log = raw_log(
        spark,
        (99, "insert", None),  # 0: before any transaction
        (99, "gtid", "u:1"), (99, "BEGIN", None), (99, "insert", None), (100, "update", None), (100, "xid", None),
        (100, "delete", None),  # 6: behind an end
        (100, "begin", None), (101, "insert", None), (101, "COMMIT", None),  # anonymous
        (101, "gtid", "v:5"), (101, "begin", None), (101, "insert", None), (101, "rollback", None),
        (101, "gtid", "u:2"), (101, "insert", None),  # 15: the next one comes before its end
        (102, "gtid", "u:3"), (102, "begin", None), (103, "delete", None),  # 18: the log ends
    )
    got = cd.with_transactions(log, ["server"])
    assert rows(got, "log_pos", "gtid", "begin_file", "begin_pos", "outcome") == sorted(
        [
            (0, None, None, None, None), (3, "u:1", "bin.99", 1, "committed"), (4, "u:1", "bin.99", 1, "committed"),
            (6, None, None, None, None), (8, None, "bin.100", 7, "committed"), (12, "v:5", "bin.101", 10, "rolled back"),
            (15, "u:2", "bin.101", 14, "open"), (18, "u:3", "bin.102", 16, "open"),
        ],
        key=repr,
    )
    wanted = spark.createDataFrame([("u:1",), ("v:5",)], "gtid string")
    assert [r[0] for r in rows(cd.transaction_slice(got, wanted), "log_pos")] == [12, 3, 4]


def test_span_ends_at_the_next_number_of_the_same_uuid(spark):
    log = raw_log(
        spark, (1, "gtid", "u:2"), (1, "insert", None), (1, "gtid", "u:1"), (1, "insert", None), (2, "gtid", "v:9"), (2, "update", None),
        (2, "gtid", "u:2"), (2, "delete", None),
    )
    def span(gtid):
        wanted = spark.createDataFrame([(7, gtid), (7, gtid)], "server int, gtid string")
        return sorted(r.log_pos for r in cd.transaction_span(log, wanted, ["server"]).collect())

    assert (span("u:1"), span("v:9"), span("u:7")) == ([3, 5], [5, 7], [])


def test_empty_log(spark):
    assert cd.with_transactions(spark.createDataFrame([], LOG), ["server"]).collect() == []
