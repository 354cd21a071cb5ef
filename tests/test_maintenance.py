import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows, ts
from tidewright.operators import maintenance as mt
from tidewright.sinks.tables import replace_batch

STATS = "table_name string, blocks bigint, num_rows bigint, avg_row_len bigint"


def test_wasted_space(spark):
    stats = spark.createDataFrame(
        [("A", 200_000, 1_000_000, 500), ("B", 0, 10, 10), ("C", 128_000, 1, 1), ("D", 200_000, 3_000_000, 500)], STATS
    )
    parted = spark.createDataFrame([("A",), ("A",)], "table_name string")
    (r,) = mt.wasted_space(stats, parted, "20240101").collect()
    assert (r.tabname, r.is_parttab, r.rate) == ("A", 1, "30.5%")
    assert (r.current_size, r.real_size, r.hwm_size) == (Decimal("1562.50"), Decimal("476.84"), Decimal("1085.66"))


def test_whole_percent_has_no_dot(spark):
    stats = spark.createDataFrame([("A", 200_000, 100, 4_915_200)], STATS)
    assert mt.space_columns(stats).first().rate == "30%"


def test_fragmented_partitions_compare_percent(spark):
    stats = spark.createDataFrame([("A", 200_000, 1_000, 500), ("B", 200_000, 1_000_000, 500)], STATS)
    assert rows(mt.fragmented_partitions(stats), "table_name") == [("A",)]
    assert mt.fragmented_partitions(stats, max_percent=60).count() == 2


def test_empty_partitions_keep_the_first(spark):
    parts = spark.createDataFrame([("P1",), ("P2",), ("P3",)], "partition_name string")
    data = spark.createDataFrame([("P2",)] * 100, "partition_name string")
    assert rows(mt.empty_partitions(parts, data)) == [("P3",)]


def test_indexes_to_rebuild(spark):
    tables = spark.createDataFrame([("A", 0), ("B", 1)], "table_name string, is_parttab int")
    ix = spark.createDataFrame(
        [("A", "a1", "NORMAL"), ("A", "a2", "LOB"), ("B", "b1", "NORMAL"), ("B", "b2", "NORMAL"), ("C", "c", "NORMAL")],
        "table_name string, index_name string, index_type string",
    )
    parted = spark.createDataFrame([("B", "b2"), ("A", "a1")], "table_name string, index_name string")
    assert rows(mt.indexes_to_rebuild(tables, ix, parted), "index_name") == [("a1",), ("b1",)]


def test_tables_without_key_match_system_names_whole(spark):
    tables = spark.createDataFrame([("sys", "t"), ("sys_app", "t"), ("app", "t"), ("app", "u")], "table_schema string, table_name string")
    keys = spark.createDataFrame([("app", "t", "PRIMARY"), ("app", "u", "uk")], "table_schema string, table_name string, constraint_name string")
    assert rows(mt.tables_without_key(tables, keys)) == [("app", "u"), ("sys_app", "t")]


def test_property_changes(spark):
    t = [("s", "a", "OLAP", "", '{"replication_num":"3"}', None), ("s", "b", "OLAP", "dt", '{"x":"1","replication_num":"3"}', None),
         ("s", "c", "OLAP", "dt", '{"replication_num":"1"}', None), ("s", "v", "MATERIALIZED_VIEW", "", '{"replication_num":"3"}',
          'CREATE MATERIALIZED VIEW `v` PROPERTIES ("replication_num" = "3") AS SELECT 1')]
    df = spark.createDataFrame(t, "TABLE_SCHEMA string, TABLE_NAME string, TABLE_ENGINE string, PARTITION_KEY string, PROPERTIES string, create_statement string")
    assert rows(mt.property_changes(df), "statement") == sorted([
        ('ALTER TABLE `s`.`a` SET ("default.replication_num" = "1")',),
        ('ALTER TABLE `s`.`b` SET ("default.replication_num" = "1")',),
        ('ALTER TABLE `s`.`b` MODIFY PARTITION (*) SET("replication_num"="1")',),
        ('CREATE MATERIALIZED VIEW `s`.`v` PROPERTIES ("replication_num" = "1") AS SELECT 1',),
    ], key=repr)


CONTROL = "tabname string, tabdate timestamp_ntz, tabstatus string, tabinterval string, tabenable string, tabddl string"
DDL = "create table t_datedemo(a int); ;create index ix_datedemo on t_datedemo(a)"


def control(spark, interval, status="0", enable="1", date=dt.datetime(2024, 5, 17)):
    return spark.createDataFrame([("t_log", date, status, interval, enable, DDL)], CONTROL)


@pytest.mark.parametrize(
    "interval,first,last,n,advanced",
    [
        ("D", "T_LOG_20240501", "T_LOG_20240531", 31, dt.date(2024, 6, 1)),
        ("M", "T_LOG_202405", "T_LOG_202405", 1, dt.date(2024, 6, 1)),
        ("S", "T_LOG_2024_S2", "T_LOG_2024_S2", 1, dt.date(2024, 7, 1)),
        ("Y", "T_LOG_2024", "T_LOG_2024", 1, dt.date(2025, 1, 1)),
    ],
)
def test_calendar(spark, interval, first, last, n, advanced):
    none = spark.createDataFrame([], "table_name string")
    now = ts("2024-04-10 00:00:00")
    plan = mt.calendar_plan(control(spark, interval), none, now)
    names = sorted({r.table_name for r in plan.collect()})
    assert (names[0], names[-1], len(names), plan.count()) == (first, last, n, 2 * n)
    assert mt.advance_controls(control(spark, interval), now).first().tabdate == advanced
    existing = spark.createDataFrame([(first,)], "table_name string")
    assert mt.calendar_plan(control(spark, interval), existing, now).count() == 2 * (n - 1)


def test_calendar_statements_and_leap_month(spark):
    none = spark.createDataFrame([], "table_name string")
    plan = mt.calendar_plan(control(spark, "D", date=dt.datetime(2024, 2, 3)), none, ts("2024-04-10 00:00:00"))
    assert plan.select("table_name").distinct().count() == 29
    got = [r.statement for r in plan.filter("table_name = 'T_LOG_20240229'").orderBy("piece_no").collect()]
    assert got == ["create table t_20240229(a int)", "create index ix_20240229 on t_20240229(a)"]


def test_calendar_not_due(spark):
    none = spark.createDataFrame([], "table_name string")
    assert mt.calendar_plan(control(spark, "D"), none, ts("2024-03-31 00:00:00")).count() == 0
    now = ts("2024-04-10 00:00:00")
    assert mt.calendar_plan(control(spark, "D", status="1"), none, now).count() == 0
    assert mt.calendar_plan(control(spark, "D", enable="0"), none, now).count() == 0
    assert mt.advance_controls(control(spark, "D", status="1"), now).first().tabstatus == "1"


def test_control_transition(spark):
    c = spark.createDataFrame(
        [(i, s, "M", dt.date(2024, 1, 31)) for i, s in enumerate(["0", "2", "1", "0"])],
        "job int, tabstatus string, tabinterval string, tabdate date",
    )
    o = spark.createDataFrame([(0, True), (1, False), (2, True)], "job int, ok boolean")
    got = rows(mt.control_transition(c, o, "job"))
    old, new = dt.date(2024, 1, 31), dt.date(2024, 2, 1)
    assert got == [(0, "0", new), (1, "2", old), (2, "1", old), (3, "1", old)]


def test_split_rows(spark):
    df = spark.createDataFrame([(1, "a;b;"), (2, None), (3, "a||b"), (4, "")], "i int, s string")
    assert [(r.i, r.piece) for r in mt.split_rows(df, ["i"], "s", ";").orderBy("i", "piece_no").collect()] == [
        (1, "a"), (1, "b"), (1, None), (2, None), (3, "a||b"), (4, None)
    ]
    assert rows(mt.split_rows(df.filter("i = 3"), ["i"], "s", "||"), "piece") == [("a",), ("b",)]


def test_sequence_steps(spark):
    top = [(10**6, 100), (10**6 + 1, 10**4), (10**9, 10**4), (10**13, 10**5), (10**13 + 1, 10**7)]
    df = spark.createDataFrame([("SEQ_A", v) for v, _ in top] + [("SQXA", 1), ("SEQ", 1), ("x", 1)], "sequence_name string, max_value bigint")
    got = [(r.max_value, r.step) for r in mt.sequence_steps(df).orderBy("max_value").collect()]
    assert got == [(1, 100), *top]


def test_job_log_rows(spark):
    df = spark.createDataFrame(
        [(1, "p", "1", "x" * 4000, 1), (2, "p", "1", "x" * 4001, 1), (3, None, "1", "y", 1), (4, "p" * 81, "1", "y", 1),
         (5, "p", "1" * 11, "y", 1), (6, "p", "1", "y", None), (7, "p", "1", None, 1)],
        "log_id bigint, proc_name string, proc_status string, proc_desc string, s int",
    ).withColumns({"starttime": F.when(F.col("s") == 1, ts("2024-01-01 00:00:00")), "endtime": ts("2024-01-02 00:00:00")})
    got = {r.log_id: r for r in mt.job_log_rows(df, ts("2024-02-01 00:00:00")).collect()}
    assert {i for i, r in got.items() if r.proc_status == "1"} == {1, 7}
    assert {i: r.proc_desc for i, r in got.items() if r.proc_status == "0"} == {
        2: "proc_desc too long: 4001", 3: "proc_name is null", 4: "proc_name too long: 81", 5: "proc_status too long: 11", 6: "starttime is null"}
    assert {r.starttime.month for i, r in got.items() if r.proc_status == "0"} == {2}


def test_controls_of_one_name_advance_as_rows(spark):
    rows_ = control(spark, "M").union(control(spark, "M"))
    assert mt.advance_controls(rows_, ts("2024-01-15 00:00:00")).count() == 2


def test_property_names_with_a_dot(spark):
    t = spark.createDataFrame([("d", "t", "OLAP", "", '{"a.b": "3"}', "x")], "TABLE_SCHEMA string, TABLE_NAME string, TABLE_ENGINE string, PARTITION_KEY string, PROPERTIES string, create_statement string")
    assert mt.property_changes(t, "a.b").count() == 1


def test_replace_batch_leaves_other_batches(spark, tmp_path):
    path = str(tmp_path / "hwm")
    day = spark.createDataFrame([("1", "a"), ("2", "b")], "batchno string, tabname string")
    replace_batch(day, path)
    replace_batch(spark.createDataFrame([("2", "c"), ("2", "d")], day.schema), path)
    assert rows(spark.read.schema(day.schema).parquet(path), "batchno", "tabname") == [("1", "a"), ("2", "c"), ("2", "d")]


def test_sql_functions(spark):
    from tidewright.functions.sql_functions import register

    register(spark)
    got = spark.sql("""SELECT t.i, s.piece_no, s.piece FROM VALUES (1, 'a;b;', ';'), (2, NULL, ';'), (3, 'x||y', '||'),
        (4, 'a', NULL) t(i, v, d), LATERAL f_str_split(t.v, t.d) s ORDER BY 1, 2""").collect()
    assert [tuple(r) for r in got] == [(1, 1, "a"), (1, 2, "b"), (1, 3, None), (2, 1, None), (3, 1, "x"), (3, 2, "y")]
    texts = spark.sql("SELECT f_rollback_time(1000, 800, 5) a, f_rollback_time(9, 9, 5) b").first()
    assert texts.a == "回滚估计时间 : 00:00:20 待回滚行数 800" and texts.b is None
