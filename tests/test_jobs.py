from pyspark.sql import functions as F

from tests.conftest import rows, ts
from tidewright.operators import jobs
from tidewright.operators.maintenance import calendar_plan


def refusing():
    def run(statement):
        if "bad" in statement:
            raise RuntimeError(f"refused {statement}")

    return run


def test_a_unit_stops_at_its_first_failure(spark):
    plan = [("t1", k, f"s{k}") for k in range(3)] + [("t2", 0, "s"), ("t2", 1, "bad 1"), ("t2", 2, "never"), ("t2", 3, "bad 3")] + [("t3", 0, "bad 0")]
    df = spark.createDataFrame(plan, "t string, k int, statement string").repartition(5)
    done = jobs.executed(df, "t", ["k"], refusing, 2).cache()
    assert rows(done, "t", "k", "ok", "message") == sorted(
        [("t1", k, True, None) for k in range(3)]
        + [("t2", 0, True, None), ("t2", 1, False, "refused bad 1"), ("t2", 2, None, None), ("t2", 3, None, None), ("t3", 0, False, "refused bad 0")],
        key=repr,
    )
    assert rows(jobs.outcomes(done, ["t"], ["k"])) == sorted(
        [("t1", True, 3, None, None), ("t2", False, 2, "bad 1", "refused bad 1"), ("t3", False, 1, "bad 0", "refused bad 0")], key=repr
    )
    assert jobs.executed(df.limit(0), "t", ["k"], refusing).collect() == []


def test_calendar_run_logs_and_moves_control_rows(spark):
    now = ts("2024-03-05 10:00:00")
    day = F.lit("2024-03-01").cast("timestamp_ntz")
    controls = spark.createDataFrame(
        [("a", "0", "M", "1", "create datedemo;index datedemo"), ("b", "0", "M", "1", "create datedemo;bad datedemo"), ("c", "1", "M", "1", "create datedemo"),
         ("d", "0", "Y", "1", "create datedemo"), ("e", "0", "M", "0", "create datedemo")],
        "tabname string, tabstatus string, tabinterval string, tabenable string, tabddl string",
    ).withColumn("tabdate", day)
    existing = spark.createDataFrame([("D_2024",)], "table_name string")
    done = jobs.executed(calendar_plan(controls, existing, now), "table_name", ["piece_no"], refusing).cache()
    log, after = jobs.calendar_run(controls, done, now, now, now)
    stamp = "20240305 10:00:00"
    assert sorted(r.proc_desc for r in log.collect()) == sorted(
        [f"{stamp},A_202403,created successful", f"{stamp},a,run successful", f"{stamp},d,run successful",
         f"Exception:{stamp},B_202403,refused bad 202403->bad 202403"]
    )
    assert rows(after.select("tabname", "tabstatus", F.col("tabdate").cast("string"))) == [
        ("a", "0", "2024-04-01"), ("b", "2", "2024-03-01"), ("c", "1", "2024-03-01"), ("d", "0", "2025-01-01"), ("e", "0", "2024-03-01")
    ]


def test_space_run_logs_steps_and_marks_tables(spark):
    now = ts("2024-03-05 10:00:00")
    report = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1), ("e", 1)], "tabname string, is_parttab int").withColumn("status", F.lit("0"))
    plan = [("a", 1, "move a"), ("a", 4, "index a"), ("b", 1, "move b"), ("c", 2, "bad c"), ("c", 3, "never"), ("d", 2, "drop d"), ("d", 4, "bad d")]
    done = jobs.executed(spark.createDataFrame(plan, "table_name string, step int, statement string"), "table_name", ["step", "statement"], refusing).cache()
    log, after = jobs.space_run(report, done, now, now)
    assert rows(log, "proc_name", "proc_status", "proc_desc") == sorted(
        [(jobs.SPACE_JOB, "1", label) for label in jobs.SPACE_STEPS[:3]] + [(jobs.SPACE_JOB, "2", "bad c->refused bad c")], key=repr
    )
    assert rows(after, "tabname", "status") == [("a", "1"), ("b", "1"), ("c", "0"), ("d", "0"), ("e", "1")]
    # Nothing to do: every step is logged, nothing is marked.
    log, after = jobs.space_run(report.limit(0), done.limit(0), now, now)
    assert log.filter("proc_status = '1'").count() == 4 and after.count() == 0
