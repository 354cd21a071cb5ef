"""Composed jobs that run the statements of a plan and leave a log: a row for each step that worked and each that failed."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.maintenance import control_transition, due_controls, mark_done

RAN, FAILED = "ok", "message"


def executed(plan: DataFrame, unit: str, order: list[str], connect: Callable[[], Callable[[str], object]], partitions: int = 8) -> DataFrame:
    """``plan`` with ``ok`` and ``message`` for each statement, run in order within its unit (such as a table).

    ``connect`` is called once in a task and gives what runs one statement and raises if it fails; after a failure
    the rest of the unit is not run (``ok`` is NULL). Units run side by side in at most ``partitions`` tasks, rows stream through them, and a
    task that is lost runs its statements again, so they must bear that. The result is to be written once: each reading
    of it runs the statements.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plan.schema)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, broken = connect(), (None, False)
        for batch in batches:
            found = []
            for name, statement in zip(batch[unit], batch["statement"]):
                if broken != (name, True):
                    try:
                        call(statement)
                        found.append((True, None))
                        continue
                    except Exception as failure:  # whatever the other side raises is this step's outcome
                        found.append((False, str(failure)))
                        broken = (name, True)
                else:
                    found.append((None, None))
            yield batch.assign(ok=pd.array([ok for ok, _ in found], "boolean"), message=[message for _, message in found])

    dealt = plan.repartition(partitions, unit).sortWithinPartitions(unit, *order)
    return dealt.mapInPandas(run, f"{fields}, ok boolean, message string")


def outcomes(done: DataFrame, units: list[str], order: list[str]) -> DataFrame:
    """One row per unit: whether every statement worked, how many were run, and the statement and message of the first failure."""
    failed = F.when(~F.col("ok"), F.struct(*order))
    first = F.min_by(F.struct("statement", "message"), failed)
    return done.groupBy(*units).agg(
        F.coalesce(F.bool_and("ok"), F.lit(False)).alias("ok"), F.count("ok").alias("n_run"), first.alias("_first")
    ).select(*units, "ok", "n_run", F.col("_first.statement").alias("statement"), F.col("_first.message").alias("message"))


def log_entries(rows: DataFrame, proc_name: str, started: Column, ended: Column, text: Column, status: Column | None = None) -> DataFrame:
    """Entries of a job log, one for each row, of status 1 if none is given; their numbers are unique within this run."""
    return rows.select(
        F.monotonically_increasing_id().alias("log_id"), F.lit(proc_name).alias("proc_name"),
        started.alias("starttime"), ended.alias("endtime"), (F.lit("1") if status is None else status).alias("proc_status"), text.alias("proc_desc"),
    )


# What the calendar job writes into its log.
CALENDAR_JOB, CREATED, RUN, EXCEPTION = "pkg_tab_tool.proc_crt_tab", "created successful", "run successful", "Exception:"


def calendar_run(controls: DataFrame, done: DataFrame, now: Column, started: Column, ended: Column) -> tuple[DataFrame, DataFrame]:
    """The log and the control rows after the statements of ``calendar_plan`` were run (``done``).

    Every table that was created is an entry, then every control row whose tables all were, or the first failure among them.
    A control row without missing tables counts as run. Those that ran move one period on and are ready, those
    that failed get status 2, others stay as they are.
    """
    stamp = F.date_format(now, "yyyyMMdd HH:mm:ss")
    tables = outcomes(done, ["tabname", "table_name"], ["piece_no"])
    created = log_entries(tables.filter("ok"), CALENDAR_JOB, started, ended, F.concat_ws(",", stamp, "table_name", F.lit(CREATED)))
    bad = tables.filter("NOT ok").groupBy("tabname").agg(F.min_by(F.struct("table_name", "statement", "message"), F.col("table_name")).alias("bad"))
    due = due_controls(controls, now).select("tabname").join(bad, "tabname", "left").withColumn("ok", F.col("bad").isNull())
    failure = F.concat(F.lit(EXCEPTION), stamp, F.lit(","), "bad.table_name", F.lit(","), "bad.message", F.lit("->"), "bad.statement")
    text = F.when(F.col("ok"), F.concat_ws(",", stamp, "tabname", F.lit(RUN))).otherwise(failure)
    log = created.unionByName(log_entries(due, CALENDAR_JOB, started, ended, text))
    worked = due.select("tabname", "ok")
    # Rows that are not due were not picked up.
    idle = controls.join(worked, "tabname", "left_anti")
    after = control_transition(controls.join(worked.select("tabname"), "tabname", "left_semi"), worked, "tabname")
    same = idle.select("tabname", "tabstatus", F.col("tabdate").cast("date").alias("tabdate"))
    return log, after.unionByName(same)


# What the space job writes into its log.
SPACE_JOB = "proc_clear_tabhwm"
SPACE_STEPS = ("step1:程序开始", "step2:插入到tb_clear_hwm", "step3:已清理非分区表", "step4:已清理分区表")


def space_run(report: DataFrame, done: DataFrame, started: Column, ended: Column) -> tuple[DataFrame, DataFrame]:
    """The log and the report after the statements of ``action_plan`` were run (``done``).

    Start and report are an entry each, then the plain and the partitioned tables: an entry of status 1 where every statement
    worked, else one of status 2 with the statement and message of the first table that failed. Tables are worked on
    side by side, so a failure ends its own table only. A table is marked in the report when all its statements
    worked; one without statements has nothing left to do and is marked too.
    """
    tables = outcomes(done, ["table_name"], ["step", "statement"])
    bad = tables.filter("NOT ok").select(F.col("table_name").alias("tabname"), "statement", "message")
    states = report.select("tabname", "is_parttab").join(bad, "tabname", "left").withColumn("failed", F.col("statement").isNotNull())
    failure = F.concat_ws("->", "statement", "message")
    parts = states.groupBy("is_parttab").agg(F.min_by(failure, F.when(F.col("failed"), F.col("tabname"))).alias("failure"))
    steps = report.sparkSession.createDataFrame([(k + 1, label, k - 2 if k > 1 else None) for k, label in enumerate(SPACE_STEPS)], "step int, label string, part int")
    entries = steps.join(parts, F.col("part") == F.col("is_parttab"), "left")
    status = F.when(F.col("failure").isNull(), "1").otherwise("2")
    log = log_entries(entries, SPACE_JOB, started, ended, F.coalesce("failure", "label"), status)
    return log, mark_done(report, states.filter("NOT failed"))
