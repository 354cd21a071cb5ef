"""Wasted space, partitions, keys, properties, calendar tables, sequences, control rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.measures import allocated_mib, percent_label, rounded, used_mib
from tidewright.functions.text import pieces

# Schemas that belong to the server.
SYSTEM_SCHEMAS = ["information_schema", "performance_schema", "mysql", "sys", "_statistics_"]


def user_schemas(df: DataFrame, schema_col: str) -> DataFrame:
    """Drop rows of system schemas; names are compared whole."""
    return df.filter(~F.col(schema_col).isin(SYSTEM_SCHEMAS))


def space_columns(stats: DataFrame) -> DataFrame:
    """Allocated, real and wasted MiB and the fill ratio; empty segments are left out."""
    allocated = allocated_mib(F.col("blocks"))
    real = used_mib(F.col("num_rows"), F.col("avg_row_len"))
    ratio = F.try_divide(real, allocated)
    return stats.filter(F.col("blocks") != 0).withColumns(
        {
            "ratio": ratio,
            "current_size": rounded(allocated, 2).cast("decimal(18,2)"),
            "real_size": rounded(real, 2).cast("decimal(18,2)"),
            "hwm_size": rounded(allocated - real, 2).cast("decimal(18,2)"),
            "rate": percent_label(ratio),
        }
    )


def wasted_space(
    stats: DataFrame, partitioned: DataFrame, batchno: str, max_ratio: float = 0.6,
    min_mib: float = 1000,
) -> DataFrame:
    """Tables filled below a ratio and above a size, flagged when partitioned."""
    flags = partitioned.select("table_name", F.lit(1).alias("_part")).distinct()
    limit = F.lit(min_mib).cast("decimal(18,2)")
    report = space_columns(stats).filter(
        (F.col("ratio") < max_ratio) & (F.col("current_size") > limit)
    )
    return report.join(flags, "table_name", "left").select(
        F.lit(batchno).alias("batchno"),
        F.col("table_name").alias("tabname"),
        F.lit("0").alias("status"),
        F.coalesce("_part", F.lit(0)).alias("is_parttab"),
        "current_size", "real_size", "hwm_size", "rate",
    )


def fragmented_partitions(
    stats: DataFrame, min_wasted_mib: float = 100, max_percent: float = 0.6
) -> DataFrame:
    """Partitions worth moving. The fill limit is in percent here, not a ratio."""
    percent = F.round(F.col("ratio").cast("decimal(28,9)"), 3) * 100
    return space_columns(stats).filter(
        (F.col("hwm_size") >= F.lit(min_wasted_mib).cast("decimal(18,2)"))
        & (percent < F.lit(max_percent).cast("decimal(18,3)"))
    )


def empty_partitions(
    partitions: DataFrame, rows: DataFrame, keys: list[str] | None = None, keep: str = "P1"
) -> DataFrame:
    """Listed partitions no row falls into; the first partition is never dropped.

    Rows are counted per partition before the join, so a hot partition costs one row.
    """
    keys = keys or ["partition_name"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return partitions.filter(F.col("partition_name") != keep).join(counts, keys, "left_anti")


def indexes_to_rebuild(tables: DataFrame, indexes: DataFrame, partitioned_indexes: DataFrame) -> DataFrame:
    """Indexes to rebuild after a table is moved.

    All but LOB indexes; of a partitioned table only those that are not partitioned too.
    ``tables`` is the report, one row per table, with ``is_parttab``.
    """
    parted = partitioned_indexes.select("table_name", "index_name", F.lit(True).alias("_part")).distinct()
    statement = F.concat(F.lit("alter index "), "index_name", F.lit(" rebuild online"))
    return (
        indexes.filter(F.col("index_type") != "LOB")
        .join(tables.select("table_name", "is_parttab"), "table_name")
        .join(parted, ["table_name", "index_name"], "left")
        .filter((F.col("is_parttab") == 0) | F.col("_part").isNull())
        .select("table_name", "index_name", statement.alias("statement"))
    )


def action_plan(
    report: DataFrame, empty: DataFrame, fragmented: DataFrame, rebuilds: DataFrame
) -> DataFrame:
    """What to run for the reported tables, as statements with their step.

    Plain tables are moved; of partitioned ones the ``empty`` partitions are dropped and the
    ``fragmented`` ones moved (both ``table_name, partition_name``); then indexes are rebuilt.
    """
    plain = report.filter(F.col("is_parttab") == 0).select(F.col("tabname").alias("table_name"))
    parted = report.filter(F.col("is_parttab") == 1).select(F.col("tabname").alias("table_name"))

    def step(rows: DataFrame, number: int, *text) -> DataFrame:
        return rows.select("table_name", F.lit(number).alias("step"), F.concat(*text).alias("statement"))

    alter, part = F.lit("alter table "), F.col("table_name")
    moves = step(plain, 1, alter, part, F.lit(" move online"))
    drops = step(
        empty.join(parted, "table_name", "left_semi"), 2,
        alter, part, F.lit(" drop partition "), "partition_name", F.lit(" update global indexes"),
    )
    part_moves = step(
        fragmented.join(parted, "table_name", "left_semi"), 3,
        alter, part, F.lit(" move partition "), "partition_name", F.lit(" online"),
    )
    indexes = rebuilds.select("table_name", F.lit(4).alias("step"), "statement")
    return moves.unionByName(drops).unionByName(part_moves).unionByName(indexes)


def mark_done(report: DataFrame, done: DataFrame) -> DataFrame:
    """The report with status 1 for the tables that were worked on (``tabname``)."""
    hits = done.select("tabname", F.lit(True).alias("_done")).distinct()
    return (
        report.join(hits, "tabname", "left")
        .withColumn("status", F.when(F.col("_done"), "1").otherwise(F.col("status")))
        .drop("_done")
    )


def tables_without_key(tables: DataFrame, constraints: DataFrame) -> DataFrame:
    """User tables that have no primary-key constraint."""
    primary = constraints.filter(F.col("constraint_name") == "PRIMARY")
    return user_schemas(tables, "table_schema").join(
        primary, ["table_schema", "table_name"], "left_anti"
    )


def property_changes(
    tables: DataFrame, prop: str = "replication_num", old: str = "3", new: str = "1"
) -> DataFrame:
    """ALTER statements for tables, partitions and materialized views holding an old value.

    ``tables`` has ``TABLE_SCHEMA, TABLE_NAME, TABLE_ENGINE, PARTITION_KEY, PROPERTIES,
    create_statement``; views are rebuilt from their rewritten statement.
    """
    hit = tables.filter(F.get_json_object("PROPERTIES", f"$['{prop}']") == old)
    name = F.concat(F.lit("`"), "TABLE_SCHEMA", F.lit("`.`"), "TABLE_NAME", F.lit("`"))
    table_sql = F.concat(F.lit("ALTER TABLE "), name, F.lit(f' SET ("default.{prop}" = "{new}")'))
    partition_sql = F.concat(
        F.lit("ALTER TABLE "), name, F.lit(f' MODIFY PARTITION (*) SET("{prop}"="{new}")')
    )
    view_sql = rewrite_view(F.col("create_statement"), F.col("TABLE_SCHEMA"), prop, old, new)
    olap = F.col("TABLE_ENGINE") == "OLAP"
    plans = F.array_compact(
        F.array(
            F.when(olap, F.struct(F.lit("table").alias("kind"), table_sql.alias("statement"))),
            F.when(
                olap & (F.col("PARTITION_KEY") != ""),
                F.struct(F.lit("partition").alias("kind"), partition_sql.alias("statement")),
            ),
            F.when(
                F.col("TABLE_ENGINE") == "MATERIALIZED_VIEW",
                F.struct(F.lit("view").alias("kind"), view_sql.alias("statement")),
            ),
        )
    )
    return hit.select("TABLE_SCHEMA", "TABLE_NAME", F.explode(plans).alias("p")).select(
        "TABLE_SCHEMA", "TABLE_NAME", "p.kind", "p.statement"
    )


def rewrite_view(statement: Column, schema: Column, prop: str, old: str, new: str) -> Column:
    """Swap a property value and qualify the view name."""
    swapped = F.replace(statement, F.lit(f'"{prop}" = "{old}"'), F.lit(f'"{prop}" = "{new}"'))
    head = "CREATE MATERIALIZED VIEW "
    return F.replace(swapped, F.lit(head), F.concat(F.lit(head + "`"), schema, F.lit("`.")))


# -- calendar tables ---------------------------------------------------------

def is_due(now: Column) -> Column:
    """Whether a control row is enabled, idle and its period starts within a month."""
    month_before = F.trunc(F.add_months("tabdate", -1), "MM")
    return (
        (F.col("tabstatus") != "1") & (F.col("tabenable") == "1")
        & (month_before <= F.trunc(now.cast("date"), "MM"))
    )


def due_controls(controls: DataFrame, now: Column) -> DataFrame:
    """Enabled, idle control rows whose period starts within a month."""
    return controls.filter(is_due(now))


def period_labels(interval: Column, day: Column) -> Column:
    """Labels a control row creates: every day of the month, or its month, quarter or year."""
    days = F.transform(
        F.sequence(F.trunc(day, "MM"), F.last_day(day)), lambda d: F.date_format(d, "yyyyMMdd")
    )
    year = F.date_format(day, "yyyy")
    return (
        F.when(interval == "D", days)
        .when(interval == "M", F.array(F.date_format(day, "yyyyMM")))
        .when(interval == "S", F.array(F.concat(year, F.lit("_S"), F.quarter(day).cast("string"))))
        .when(interval == "Y", F.array(year))
    )


def next_period(interval: Column, day: Column) -> Column:
    return (
        F.when(interval.isin("D", "M"), F.trunc(F.add_months(day, 1), "MM"))
        .when(interval == "S", F.trunc(F.add_months(day, 3), "QUARTER"))
        .when(interval == "Y", F.trunc(F.add_months(day, 12), "YEAR"))
    )


def calendar_plan(controls: DataFrame, existing: DataFrame, now: Column) -> DataFrame:
    """Statements for period tables that are due and do not exist yet.

    ``existing`` has ``table_name``. Templates are cut at ``;``, blank pieces dropped and
    ``datedemo`` filled with the period label.
    """
    day = F.col("tabdate").cast("date")
    labelled = due_controls(controls, now).select(
        "tabname", "tabddl", F.explode(period_labels(F.col("tabinterval"), day)).alias("label")
    )
    named = labelled.withColumn(
        "table_name", F.concat(F.upper("tabname"), F.lit("_"), F.col("label"))
    )
    missing = named.join(existing.select("table_name"), "table_name", "left_anti")
    parts = F.filter(
        pieces(F.col("tabddl"), ";"), lambda p: F.length(F.replace(p, F.lit(" "), F.lit(""))) != 0
    )
    return missing.select("tabname", "table_name", "label", F.posexplode(parts)).select(
        "tabname", "table_name", (F.col("pos") + 1).alias("piece_no"),
        F.replace("col", F.lit("datedemo"), F.col("label")).alias("statement"),
    )


def advance_controls(controls: DataFrame, now: Column) -> DataFrame:
    """Control rows after a run: due rows move one period on and are ready again."""
    day = F.col("tabdate").cast("date")
    moved = next_period(F.col("tabinterval"), day)
    ran = F.coalesce(is_due(now), F.lit(False))
    return controls.select(
        "tabname",
        F.when(ran, moved).otherwise(day).alias("tabdate"),
        F.when(ran, "0").otherwise(F.col("tabstatus")).alias("tabstatus"),
        "tabinterval", "tabenable",
    )


def control_transition(controls: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Control rows after work: success makes them ready with the next date, an error failed.

    A row already running (``1``) is not picked up; rows without an outcome stay running.
    """
    picked = F.col("tabstatus") != "1"
    ok = F.col("ok")
    return controls.join(outcomes.select(key, "ok"), key, "left").select(
        key,
        F.when(~picked, F.col("tabstatus"))
        .when(ok.isNull(), "1").when(ok, "0").otherwise("2").alias("tabstatus"),
        F.when(picked & F.coalesce(ok, F.lit(False)),
               next_period(F.col("tabinterval"), F.col("tabdate").cast("date")))
        .otherwise(F.col("tabdate").cast("date")).alias("tabdate"),
    )


def sequence_steps(sequences: DataFrame) -> DataFrame:
    """Step per sequence from its maximum. ``_`` in the name patterns is any character."""
    top = F.col("max_value")
    named = F.col("sequence_name").like("SEQ_%") | F.col("sequence_name").like("SQ_%")
    step = (
        F.when(top <= 1_000_000, 100).when(top <= 1_000_000_000, 10_000)
        .when(top <= 10_000_000_000_000, 100_000).otherwise(10_000_000)
    )
    return sequences.filter(named).withColumn("step", step.cast("bigint"))


# What the log table takes, by column; None is a column that may not be NULL.
LOG_LIMITS = {"proc_name": 80, "starttime": None, "endtime": None, "proc_status": 10, "proc_desc": 4000}


def job_log_rows(entries: DataFrame, now: Column) -> DataFrame:
    """Log rows as they are stored: an entry that does not fit the log table is logged as a failed
    ``proc_job_log`` entry at this time instead (status 0), with the first column that failed."""
    failures = []
    for name, longest in LOG_LIMITS.items():
        if name != "proc_desc":
            failures.append(F.when(F.col(name).isNull(), F.lit(f"{name} is null")))
        if longest is not None:
            too_long = F.concat(F.lit(f"{name} too long: "), F.length(name).cast("string"))
            failures.append(F.when(F.length(name) > longest, too_long))
    reason = F.coalesce(*failures)
    bad = reason.isNotNull()
    return entries.select(
        "log_id",
        F.when(bad, "proc_job_log").otherwise(F.col("proc_name")).alias("proc_name"),
        F.when(bad, now).otherwise(F.col("starttime")).alias("starttime"),
        F.when(bad, now).otherwise(F.col("endtime")).alias("endtime"),
        F.when(bad, "0").otherwise(F.col("proc_status")).alias("proc_status"),
        F.when(bad, reason).otherwise(F.col("proc_desc")).alias("proc_desc"),
    )


def split_rows(df: DataFrame, id_cols: list[str], text_col: str, delimiter: str) -> DataFrame:
    """One row per piece of a text; empty pieces are NULL, a NULL text is one NULL row."""
    return df.select(*id_cols, F.posexplode(pieces(F.col(text_col), delimiter))).select(
        *id_cols, (F.col("pos") + 1).alias("piece_no"), F.col("col").alias("piece")
    )
