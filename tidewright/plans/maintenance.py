"""Queries over table statistics, partitions, keys and control rows, with their check SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidewright.functions.sql_functions import register
from tidewright.operators import maintenance as mt
from tidewright.operators.jobs import SPACE_STEPS, calendar_run, executed, space_run
from tidewright.plans import tables as t
from tidewright.plans.tables import Query, stats_sql, table
from tidewright.session import scratch_path
from tidewright.sinks.tables import replace_batch
from tidewright.sources.inventory import partition_listing as list_partitions

BATCH = "20240131"
CALENDAR_NOW = "2024-04-10 00:00:00"


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _partitioned(spark, sf_dir):
    owners = table(spark, sf_dir, "supplier").filter(F.col("s_nationkey") < 12)
    return owners.select(F.concat(F.lit("T_"), F.col("s_suppkey").cast("string")).alias("table_name"))


def _report(spark, sf_dir):
    stats = t.table_stats(table(spark, sf_dir, "lineitem"))
    return mt.wasted_space(stats, _partitioned(spark, sf_dir), BATCH, min_mib=100)


def _plain(report):
    sizes = ("current_size", "real_size", "hwm_size")
    return report.withColumns({c: F.col(c).cast("double") for c in sizes})


def wasted_space_report(spark, sf_dir):
    return _plain(_report(spark, sf_dir))


def batch_replace(spark, sf_dir):
    """The report written twice for one batch: the second run replaces the first."""
    path = scratch_path(spark, "clear-hwm")
    replace_batch(_report(spark, sf_dir), path)
    replace_batch(_report(spark, sf_dir), path)
    return _plain(spark.read.schema(_report(spark, sf_dir).schema).parquet(path))


def fragmented_partitions(spark, sf_dir):
    rows = mt.fragmented_partitions(_partition_stats(spark, sf_dir), min_wasted_mib=5, max_percent=60)
    return _plain(rows).select("table_name", "partition_name", "current_size", "real_size",
                               "hwm_size", "rate")


def _partition_stats(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    return t.table_stats(lines, "year").withColumn(
        "partition_name", F.concat(F.lit("P"), F.col("year").cast("string"))
    )


def space_action_plan(spark, sf_dir):
    """The report's statements; a supplier's partitions are the years from 1994 to 2003."""
    stats, report = _partition_stats(spark, sf_dir), _report(spark, sf_dir)
    names = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("T_"), F.col("s_suppkey").cast("string")).alias("table_name"),
        F.explode(F.sequence(F.lit(1994), F.lit(2003))).alias("year"),
    )
    listed = names.select("table_name", F.concat(F.lit("P"), F.col("year").cast("string")).alias("partition_name"))
    rows = stats.select("table_name", "partition_name")
    empty = mt.empty_partitions(listed, rows, ["table_name", "partition_name"])
    fragmented = mt.fragmented_partitions(stats, min_wasted_mib=5, max_percent=60)
    return mt.action_plan(report, empty, fragmented, _rebuilds(spark, sf_dir, report))


def _crowded():
    """Runs statements; indexes of a supplier whose number is a multiple of seven are refused."""

    def run(statement: str) -> None:
        found = re.search(r"^alter index IX_(\d+)_", statement)
        if found and int(found[1]) % 7 == 0:
            raise ValueError("no space")

    return run


def space_run_log(spark, sf_dir):
    """The report's statements are run, some fail; the job's log as it is stored, and the report's marks."""
    work, now = scratch_path(spark, "space-run"), at(CALENDAR_NOW)
    _report(spark, sf_dir).write.parquet(f"{work}/report")
    executed(space_action_plan(spark, sf_dir), "table_name", ["step", "statement"], _crowded).write.parquet(f"{work}/done")
    log, after = space_run(spark.read.parquet(f"{work}/report"), spark.read.parquet(f"{work}/done"), now, now)
    mt.job_log_rows(log, now).write.parquet(f"{work}/log")
    stored = spark.read.parquet(f"{work}/log").select(F.lit("log").alias("kind"), F.col("proc_desc").alias("text"), F.col("proc_status").alias("status"))
    return stored.unionByName(after.select(F.lit("report").alias("kind"), F.col("tabname").alias("text"), "status"))


def report_after_run(spark, sf_dir):
    """The report once every plain table has been moved."""
    report = _report(spark, sf_dir)
    done = mt.mark_done(report, report.filter(F.col("is_parttab") == 0))
    return done.select("tabname", "is_parttab", "status")


def _month(ts):
    return F.concat(F.lit("P"), F.date_format(ts, "yyyyMM"))


def _month_spine(spark, first: str, last: str):
    months = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 MONTH"))
    return spark.range(1).select(F.explode(months).alias("month"))


def empty_partitions(spark, sf_dir):
    spine = _month_spine(spark, "1994-01-01", "2002-01-01").select(_month("month").alias("partition_name"))
    rows = table(spark, sf_dir, "orders").select(_month("o_orderdate").alias("partition_name"))
    return mt.empty_partitions(spine, rows)


def partition_listing(spark, sf_dir):
    first = F.trunc("o_orderdate", "MM")
    months = table(spark, sf_dir, "orders").groupBy(first.alias("month")).agg(F.count("*").alias("n"))
    high = F.concat(
        F.lit("TO_DATE(' "), F.date_format(F.add_months("month", 1), "yyyy-MM-dd HH:mm:ss"),
        F.lit("', 'SYYYY-MM-DD HH24:MI:SS', 'NLS_CALENDAR=GREGORIAN')"),
    )
    listed = months.select(
        F.lit("ORDERS").alias("table_name"), _month("month").alias("partition_name"),
        high.alias("high_value"),
    )
    return list_partitions(listed, "orders")


def _rebuilds(spark, sf_dir, report):
    """A supplier's indexes are its (return flag, ship year) pairs; R ones hold LOBs."""
    lines = table(spark, sf_dir, "lineitem")
    name = F.concat_ws("_", F.lit("IX"), F.col("l_suppkey").cast("string"), "l_returnflag",
                       F.year("l_shipdate").cast("string"))
    indexes = lines.select(
        F.concat(F.lit("T_"), F.col("l_suppkey").cast("string")).alias("table_name"),
        name.alias("index_name"),
        F.when(F.col("l_returnflag") == "R", "LOB").otherwise("NORMAL").alias("index_type"),
    ).distinct()
    partitioned = indexes.filter(F.col("index_name").like("%_A_%")).select("table_name", "index_name")
    tables = report.select(F.col("tabname").alias("table_name"), "is_parttab")
    return mt.indexes_to_rebuild(tables, indexes, partitioned)


def indexes_to_rebuild(spark, sf_dir):
    return _rebuilds(spark, sf_dir, _report(spark, sf_dir))


def tables_without_key(spark, sf_dir):
    """A (order, line) pair is a table; it has a key when the pair is unique."""
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.count("*").alias("n"), F.min("l_returnflag").alias("flag")
    )
    named = grouped.select(
        F.when(F.col("flag") == "A", "sys").when(F.col("flag") == "N", "sys_app")
        .otherwise("app").alias("table_schema"),
        F.concat_ws("_", F.lit("t"), F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("table_name"),
        "n",
    )
    constraints = named.filter(F.col("n") == 1).select(
        "table_schema", "table_name", F.lit("PRIMARY").alias("constraint_name")
    )
    return mt.tables_without_key(named.drop("n"), constraints)


def property_audit(spark, sf_dir):
    """Events as table settings: ``$.k`` is the audited property."""
    kind = F.col("event_type")
    name = F.concat(F.lit("t_"), F.col("event_id").cast("string"))
    settings = table(spark, sf_dir, "events").select(
        kind.alias("TABLE_SCHEMA"), name.alias("TABLE_NAME"),
        F.when(kind == "signup", "MATERIALIZED_VIEW").when(kind == "error", "VIEW")
        .otherwise("OLAP").alias("TABLE_ENGINE"),
        F.when(kind == "click", "dt").otherwise("").alias("PARTITION_KEY"),
        F.col("props").alias("PROPERTIES"),
        F.concat(F.lit("CREATE MATERIALIZED VIEW `"), name, F.lit('` PROPERTIES ("k" = "'),
                 F.get_json_object("props", "$.k"), F.lit('") AS SELECT 1')).alias("create_statement"),
    )
    return mt.property_changes(settings, "k", "3", "1")


def _controls(spark, sf_dir):
    """Parts as calendar control rows."""
    part = table(spark, sf_dir, "part")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"),
                    F.col("p_partkey").cast("string"))
    kind = F.col("p_type")
    interval = (
        F.when(kind.isin("ECONOMY", "SMALL"), "D").when(kind.isin("MEDIUM", "PROMO"), "M")
        .when(kind == "STANDARD", "S").otherwise("Y")
    )
    return part.select(
        name.alias("tabname"),
        F.add_months(F.lit("2022-01-17").cast("date"), F.col("p_size")).cast("timestamp_ntz").alias("tabdate"),
        F.when(F.col("p_brand") == "Brand#1", "1").when(F.col("p_brand") == "Brand#2", "2")
        .otherwise("0").alias("tabstatus"),
        interval.alias("tabinterval"),
        F.when(F.col("p_brand") == "Brand#3", "0").otherwise("1").alias("tabenable"),
        F.concat(F.lit("create table "), name, F.lit("_datedemo(a int); ;create index ix_datedemo on "),
                 name, F.lit("_datedemo(a);")).alias("tabddl"),
    )


def calendar_table_plan(spark, sf_dir):
    """Tables of 2024-02 and of the year 2024 exist for the dearer parts."""
    dear = table(spark, sf_dir, "part").filter(F.col("p_retailprice") > 950)
    label = F.explode(F.array(F.lit("202402"), F.lit("2024"), F.lit("20240215")))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"),
                    F.col("p_partkey").cast("string"))
    existing = dear.select(F.upper(name).alias("n"), label.alias("l")).select(
        F.concat_ws("_", "n", "l").alias("table_name")
    )
    return mt.calendar_plan(_controls(spark, sf_dir), existing, at(CALENDAR_NOW))


def _refusing():
    """Runs statements; an index on the table of a part whose number is a multiple of seven is refused."""

    def run(statement: str) -> None:
        found = re.search(r"^create index \S+ on \w+?_(\d+)_", statement)
        if found and int(found[1]) % 7 == 0:
            raise ValueError("no space")

    return run


def calendar_run_log(spark, sf_dir):
    """The calendar tables' statements are run, some fail; the job's log as it is stored, and its control rows."""
    controls, now = _controls(spark, sf_dir), at(CALENDAR_NOW)
    work = scratch_path(spark, "calendar-run")
    executed(calendar_table_plan(spark, sf_dir), "table_name", ["piece_no"], _refusing).write.parquet(f"{work}/done")
    log, after = calendar_run(controls, spark.read.parquet(f"{work}/done"), now, now, now)
    mt.job_log_rows(log, now).write.parquet(f"{work}/log")
    stored = spark.read.parquet(f"{work}/log").select(F.lit("log").alias("kind"), F.col("proc_desc").alias("text"), F.col("proc_status").alias("status"))
    rows = after.select(F.lit("control").alias("kind"), F.concat_ws(",", "tabname", F.col("tabdate").cast("string")).alias("text"), F.col("tabstatus").alias("status"))
    return stored.unionByName(rows)


def calendar_control_advance(spark, sf_dir):
    return mt.advance_controls(_controls(spark, sf_dir), at(CALENDAR_NOW))


def sequence_step_plan(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    prefix = (
        F.when(F.col("p_type") == "ECONOMY", "SEQ_").when(F.col("p_type") == "SMALL", "SQ-")
        .when(F.col("p_type") == "PROMO", "SEQ").otherwise("seq_")
    )
    top = F.pow(F.lit(10.0), F.col("p_size") % 16).cast("bigint") + F.col("p_partkey") % 2
    return mt.sequence_steps(
        part.select(F.concat(prefix, F.col("p_partkey").cast("string")).alias("sequence_name"),
                    top.alias("max_value"))
    )


def job_log_append(spark, sf_dir):
    """A log entry per error event, appended and read back."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    k = F.get_json_object("props", "$.k").cast("int")
    entries = events.select(
        F.col("event_id").alias("log_id"),
        F.when(k > 5, F.concat(F.lit("proc_"), F.col("user_id").cast("string"))).alias("proc_name"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("starttime"),
        F.col("ts").alias("endtime"),
        F.when(k % 2 == 0, "1").otherwise("2").alias("proc_status"),
        F.repeat(F.col("props"), k * 60).alias("proc_desc"),
    )
    path = scratch_path(spark, "job-log")
    mt.job_log_rows(entries, F.lit("2024-02-01").cast("timestamp_ntz")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def control_state_transition(spark, sf_dir):
    """Customers as control rows; the newest order's status is the outcome."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    controls = customer.select(
        F.col("c_custkey").alias("job"),
        (F.col("c_nationkey") % 3).cast("string").alias("tabstatus"),
        F.when(F.col("c_mktsegment") == "BUILDING", "S").when(F.col("c_mktsegment") == "MACHINERY", "Y")
        .otherwise("M").alias("tabinterval"),
        F.add_months(F.lit("2024-01-31").cast("date"), F.col("c_nationkey")).alias("tabdate"),
    )
    last = orders.groupBy(F.col("o_custkey").alias("job")).agg(
        F.max_by("o_orderstatus", "o_orderkey").alias("s")
    )
    outcomes = last.filter(F.col("s") != "P").select("job", (F.col("s") == "F").alias("ok"))
    return mt.control_transition(controls, outcomes, "job")


def split_to_rows(spark, sf_dir):
    return mt.split_rows(table(spark, sf_dir, "documents"), ["doc_id"], "text", "\n")


def split_sql_rows(spark, sf_dir):
    """The lines of every document by the SQL form of the split."""
    register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("split_documents")
    return spark.sql("SELECT d.doc_id, s.piece_no, s.piece FROM split_documents d, LATERAL f_str_split(d.text, '\n') s")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        wasted_space_report, batch_replace, fragmented_partitions, empty_partitions,
        space_action_plan, space_run_log, report_after_run,
        partition_listing, indexes_to_rebuild, tables_without_key, property_audit,
        calendar_table_plan, calendar_run_log, calendar_control_advance, sequence_step_plan, job_log_append,
        control_state_transition, split_to_rows, split_sql_rows,
    )
}

_SPACE = """
sp AS (SELECT *, blocks * 8192 / 1048576.0::DOUBLE AS a, num_rows * avg_row_len / 1048576.0::DOUBLE AS r
  FROM stats WHERE blocks <> 0),
sized AS (SELECT *, r / a AS ratio,
    CAST(round(CAST(a AS DECIMAL(28,9)), 2) AS DOUBLE) AS current_size,
    CAST(round(CAST(r AS DECIMAL(28,9)), 2) AS DOUBLE) AS real_size,
    CAST(round(CAST(a - r AS DECIMAL(28,9)), 2) AS DOUBLE) AS hwm_size,
    CAST(round(CAST(r / a AS DECIMAL(28,9)), 3) * 1000 AS BIGINT) AS tenths FROM sp),
space AS (SELECT *, CAST(tenths // 10 AS VARCHAR) || CASE WHEN tenths % 10 = 0 THEN '' ELSE '.' ||
    CAST(tenths % 10 AS VARCHAR) END || '%' AS rate FROM sized)"""

_REPORT = f"""WITH line AS (SELECT * FROM lineitem), {stats_sql()}, {_SPACE},
  report AS (SELECT '{BATCH}' AS batchno, table_name AS tabname, '0' AS status,
      CASE WHEN s_suppkey IS NULL THEN 0 ELSE 1 END AS is_parttab, current_size, real_size, hwm_size, rate
    FROM space LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey < 12
    WHERE ratio < 0.6 AND current_size > 100)"""

_CONTROLS = """
c AS (SELECT replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) AS tabname, p_retailprice,
    CAST(DATE '2022-01-17' + to_months(p_size) AS DATE) AS tabdate,
    CASE p_brand WHEN 'Brand#1' THEN '1' WHEN 'Brand#2' THEN '2' ELSE '0' END AS tabstatus,
    CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'D' WHEN p_type IN ('MEDIUM', 'PROMO') THEN 'M'
      WHEN p_type = 'STANDARD' THEN 'S' ELSE 'Y' END AS tabinterval,
    CASE WHEN p_brand = 'Brand#3' THEN '0' ELSE '1' END AS tabenable FROM part),
d AS (SELECT *, tabstatus <> '1' AND tabenable = '1'
    AND date_trunc('month', tabdate - INTERVAL 1 MONTH) <= DATE '2024-04-01' AS due FROM c)"""

_NEXT = """CASE WHEN tabinterval IN ('D', 'M') THEN CAST(date_trunc('month', tabdate + INTERVAL 1 MONTH) AS DATE)
  WHEN tabinterval = 'S' THEN CAST(date_trunc('quarter', tabdate + INTERVAL 3 MONTH) AS DATE)
  ELSE CAST(date_trunc('year', tabdate + INTERVAL 12 MONTH) AS DATE) END"""

ORACLES: dict[str, str] = {
    "wasted_space_report": f"{_REPORT} SELECT * FROM report",
    "batch_replace": f"{_REPORT} SELECT * FROM report",
    "fragmented_partitions": f"""WITH line AS (SELECT *, year(l_shipdate) AS y FROM lineitem),
      {stats_sql('y')}, {_SPACE}
      SELECT table_name, 'P' || CAST(y AS VARCHAR) AS partition_name, current_size, real_size, hwm_size, rate
      FROM space WHERE hwm_size >= 5 AND tenths < 600""",
    "empty_partitions": """SELECT strftime(m, 'P%Y%m') AS partition_name
      FROM (SELECT unnest(generate_series(DATE '1994-01-01', DATE '2002-01-01', INTERVAL 1 MONTH)) AS m)
      WHERE NOT EXISTS (SELECT 1 FROM orders WHERE date_trunc('month', o_orderdate) = m)""",
    "partition_listing": """SELECT DISTINCT 'ORDERS' AS table_name, strftime(o_orderdate, 'P%Y%m') AS partition_name,
        substr('TO_DATE('' ' || strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S')
          || ''', ''SYYYY-MM-DD HH24:MI:SS'', ''NLS_CALENDAR=GREGORIAN'')', 1, 50) AS partition_value
      FROM orders""",
    "indexes_to_rebuild": f"""{_REPORT},
      ix AS (SELECT DISTINCT 'T_' || CAST(l_suppkey AS VARCHAR) AS table_name, l_returnflag AS f,
          'IX_' || CAST(l_suppkey AS VARCHAR) || '_' || l_returnflag || '_' || CAST(year(l_shipdate) AS VARCHAR) AS index_name
        FROM lineitem)
      SELECT table_name, index_name, 'alter index ' || index_name || ' rebuild online' AS statement
      FROM ix JOIN report ON tabname = table_name
      WHERE f <> 'R' AND (is_parttab = 0 OR f <> 'A')""",
    "space_action_plan": f"""{_REPORT},
      years AS (SELECT 'T_' || CAST(l_suppkey AS VARCHAR) AS table_name, year(l_shipdate) AS y,
          CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS blocks, count(*) AS num_rows,
          l_suppkey % 100 * 2000 AS avg_row_len FROM lineitem GROUP BY l_suppkey, year(l_shipdate)),
      parted AS (SELECT tabname FROM report WHERE is_parttab = 1),
      frag AS (SELECT table_name, y FROM years WHERE blocks <> 0
        AND round(CAST(blocks * 8192 / 1048576.0::DOUBLE - num_rows * avg_row_len / 1048576.0::DOUBLE AS DECIMAL(28,9)), 2) >= 5
        AND round(CAST((num_rows * avg_row_len / 1048576.0::DOUBLE) / (blocks * 8192 / 1048576.0::DOUBLE) AS DECIMAL(28,9)), 3) * 100 < 60),
      spine AS (SELECT 'T_' || CAST(s_suppkey AS VARCHAR) AS table_name, unnest(range(1994, 2004)) AS y FROM supplier),
      ix AS (SELECT DISTINCT 'T_' || CAST(l_suppkey AS VARCHAR) AS table_name, l_returnflag AS f,
          'IX_' || CAST(l_suppkey AS VARCHAR) || '_' || l_returnflag || '_' || CAST(year(l_shipdate) AS VARCHAR) AS index_name
        FROM lineitem)
      SELECT tabname AS table_name, 1 AS step, 'alter table ' || tabname || ' move online' AS statement
        FROM report WHERE is_parttab = 0
      UNION ALL SELECT table_name, 2, 'alter table ' || table_name || ' drop partition P' || CAST(y AS VARCHAR)
          || ' update global indexes' FROM spine JOIN parted ON tabname = table_name
        WHERE (table_name, y) NOT IN (SELECT table_name, y FROM years)
      UNION ALL SELECT table_name, 3, 'alter table ' || table_name || ' move partition P' || CAST(y AS VARCHAR) || ' online'
        FROM frag JOIN parted ON tabname = table_name
      UNION ALL SELECT table_name, 4, 'alter index ' || index_name || ' rebuild online'
        FROM ix JOIN report ON tabname = table_name WHERE f <> 'R' AND (is_parttab = 0 OR f <> 'A')""",
    "report_after_run": f"""{_REPORT} SELECT tabname, is_parttab,
        CASE is_parttab WHEN 0 THEN '1' ELSE '0' END AS status FROM report""",
    "tables_without_key": """SELECT CASE min(l_returnflag) WHEN 'N' THEN 'sys_app' ELSE 'app' END AS table_schema,
        't_' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS table_name
      FROM lineitem GROUP BY l_orderkey, l_linenumber
      HAVING count(*) > 1 AND min(l_returnflag) <> 'A'""",
    "property_audit": """WITH e AS (SELECT event_type AS s, 't_' || CAST(event_id AS VARCHAR) AS n FROM events
        WHERE json_extract_string(props, '$.k') = '3')
      SELECT s AS TABLE_SCHEMA, n AS TABLE_NAME, 'table' AS kind,
        'ALTER TABLE `' || s || '`.`' || n || '` SET ("default.k" = "1")' AS statement
      FROM e WHERE s NOT IN ('signup', 'error')
      UNION ALL SELECT s, n, 'partition', 'ALTER TABLE `' || s || '`.`' || n || '` MODIFY PARTITION (*) SET("k"="1")'
      FROM e WHERE s = 'click'
      UNION ALL SELECT s, n, 'view', 'CREATE MATERIALIZED VIEW `' || s || '`.`' || n
        || '` PROPERTIES ("k" = "1") AS SELECT 1' FROM e WHERE s = 'signup'""",
    "calendar_run_log": f"""WITH {_CONTROLS},
      l AS (
        SELECT *, strftime(x, '%Y%m%d') AS label FROM (
          SELECT *, unnest(generate_series(CAST(date_trunc('month', tabdate) AS DATE), last_day(tabdate), INTERVAL 1 DAY)) AS x
          FROM d WHERE due AND tabinterval = 'D')
        UNION ALL SELECT *, NULL, CASE tabinterval WHEN 'M' THEN strftime(tabdate, '%Y%m')
            WHEN 'S' THEN strftime(tabdate, '%Y') || '_S' || CAST(quarter(tabdate) AS VARCHAR)
            ELSE strftime(tabdate, '%Y') END
          FROM d WHERE due AND tabinterval <> 'D'),
      m AS (SELECT * FROM l WHERE NOT (p_retailprice > 950 AND label IN ('202402', '2024', '20240215'))),
      g AS (SELECT *, upper(tabname) || '_' || label AS table_name, CAST(regexp_extract(tabname, '_([0-9]+)$', 1) AS BIGINT) % 7 = 0 AS bad FROM m),
      f AS (SELECT tabname, min(table_name) AS table_name, arg_min(label, table_name) AS label FROM g WHERE bad GROUP BY tabname),
      w AS (SELECT d.*, f.table_name, f.label FROM d LEFT JOIN f USING (tabname))
      SELECT 'log' AS kind, '20240410 00:00:00,' || table_name || ',created successful' AS text, '1' AS status FROM g WHERE NOT bad
      UNION ALL SELECT 'log', CASE WHEN table_name IS NULL THEN '20240410 00:00:00,' || tabname || ',run successful'
          ELSE 'Exception:20240410 00:00:00,' || table_name || ',no space->create index ix_' || label || ' on ' || tabname || '_' || label || '(a)' END, '1'
        FROM w WHERE due
      UNION ALL SELECT 'control', tabname || ',' || CAST(CAST(CASE WHEN due AND table_name IS NULL THEN {_NEXT} ELSE tabdate END AS DATE) AS VARCHAR),
        CASE WHEN NOT due THEN tabstatus WHEN table_name IS NULL THEN '0' ELSE '2' END FROM w""",
    "calendar_table_plan": f"""WITH {_CONTROLS},
      l AS (
        SELECT *, strftime(x, '%Y%m%d') AS label FROM (
          SELECT *, unnest(generate_series(CAST(date_trunc('month', tabdate) AS DATE), last_day(tabdate), INTERVAL 1 DAY)) AS x
          FROM d WHERE due AND tabinterval = 'D')
        UNION ALL SELECT *, NULL, CASE tabinterval WHEN 'M' THEN strftime(tabdate, '%Y%m')
            WHEN 'S' THEN strftime(tabdate, '%Y') || '_S' || CAST(quarter(tabdate) AS VARCHAR)
            ELSE strftime(tabdate, '%Y') END
          FROM d WHERE due AND tabinterval <> 'D'),
      m AS (SELECT * FROM l WHERE NOT (p_retailprice > 950 AND label IN ('202402', '2024', '20240215')))
      SELECT tabname, upper(tabname) || '_' || label AS table_name, 1 AS piece_no,
        'create table ' || tabname || '_' || label || '(a int)' AS statement FROM m
      UNION ALL
      SELECT tabname, upper(tabname) || '_' || label, 2,
        'create index ix_' || label || ' on ' || tabname || '_' || label || '(a)' FROM m""",
    "calendar_control_advance": f"""WITH {_CONTROLS}
      SELECT tabname, CASE WHEN due THEN {_NEXT} ELSE tabdate END AS tabdate,
        CASE WHEN due THEN '0' ELSE tabstatus END AS tabstatus, tabinterval, tabenable FROM d""",
    "sequence_step_plan": """WITH s AS (SELECT CASE p_type WHEN 'ECONOMY' THEN 'SEQ_' WHEN 'SMALL' THEN 'SQ-'
          WHEN 'PROMO' THEN 'SEQ' ELSE 'seq_' END || CAST(p_partkey AS VARCHAR) AS sequence_name,
        CAST(pow(10, p_size % 16) AS BIGINT) + p_partkey % 2 AS max_value FROM part)
      SELECT *, CAST(CASE WHEN max_value <= 1000000 THEN 100 WHEN max_value <= 1000000000 THEN 10000
        WHEN max_value <= 10000000000000 THEN 100000 ELSE 10000000 END AS BIGINT) AS step
      FROM s WHERE sequence_name LIKE 'SEQ_%' OR sequence_name LIKE 'SQ_%'""",
    "job_log_append": """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k,
          CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) > 5 THEN 'proc_' || CAST(user_id AS VARCHAR) END AS p
        FROM events WHERE event_type = 'error'),
      x AS (SELECT *, repeat(props, k * 60) AS t, p IS NULL OR length(repeat(props, k * 60)) > 4000 AS bad FROM e)
      SELECT event_id AS log_id, CASE WHEN bad THEN 'proc_job_log' ELSE p END AS proc_name,
        CASE WHEN bad THEN TIMESTAMP '2024-02-01' ELSE date_trunc('day', ts) END AS starttime,
        CASE WHEN bad THEN TIMESTAMP '2024-02-01' ELSE ts END AS endtime,
        CASE WHEN bad THEN '0' WHEN k % 2 = 0 THEN '1' ELSE '2' END AS proc_status,
        CASE WHEN NOT bad THEN t WHEN p IS NULL THEN 'proc_name is null'
          ELSE 'proc_desc too long: ' || CAST(length(t) AS VARCHAR) END AS proc_desc
      FROM x""",
    "control_state_transition": f"""WITH c AS (SELECT c_custkey AS job, CAST(c_nationkey % 3 AS VARCHAR) AS old,
          CASE c_mktsegment WHEN 'BUILDING' THEN 'S' WHEN 'MACHINERY' THEN 'Y' ELSE 'M' END AS tabinterval,
          CAST(DATE '2024-01-31' + to_months(c_nationkey) AS DATE) AS tabdate FROM customer),
      o AS (SELECT o_custkey, o_orderstatus AS s FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
          ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)
      SELECT job, CASE WHEN old = '1' THEN old WHEN s IS NULL OR s = 'P' THEN '1' WHEN s = 'F' THEN '0'
          ELSE '2' END AS tabstatus,
        CASE WHEN old <> '1' AND s = 'F' THEN {_NEXT} ELSE tabdate END AS tabdate
      FROM c LEFT JOIN o ON o_custkey = job""",
    "split_to_rows": """SELECT doc_id, CAST(unnest(range(1, len(p) + 1)) AS INT) AS piece_no,
        nullif(unnest(p), '') AS piece
      FROM (SELECT doc_id, CASE WHEN text IS NULL THEN [NULL] ELSE string_split(text, chr(10)) END AS p
        FROM documents)""",
}
ORACLES["split_sql_rows"] = ORACLES["split_to_rows"]

ORACLES["space_run_log"] = f"""WITH p AS ({ORACLES['space_action_plan']}), r AS ({_REPORT} SELECT tabname, is_parttab FROM report),
  bad AS (SELECT table_name AS tabname, min(statement) || '->no space' AS failure FROM p
    WHERE step = 4 AND CAST(regexp_extract(table_name, '([0-9]+)$', 1) AS BIGINT) % 7 = 0 GROUP BY table_name),
  w AS (SELECT r.*, failure FROM r LEFT JOIN bad USING (tabname)),
  f AS (SELECT is_parttab, arg_min(failure, tabname) AS failure FROM w WHERE failure IS NOT NULL GROUP BY is_parttab),
  steps(label, part) AS (VALUES ('{SPACE_STEPS[0]}', -1), ('{SPACE_STEPS[1]}', -1), ('{SPACE_STEPS[2]}', 0), ('{SPACE_STEPS[3]}', 1))
  SELECT 'log' AS kind, coalesce(failure, label) AS text, CASE WHEN failure IS NULL THEN '1' ELSE '2' END AS status
    FROM steps LEFT JOIN f ON part = is_parttab
  UNION ALL SELECT 'report', tabname, CASE WHEN failure IS NULL THEN '1' ELSE '0' END FROM w"""
