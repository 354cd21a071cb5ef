"""Counters, gauges, lock waits, thresholds and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.measures import half_even, pages_to_gib, ratio_percent, rounded
from tidewright.functions.ordered import with_previous
from tidewright.functions.text import clock_text, host_part, port_part

# Counters reported in KiB instead of units.
KIB_ITEMS = ["bytes_sent", "bytes_received"]

# Commands and users outside the active-session gauge.
BACKGROUND_COMMANDS = ["Binlog Dump", "Binlog Dump GTID", "Sleep", "Connect", "Daemon"]
BACKGROUND_USERS = ["system user"]


def day_of(ts: str) -> Column:
    """Segment for time series, the day's number: polling bounds the samples of one day."""
    return F.unix_date(F.col(ts).cast("date"))


def counter_rates(samples: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Per-second rate between neighbouring samples of a counter.

    The interval is the uptime difference, 0 counts as 1; halves round to even. A counter
    that went backwards keeps its negative rate and is flagged. First samples give no row.
    """
    rows = with_previous(
        samples, ["instance", "item"], ["ts"],
        {"_value": "value", "_uptime": "uptime"}, day_of("ts"),
    ).filter(F.col("_value").isNotNull())
    gap = F.col("uptime") - F.col("_uptime")
    interval = F.when(gap == 0, 1).otherwise(gap)
    delta = F.col("value") - F.col("_value")
    unit = F.when(F.col("item").isin(KIB_ITEMS), 1024).otherwise(1)
    return rows.select(
        "ts", "instance", "item",
        half_even(delta / interval / unit).alias("rate"),
        (delta < 0).alias("reset"),
        *(extra or []),
    )


def backlog_eta(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Time left until ``pending`` reaches 0 at the pace since the previous sample.

    ``eta`` is held to the range of a TIME value, ``eta_seconds`` is not; both are NULL without
    progress. Rounding is half up on whole seconds.
    """
    rows = with_previous(
        samples, keys, ["ts"], {"_pending": "pending", "_seconds": "seconds"}, day_of("ts")
    ).filter(F.col("_pending").isNotNull())
    interval = F.col("seconds") - F.col("_seconds")
    done = F.col("_pending") - F.col("pending")
    left = F.try_divide(
        (F.col("pending") * interval).cast("decimal(28,0)"), done.cast("decimal(18,0)")
    )
    seconds = F.round(left, 0).cast("bigint")
    return rows.select(
        *keys, "ts", "pending", clock_text(seconds).alias("eta"), seconds.alias("eta_seconds")
    )


def gauge_ratios(gauges: DataFrame) -> DataFrame:
    """Each sample as whole percent of the greatest one of its instance and item."""
    top = gauges.groupBy("instance", "item").agg(F.max("value").alias("value_max"))
    return gauges.join(top, ["instance", "item"]).select(
        "ts", "instance", "item", "value", "value_max",
        ratio_percent(F.col("value"), F.col("value_max")).alias("ratio"),
    )


def max_or_zero(value: Column, condition: Column) -> Column:
    """The greatest value of matching rows, or their number when there is no value."""
    return F.coalesce(F.max(F.when(condition, value)), F.count_if(condition))


def session_gauges(
    processes: DataFrame, transactions: DataFrame, max_connections: int = 2000
) -> DataFrame:
    """Session, transaction and lock-wait gauges per instance, one wide row each.

    Transactions are counted per thread before they meet the process list, so a thread
    with very many of them joins as one row. Running transactions of no listed process belong to no
    instance: they make a row with a NULL instance.
    """
    running = (
        transactions.filter(F.col("trx_state") == "RUNNING")
        .groupBy(F.col("trx_mysql_thread_id").alias("id"))
        .agg(F.count("*").alias("running"))
    )
    listed = processes.withColumn("listed", F.lit(True))
    rows = listed.join(running, "id", "full").withColumn("running", F.coalesce("running", F.lit(0)))
    time = F.col("time").cast("bigint")
    asleep = F.col("command") == "Sleep"
    in_trx = F.col("running") > 0
    active = ~F.col("command").isin(BACKGROUND_COMMANDS) & ~F.col("user").isin(BACKGROUND_USERS)
    limit = F.lit(max_connections).cast("bigint")
    return rows.groupBy("instance").agg(
        F.count("listed").alias("conn_cur"),
        limit.alias("conn_max"),
        ratio_percent(F.count("listed"), limit).alias("conn_ratio"),
        max_or_zero(time, active).alias("conn_active_sec"),
        F.sum("running").alias("trans_active"),
        max_or_zero(time, in_trx & ~asleep).alias("trans_active_sec"),
        F.sum(F.when(asleep, F.col("running")).otherwise(0)).alias("trans_uncommited"),
        max_or_zero(time, in_trx & asleep).alias("trans_uncommited_sec"),
        max_or_zero(time, F.col("state") == "Waiting for table flush").alias("lock_flush_sec"),
        max_or_zero(time, F.col("state") == "Waiting for table metadata lock").alias("lock_metadata_sec"),
    )


def latest_rates(rates: DataFrame) -> DataFrame:
    """The newest rate of every counter as ``instance, item, value``."""
    return rates.groupBy("instance", "item").agg(F.max_by("rate", "ts").alias("value"))


def server_items(status: DataFrame) -> DataFrame:
    """Running threads, memory and buffer pool of each instance from its status rows (``instance, item, value``), one wide row each.

    Memory is given in KiB, the pool in pages; both are whole GiB here, each rounded before the used part is taken. A missing
    item leaves those that need it NULL.
    """

    def value(name: str) -> Column:
        return F.max(F.when(F.col("item") == name, F.col("value")))

    most, free = F.col("buffer_max_size_gb"), F.col("_free")
    return (
        status.groupBy("instance").agg(
            value("Threads_running").cast("bigint").alias("conn_active"),
            half_even(value("MemTotal") / 1024 / 1024).alias("mem_max_size_gb"),
            pages_to_gib(value("Innodb_buffer_pool_pages_total")).alias("buffer_max_size_gb"),
            pages_to_gib(value("Innodb_buffer_pool_pages_free")).alias("_free"),
        )
        .withColumns({"buffer_used_size_gb": most - free, "buffer_used_ratio": ratio_percent(most - free, most)})
        .drop("_free")
    )


def long_form(gauges: DataFrame, ts: Column) -> DataFrame:
    """Wide gauges as ``ts, instance, item, value`` rows."""
    items = [c for c in gauges.columns if c != "instance"]
    wide = gauges.select("instance", *[F.col(c).cast("bigint").alias(c) for c in items])
    return wide.unpivot("instance", items, "item", "value").select(
        ts.alias("ts"), "instance", "item", "value"
    )


def size_rollup(stats: DataFrame, group: list[str]) -> DataFrame:
    """Whole GiB of data plus indexes."""
    return stats.groupBy(*group).agg(
        F.round(F.sum("data_bytes").cast("decimal(38,0)") / F.lit(1024**3), 0)
        .cast("bigint").alias("size_gb")
    )


def replica_items(status: DataFrame, id_col: str) -> DataFrame:
    """Delay and stopped-thread items from ``key: value`` status rows."""
    key, value = F.col("key"), F.col("value")
    return status.groupBy(id_col).agg(
        F.coalesce(
            F.max(F.when(key == "Seconds_Behind_Master", value.try_cast("bigint"))), F.lit(0)
        ).alias("replica_delay_sec"),
        F.count_if((key == "Slave_IO_Running") & (value == "No")).alias("error_io_thread"),
        F.count_if((key == "Slave_SQL_Running") & (value == "No")).alias("error_sql_thread"),
    )


def current_statements(transactions: DataFrame, threads: DataFrame, statements: DataFrame) -> DataFrame:
    """Each transaction with the statement its thread is running, if any."""
    return (
        transactions.join(threads, "processlist_id", "left").join(statements, "thread_id", "left")
    )


def lock_wait_graph(
    waits: DataFrame, transactions: DataFrame, locks: DataFrame, processes: DataFrame, now: Column
) -> DataFrame:
    """Who waits for whom, for how long, and what the blocker is doing.

    Every join's right side is unique on its key, so a blocker that holds up very many
    waiters is a skewed left side only, which adaptive execution splits.
    """

    def trx(prefix: str, *cols: str) -> DataFrame:
        return transactions.select(*[F.col(c).alias(prefix + c) for c in cols])

    blocker = trx("b_", "trx_id", "trx_mysql_thread_id", "trx_query")
    waiter = trx("r_", "trx_id", "trx_mysql_thread_id", "trx_query", "trx_wait_started")
    rows = (
        waits.join(waiter, F.col("requesting_trx_id") == F.col("r_trx_id"))
        .join(locks, F.col("requested_lock_id") == F.col("lock_id"))
        .join(blocker, F.col("blocking_trx_id") == F.col("b_trx_id"))
        .join(processes, F.col("id") == F.col("b_trx_mysql_thread_id"), "left")
    )
    return rows.select(
        F.col("r_trx_id").alias("waiting_trx_id"),
        F.col("r_trx_mysql_thread_id").alias("waiting_thread"),
        F.timestamp_diff("SECOND", F.col("r_trx_wait_started"), now).alias("wait_time"),
        F.col("r_trx_query").alias("waiting_query"),
        F.col("lock_table").alias("waiting_table_lock"),
        F.col("b_trx_id").alias("blocking_trx_id"),
        F.col("b_trx_mysql_thread_id").alias("blocking_thread"),
        host_part(F.col("host")).alias("blocking_host"),
        port_part(F.col("host")).alias("blocking_port"),
        F.when(F.col("command") == "Sleep", F.col("time")).otherwise(0).alias("idle_in_trx"),
        F.col("b_trx_query").alias("blocking_query"),
    ).orderBy(F.col("wait_time").desc(), "waiting_trx_id")


def item_max(samples: DataFrame) -> DataFrame:
    """The greatest value of every item of an instance."""
    return samples.groupBy("instance", "item").agg(F.max("value").alias("value"))


def latest_error(errors: DataFrame, order: list[str]) -> DataFrame:
    """The most recent error row."""
    return errors.agg(F.max_by(F.struct(*errors.columns), F.struct(*order)).alias("e")).select("e.*")


def longest_first(processes: DataFrame, id_col: str) -> DataFrame:
    """Sessions with a statement, longest running first."""
    return processes.filter(F.col("info").isNotNull()).orderBy(F.col("time").desc(), id_col)


def usage_over(usage: DataFrame, threshold: float, skip_containers=(1, 2)) -> DataFrame:
    """Tablespaces above a usage threshold before an action, with the change it made."""
    over = F.col("pre_usage") > F.lit(threshold).cast("decimal(10,2)")
    return usage.filter(over & ~F.col("con_id").isin(*skip_containers)).withColumn(
        "diff", F.col("pre_usage") - F.col("post_usage")
    )


def state_label(percent: Column, threshold: float) -> Column:
    return F.when(percent > threshold, "abnormal").otherwise("normal")


def peak_interval(metrics: DataFrame, metric: str, now: Column, back_days: int = 7) -> DataFrame:
    """The snapshot with the greatest average of a metric in the last days; one row.

    Ties go to the smallest snapshot id. The report span is (peak - 1, peak).
    """
    recent = (F.col("metric_name") == metric) & (
        F.col("end_time") > F.timestamp_add("DAY", F.lit(-back_days), now)
    )
    best = F.max_by(F.struct("snap_id", "average", "end_time"), F.struct("average", -F.col("snap_id")))
    return metrics.filter(recent).agg(best.alias("p")).select(
        (F.col("p.snap_id") - 1).alias("begin_snap"),
        F.col("p.snap_id").alias("end_snap"),
        F.col("p.average").alias("average"),
        F.col("p.end_time").alias("end_time"),
    )


def peak_report_plan(peak: DataFrame, instances: DataFrame, now: Column) -> DataFrame:
    """One report per instance over the peak span. The one-row peak is a scalar subquery."""
    span = peak.select(F.struct("begin_snap", "end_snap")).scalar()
    day = F.upper(F.date_format(now, "yyyy_MMM_dd_HH_mm"))
    return (
        instances.withColumn("_span", span)
        .filter(F.col("_span.end_snap").isNotNull())
        .select(
            "instance", "_span.begin_snap", "_span.end_snap",
            F.concat(F.lit("awr_"), day, F.lit("_"), "instance", F.lit(".html")).alias("file_name"),
        )
    )


def probe_codes(probes: DataFrame) -> DataFrame:
    """Status of a write-then-read probe.

    Fixed values: 1 ok, 2 write timed out, 3 write request failed, 4 load failed or the
    value read back is not the one sent, 5 query timed out, 6 query failed.
    """
    load, query = F.col("load_outcome"), F.col("query_outcome")
    code = (
        F.when(load == "timeout", 2)
        .when(load == "request_error", 3)
        .when(load == "failed", 4)
        .when(query == "timeout", 5)
        .when(query == "error", 6)
        .when(F.col("seen_ts") == F.col("sent_ts"), 1)
        .otherwise(4)
    )
    return probes.withColumn("status_code", code)


def check_lag(samples: DataFrame, now: Column) -> DataFrame:
    """Seconds since the first sample of the latest log, per instance."""
    first = samples.groupBy("instance", F.col("ts").cast("date").alias("day")).agg(
        F.min("ts").alias("first_ts")
    )
    return first.groupBy("instance").agg(
        F.timestamp_diff("SECOND", F.max_by("first_ts", "day"), now).alias("check_interval")
    )


def health_notices(checks: DataFrame) -> DataFrame:
    """One notice per healthy run, one per failed check."""
    rows = with_previous(
        checks.withColumn("healthy", F.col("healthy").cast("boolean")),
        ["instance"], ["ts"], {"_was": "healthy"}, day_of("ts"),
    )
    starts = F.col("healthy") & ~F.coalesce("_was", F.lit(False))
    return rows.filter(starts | ~F.col("healthy")).select(
        "instance", "ts", F.when(F.col("healthy"), "healthy").otherwise("error").alias("notice")
    )


def throughput(lines: DataFrame, line: str) -> DataFrame:
    """Add ``mbps``, the speed named in a log line, and its ``rating``.

    Fixed values: units to MB/s and the limits of the rating. KB/s is cut to two places,
    as ``scale=2`` does. A line without a speed has neither.
    """
    pattern = r"([0-9.]+)\s*(KB/s|MB/s|GB/s)"
    parts = lines.withColumns(
        {
            "_number": F.regexp_extract(line, pattern, 1).try_cast("decimal(20,6)"),
            "_unit": F.regexp_extract(line, pattern, 2),
        }
    )
    number, unit, mbps = F.col("_number"), F.col("_unit"), F.col("mbps")
    speed = (
        F.when(unit == "KB/s", F.floor(number * 100 / 1024).cast("decimal(28,6)") / 100)
        .when(unit == "MB/s", number)
        .when(unit == "GB/s", number * 1024)
    )
    rating = F.when(mbps > 100, "excellent").when(mbps > 50, "good").when(mbps.isNotNull(), "fair")
    return (
        parts.withColumn("mbps", speed.cast("decimal(28,6)"))
        .withColumn("rating", rating)
        .drop("_number", "_unit")
    )


def usage_percent(used: Column, total: Column) -> Column:
    return rounded(F.try_divide(used.cast("double"), total.cast("double")) * 100, 2).cast("decimal(10,2)")
