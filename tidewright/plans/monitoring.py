"""Queries over counters, sessions, probes and usage, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions.measures import pages_to_gib
from tidewright.functions.ordered import SEGMENT_ROWS, latest_per_key, with_previous
from tidewright.functions.text import epoch_seconds, version_prefix
from tidewright.operators import monitoring as mon
from tidewright.plans import tables as t
from tidewright.plans.tables import Query, SAMPLES_SQL, SESSIONS_SQL, cents, stats_sql, table
from tidewright.session import scratch_path
from tidewright.sinks.tables import append_dated
from tidewright.sources.status import key_value_rows, read_dated_log, read_vertical
from tidewright.streaming.freshness import follow, probe_status
from tidewright.streaming.rates import rates_available

ORDERS_NOW = "2001-08-02 00:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _samples(spark, sf_dir):
    return t.samples(table(spark, sf_dir, "events"))


def _sessions(spark, sf_dir):
    return t.processes(table(spark, sf_dir, "customer")), t.transactions(table(spark, sf_dir, "orders"))


def counter_rates(spark, sf_dir):
    return mon.counter_rates(_samples(spark, sf_dir))


def counter_rates_stream(spark, sf_dir):
    """The samples arrive as files in two instalments; the second run resumes the first."""
    work = scratch_path(spark, "rates")
    source = f"{work}/samples"
    polled = _samples(spark, sf_dir)
    early = F.col("ts") < at("2024-01-16 00:00:00")
    for part in (early, ~early):
        polled.filter(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(polled.schema).parquet(source)
        rates_available(stream, f"{work}/rates", f"{work}/state", f"{work}/checkpoint", buckets=8)
    return spark.read.parquet(f"{work}/rates").drop("batch_id")


def gauge_ratios(spark, sf_dir):
    hourly = t.hourly_counts(table(spark, sf_dir, "events")).withColumnRenamed("n", "value")
    pages = F.col("value") * 1024
    return mon.gauge_ratios(hourly).withColumn("buffer_gb", pages_to_gib(pages))


def session_gauges(spark, sf_dir):
    return mon.session_gauges(*_sessions(spark, sf_dir))


def size_rollup(spark, sf_dir):
    stats = t.table_stats(table(spark, sf_dir, "lineitem"), "l_returnflag")
    sized = stats.select(F.col("l_returnflag").alias("schema_name"),
                         (F.col("blocks") * 8192 + F.col("num_rows") * 64).alias("data_bytes"))
    return mon.size_rollup(sized, ["schema_name"])


def trx_current_statement(spark, sf_dir):
    """Orders as transactions, customers as threads, a user's last event as its statement."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "props")
    threads = customer.select(
        F.col("c_custkey").alias("processlist_id"), (F.col("c_custkey") + 1).alias("thread_id"),
        version_prefix(F.concat_ws(".", F.lit("8"), F.col("c_nationkey").cast("string"), F.lit("36")))
        .alias("server_version"),
    )
    statements = latest_per_key(events, ["user_id"], ["event_id"]).select(
        F.col("user_id").alias("thread_id"), F.concat_ws(" ", "event_type", "props").alias("sql_text")
    )
    trx = t.transactions(orders).select(
        "trx_id", "trx_state", F.col("trx_mysql_thread_id").alias("processlist_id")
    )
    return mon.current_statements(trx, threads, statements)


def lock_wait_graph(spark, sf_dir):
    """An open order waits for the order its customer placed just before it."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    chained = with_previous(
        orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"),
        ["o_custkey"], ["o_orderkey"], {"blocker": "o_orderkey"},
        F.floor(F.col("o_orderkey") / SEGMENT_ROWS),
    ).filter((F.col("o_orderstatus") == "O") & F.col("blocker").isNotNull())
    lock = F.concat(F.lit("L"), F.col("o_orderkey").cast("string"))
    waits = chained.select(
        F.col("o_orderkey").alias("requesting_trx_id"), F.col("blocker").alias("blocking_trx_id"),
        lock.alias("requested_lock_id"),
    )
    locks = orders.select(lock.alias("lock_id"),
                          F.concat(F.lit("db."), "o_orderpriority").alias("lock_table"))
    return mon.lock_wait_graph(
        waits, t.transactions(orders), locks, t.processes(customer), at(ORDERS_NOW)
    )


def monitor_long_form(spark, sf_dir):
    """All gauges of a poll: sessions, sizes, tables without key and the newest rates."""
    now = at(ORDERS_NOW)
    gauges = mon.session_gauges(*_sessions(spark, sf_dir)).withColumn("mysql_alive", F.lit(1))
    lines = table(spark, sf_dir, "lineitem")

    def instance(key: str):
        return F.concat(F.lit("330"), (F.col(key) % 4).cast("string"))

    sizes = t.table_stats(lines).select(
        instance("l_suppkey").alias("instance"), (F.col("blocks") * 8192).alias("data_bytes")
    )
    keyed = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    no_key = keyed.groupBy(instance("l_orderkey").alias("instance")).agg(
        F.count_if(F.col("n") > 1).alias("tab_no_primary_key")
    )
    size = mon.size_rollup(sizes, ["instance"]).withColumnRenamed("size_gb", "db_size_gb")
    rates = mon.latest_rates(counter_rates(spark, sf_dir))
    return (
        mon.long_form(gauges, now)
        .unionByName(mon.long_form(size, now))
        .unionByName(mon.long_form(no_key, now))
        .unionByName(rates.select(now.alias("ts"), "instance", "item", "value"))
    )


def item_max(spark, sf_dir):
    return mon.item_max(_samples(spark, sf_dir))


def latest_error(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    errors = events.select(
        "event_id", "ts", F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("error_number"),
        F.col("props").alias("error_message"),
    )
    return mon.latest_error(errors, ["ts", "event_id"])


def longest_first(spark, sf_dir):
    rows = mon.longest_first(t.processes(table(spark, sf_dir, "customer")), "id")
    return rows.select("id", "user", "command", "time", "info")


def usage_threshold(spark, sf_dir):
    """A supplier's share of late lines is its tablespace usage; F lines are before, O after."""
    lines, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    full, before = F.col("l_returnflag") == "N", F.col("l_linestatus") == "F"
    usage = lines.groupBy("l_suppkey").agg(
        mon.usage_percent(F.count_if(full & before), F.count_if(before)).alias("pre_usage"),
        mon.usage_percent(F.count_if(full & ~before), F.count_if(~before)).alias("post_usage"),
    )
    owned = usage.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_name").alias("tablespace_name"), F.col("s_nationkey").alias("con_id"),
        "pre_usage", "post_usage",
    )
    over = mon.usage_over(owned, 33.0)
    return over.select(
        "tablespace_name", "con_id", *[F.col(c).cast("double").alias(c)
                                       for c in ("pre_usage", "post_usage", "diff")],
        mon.state_label(F.col("post_usage"), 33).alias("state"),
    )


def backlog_eta(spark, sf_dir):
    counted = _samples(spark, sf_dir).filter(F.col("item") != "bytes_sent")
    top = counted.groupBy("instance", "item").agg(F.max("value").alias("total"))
    pending = counted.join(top, ["instance", "item"]).select(
        "instance", "item", "ts", (F.col("total") - F.col("value")).alias("pending"),
        epoch_seconds(F.col("ts")).alias("seconds"),
    )
    return mon.backlog_eta(pending, ["instance", "item"])


def _metrics(spark, sf_dir):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    hourly = table(spark, sf_dir, "events").groupBy(
        hour.alias("end_time"), F.col("event_type").alias("metric_name")
    ).agg((F.sum(cents("value")).cast("double") / F.count("*")).alias("average"))
    return hourly.withColumn("snap_id", F.floor(epoch_seconds(F.col("end_time")) / 3600))


def peak_interval(spark, sf_dir):
    return mon.peak_interval(_metrics(spark, sf_dir), "view", at(EVENTS_NOW))


def peak_report_plan(spark, sf_dir):
    instances = distinct_instances(spark, sf_dir)
    return mon.peak_report_plan(peak_interval(spark, sf_dir), instances, at(EVENTS_NOW))


def heartbeat_status(spark, sf_dir):
    """One probe per user and hour: the last event is what was sent, the last view or click
    what was read back; the kind of the last event is how the write and the query went."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    seen = F.when(F.col("event_type").isin("view", "click"), F.col("ts"))
    last = F.max_by(F.struct("event_type", "props"), F.struct("ts", "event_id"))
    probes = table(spark, sf_dir, "events").groupBy("user_id", hour.alias("hour")).agg(
        F.max("ts").alias("sent_ts"), F.max(seen).alias("seen_ts"), last.alias("l")
    )
    k = F.get_json_object("l.props", "$.k").cast("int")
    kind = F.col("l.event_type")
    outcomes = probes.select(
        "user_id", "hour", "sent_ts", "seen_ts",
        F.when(kind == "signup", "timeout").when(kind == "error", "request_error")
        .when((kind == "click") & (k < 10), "failed").otherwise("ok").alias("load_outcome"),
        F.when((kind == "view") & (k < 10), "timeout").when((kind == "view") & (k > 90), "error")
        .otherwise("ok").alias("query_outcome"),
    )
    return mon.probe_codes(outcomes).select("user_id", "hour", "status_code")


def heartbeat_deadlines(spark, sf_dir):
    """Every event is a heartbeat; some answers and readings come late or never. Three file streams in two instalments, the
    second run resumes the first; a last tick on each stream moves the watermark past all deadlines."""
    events = table(spark, sf_dir, "events")
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")

    def later(seconds):
        return F.timestamp_micros(F.unix_micros(ts) + seconds * 1_000_000)

    sent = events.select(k.alias("probe"), ts.alias("sent_ts"))
    answers = events.filter(k % 11 != 0).select(
        k.alias("probe"), later(k % 7).alias("answer_ts"), F.when(k % 13 == 0, 500).otherwise(200).alias("http"),
        F.when(k % 17 == 0, "Fail").otherwise("Success").alias("load_status"),
    )
    readings = events.filter(k % 19 != 0).select(
        k.alias("probe"), later(5 + k % 13).alias("read_ts"), later(F.when(k % 29 == 0, -1).otherwise(0)).alias("value"),
        F.when(k % 23 == 0, "refused").alias("read_error"),
    )
    work, streams = scratch_path(spark, "freshness"), {}
    middle, end = F.lit("2024-01-16 00:00:00").cast("timestamp"), F.lit("2100-01-01 00:00:00").cast("timestamp")
    tick = events.agg(F.max("event_id")).select(F.lit(-1).cast("long").alias("probe"))
    parts = {"sent": (sent, "sent_ts"), "answers": (answers, "answer_ts"), "readings": (readings, "read_ts")}
    for number in (0, 1):
        for name, (rows, at_col) in parts.items():
            some = rows.filter((F.col(at_col) >= middle) == F.lit(bool(number)))
            if number:
                some = some.unionByName(tick.withColumn(at_col, end), allowMissingColumns=True)
            some.write.mode("append").parquet(f"{work}/{name}")
            streams[name] = spark.readStream.schema(rows.schema).parquet(f"{work}/{name}")
        follow(streams["sent"], streams["answers"], streams["readings"], f"{work}/out", f"{work}/checkpoint")
    return probe_status(spark, f"{work}/out").filter("probe >= 0").select("probe", "status_code")


def check_interval(spark, sf_dir):
    return mon.check_lag(_samples(spark, sf_dir), at(EVENTS_NOW))


def health_changes(spark, sf_dir):
    """An hour is healthy on an instance when at most a quarter of its events are errors."""
    errors = F.sum(F.when(F.col("item") == "error", F.col("n")).otherwise(0))
    total = F.sum(F.when(F.col("item") != "bytes_sent", F.col("n")).otherwise(0))
    hourly = t.hourly_counts(table(spark, sf_dir, "events")).groupBy("instance", "ts").agg(
        (errors * 4 <= total).alias("healthy")
    )
    return mon.health_notices(hourly)


def throughput_rating(spark, sf_dir):
    """A line of a disk test log per event."""
    unit = (
        F.when(F.col("event_type") == "view", " KB/s").when(F.col("event_type") == "click", " GB/s")
        .when(F.col("event_type") == "error", " IOPS").otherwise(" MB/s")
    )
    line = F.concat(
        F.lit("seq read: "), F.col("value").cast("decimal(18,2)").cast("string"), unit, F.lit(" avg")
    )
    lines = table(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return mon.throughput(lines, "line").select("event_id", F.col("mbps").cast("double").alias("mbps"), "rating")


def replica_status(spark, sf_dir):
    """The replica status text of every customer's replica."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")

    def running(stopped):
        return F.when(stopped, "No").otherwise("Yes")

    text = F.concat(
        F.lit("*** 1. row ***\n   Slave_IO_Running: "), running(nation % 6 == 0),
        F.lit("\n  Slave_SQL_Running: "), running(nation % 4 == 0),
        F.lit("\n  Seconds_Behind_Master: "),
        F.when(nation % 4 == 0, "NULL").otherwise((key * 7).cast("string")),
    )
    replicas = table(spark, sf_dir, "customer").select(key.alias("replica_id"), text.alias("status"))
    return mon.replica_items(key_value_rows(replicas, "replica_id", "status"), "replica_id")


def metric_log_changes(spark, sf_dir):
    """The samples as lines of a log in dated folders; of some days the lines are read back, each with its growth."""
    path = scratch_path(spark, "metric-log")
    line = F.concat_ws(" | ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "instance", F.concat_ws("   ", "item", F.col("value").cast("string")))
    dated = _samples(spark, sf_dir).select(line.alias("value"), F.col("ts").cast("date").alias("dump_date"))
    dated.write.partitionBy("dump_date").text(path)
    rows = read_dated_log(spark, path, "2024-01-08", "2024-01-12")
    grown = with_previous(rows, ["instance", "item"], ["ts"], {"before": "value"}, mon.day_of("ts"))
    return grown.select("ts", "instance", "item", F.col("value").cast("bigint").alias("value"), (F.col("value") - F.col("before")).cast("bigint").alias("grown"))


def replica_status_log(spark, sf_dir):
    """Vertical output of every customer's replica in text files, read back record by record."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    text = F.concat(
        F.lit("*************************** "), key.cast("string"), F.lit(". row ***************************\n  Master_Host: h:"),
        nation.cast("string"), F.lit("\n  Slave_IO_Running: "), F.when(nation % 6 == 0, "No").otherwise("Yes"),
        F.lit("\n  Slave_SQL_Running: Yes\n  Last_Error: a: b\n\n  Seconds_Behind_Master: "), (key * 3).cast("string"),
    )
    path = scratch_path(spark, "replica-log")
    table(spark, sf_dir, "customer").select(text.alias("value")).write.text(path)
    records = read_vertical(spark, path)
    return mon.replica_items(key_value_rows(records, "row_no", "record"), "row_no")


def server_items_long(spark, sf_dir):
    """Threads, memory, buffer pool and replica items of a poll as long rows; status rows come from the customers' numbers."""
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("330"), (F.col("c_custkey") % 4).cast("string")).alias("instance"), "c_custkey")
    n, keys = F.count("*"), F.sum("c_custkey")
    items = {"Threads_running": n, "MemTotal": keys * 100, "Innodb_buffer_pool_pages_total": keys * 5, "Innodb_buffer_pool_pages_free": n * 1000}
    wide = customer.groupBy("instance").agg(*[v.cast("double").alias(k) for k, v in items.items()])
    server = mon.server_items(wide.unpivot("instance", list(items), "item", "value"))
    text = F.concat(F.lit("Slave_IO_Running: "), F.when(F.col("instance") == "3301", "No").otherwise("Yes"), F.lit("\nSeconds_Behind_Master: 7"))
    replica = mon.replica_items(key_value_rows(customer.select("instance").distinct().withColumn("text", text), "instance", "text"), "instance")
    return mon.long_form(server.join(replica, "instance"), at(EVENTS_NOW))


def dated_state_dump(spark, sf_dir):
    """Every process appended under its kind and day, read back as counts."""
    work = scratch_path(spark, "state-dump")
    rows = t.processes(table(spark, sf_dir, "customer")).withColumn("kind", F.lit("processlist"))
    trx = t.transactions(table(spark, sf_dir, "orders"))
    append_dated(rows.filter(F.col("info").isNotNull()).select("kind", "id", "time"),
                 work, at(EVENTS_NOW))
    append_dated(
        trx.select(F.lit("trx").alias("kind"), F.col("trx_id").alias("id"),
                   F.lit(0).cast("bigint").alias("time")),
        work, at(EVENTS_NOW),
    )
    dumped = spark.read.parquet(work)
    return dumped.groupBy("kind", "dump_date").agg(
        F.count("*").alias("rows"), F.max("time").alias("longest")
    )


def distinct_instances(spark, sf_dir):
    return t.hourly_counts(table(spark, sf_dir, "events")).select("instance").distinct()


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        counter_rates, counter_rates_stream, gauge_ratios, session_gauges, size_rollup,
        trx_current_statement, lock_wait_graph, monitor_long_form, item_max, latest_error,
        longest_first, usage_threshold, backlog_eta, peak_interval, peak_report_plan,
        heartbeat_status, heartbeat_deadlines, check_interval, health_changes, throughput_rating, replica_status, replica_status_log, metric_log_changes, server_items_long,
        dated_state_dump, distinct_instances,
    )
}

_RATES = f"""WITH {SAMPLES_SQL},
  l AS (SELECT *, lag(value) OVER w AS v0, lag(uptime) OVER w AS u0 FROM samples
        WINDOW w AS (PARTITION BY instance, item ORDER BY ts))
  SELECT ts, instance, item,
    CAST(round_even((value - v0) / CASE WHEN uptime = u0 THEN 1 ELSE uptime - u0 END
      / CASE WHEN item = 'bytes_sent' THEN 1024 ELSE 1 END, 0) AS BIGINT) AS rate,
    value < v0 AS reset
  FROM l WHERE v0 IS NOT NULL"""

_GAUGES = f"""WITH {SESSIONS_SQL},
  run AS (SELECT thread_id, count(*) AS n FROM trx WHERE trx_state = 'RUNNING' GROUP BY thread_id),
  p AS (SELECT p.*, coalesce(n, 0) AS n FROM processes p LEFT JOIN run ON id = thread_id),
  g AS (SELECT instance, count(*) AS conn_cur, CAST(2000 AS BIGINT) AS conn_max,
    CAST(round_even(count(*) / 2000 * 100, 0) AS BIGINT) AS conn_ratio,
    coalesce(max("time") FILTER (command NOT IN ('Binlog Dump', 'Sleep') AND "user" <> 'system user'), 0)
      AS conn_active_sec,
    CAST(sum(n) AS BIGINT) AS trans_active,
    coalesce(max("time") FILTER (n > 0 AND command <> 'Sleep'), 0) AS trans_active_sec,
    CAST(coalesce(sum(n) FILTER (command = 'Sleep'), 0) AS BIGINT) AS trans_uncommited,
    coalesce(max("time") FILTER (n > 0 AND command = 'Sleep'), 0) AS trans_uncommited_sec,
    coalesce(max("time") FILTER (state = 'Waiting for table flush'), 0) AS lock_flush_sec,
    coalesce(max("time") FILTER (state = 'Waiting for table metadata lock'), 0) AS lock_metadata_sec
  FROM p GROUP BY instance)"""

_PEAK = f"""
  m AS (SELECT date_trunc('hour', ts) AS end_time,
      CAST(sum(CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT)) AS DOUBLE) / count(*) AS average
    FROM events WHERE event_type = 'view' GROUP BY 1),
  peak AS (SELECT date_diff('second', TIMESTAMP '1970-01-01', end_time) // 3600 AS snap, average, end_time
    FROM m WHERE end_time > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 7 DAY
    ORDER BY average DESC, snap LIMIT 1)"""

ORACLES: dict[str, str] = {
    "counter_rates": _RATES,
    "counter_rates_stream": _RATES,
    "gauge_ratios": f"""WITH {SAMPLES_SQL},
      m AS (SELECT instance, item, max(n) AS value_max FROM hourly GROUP BY instance, item)
      SELECT ts, instance, item, n AS value, value_max,
        CAST(round_even(CAST(n AS DOUBLE) / nullif(value_max, 0) * 100, 0) AS BIGINT) AS ratio,
        CAST(round_even(n * 16 / 1024, 0) AS BIGINT) AS buffer_gb
      FROM hourly JOIN m USING (instance, item)""",
    "session_gauges": f"{_GAUGES} SELECT * FROM g",
    "size_rollup": f"""WITH line AS (SELECT * FROM lineitem), {stats_sql('l_returnflag')}
      SELECT l_returnflag AS schema_name,
        CAST(floor(sum(blocks * 8192 + num_rows * 64) / 1073741824 + 0.5) AS BIGINT) AS size_gb
      FROM stats GROUP BY l_returnflag""",
    "trx_current_statement": f"""WITH {SESSIONS_SQL},
      e AS (SELECT user_id, event_type || ' ' || props AS sql_text FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
        WHERE rn = 1)
      SELECT trx_id, trx_state, t.thread_id AS processlist_id, c_custkey + 1 AS thread_id,
        '8.' || CAST(c_nationkey AS VARCHAR) AS server_version, sql_text
      FROM trx t LEFT JOIN customer ON c_custkey = t.thread_id LEFT JOIN e ON user_id = c_custkey + 1""",
    "lock_wait_graph": f"""WITH {SESSIONS_SQL},
      w AS (SELECT *, lag(trx_id) OVER (PARTITION BY thread_id ORDER BY trx_id) AS blocker FROM trx)
      SELECT w.trx_id AS waiting_trx_id, w.thread_id AS waiting_thread,
        date_diff('second', w.wait_started, TIMESTAMP '{ORDERS_NOW}') AS wait_time,
        w.trx_query AS waiting_query, 'db.' || substr(w.trx_query, 8) AS waiting_table_lock,
        b.trx_id AS blocking_trx_id, b.thread_id AS blocking_thread,
        CASE WHEN contains(host, ':') THEN split_part(host, ':', 1) ELSE '' END AS blocking_host,
        CASE WHEN contains(host, ':') THEN split_part(host, ':', 2) ELSE host END AS blocking_port,
        CASE WHEN command = 'Sleep' THEN "time" ELSE 0 END AS idle_in_trx,
        b.trx_query AS blocking_query
      FROM w JOIN trx b ON b.trx_id = w.blocker LEFT JOIN processes p ON p.id = b.thread_id
      WHERE w.trx_state = 'LOCK WAIT'""",
    "monitor_long_form": f"""{_GAUGES},
      r AS ({_RATES}),
      s AS (SELECT instance, CAST(floor(sum(q) * 8192 / 1073741824 + 0.5) AS BIGINT) AS v FROM (
        SELECT '330' || CAST(l_suppkey % 4 AS VARCHAR) AS instance, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
        GROUP BY instance),
      k AS (SELECT '330' || CAST(l_orderkey % 4 AS VARCHAR) AS instance, count(*) FILTER (n > 1) AS v FROM (
        SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
        GROUP BY 1)
      SELECT TIMESTAMP '{ORDERS_NOW}' AS ts, instance, item, value FROM (
        (SELECT instance, item, value FROM (UNPIVOT (SELECT *, CAST(1 AS BIGINT) AS mysql_alive FROM g)
          ON COLUMNS(* EXCLUDE instance) INTO NAME item VALUE value))
        UNION ALL SELECT instance, 'db_size_gb', v FROM s
        UNION ALL SELECT instance, 'tab_no_primary_key', v FROM k
        UNION ALL SELECT instance, item, arg_max(rate, ts) FROM r GROUP BY instance, item)""",
    "item_max": f"""WITH {SAMPLES_SQL}
      SELECT instance, item, max(value) AS value FROM samples GROUP BY instance, item""",
    "latest_error": """SELECT event_id, ts, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS error_number,
        props AS error_message
      FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 1""",
    "longest_first": f"""WITH {SESSIONS_SQL}
      SELECT id, "user", command, "time", info FROM processes WHERE info IS NOT NULL
      ORDER BY "time" DESC, id""",
    "usage_threshold": """
      WITH u AS (SELECT l_suppkey,
          CAST(round(CAST(CAST(count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS DOUBLE)
            / nullif(count(*) FILTER (l_linestatus = 'F'), 0) * 100 AS DECIMAL(28,9)), 2) AS DECIMAL(10,2)) AS pre,
          CAST(round(CAST(CAST(count(*) FILTER (l_returnflag = 'N' AND l_linestatus <> 'F') AS DOUBLE)
            / nullif(count(*) FILTER (l_linestatus <> 'F'), 0) * 100 AS DECIMAL(28,9)), 2) AS DECIMAL(10,2)) AS post
        FROM lineitem GROUP BY l_suppkey)
      SELECT s_name AS tablespace_name, s_nationkey AS con_id, CAST(pre AS DOUBLE) AS pre_usage,
        CAST(post AS DOUBLE) AS post_usage, CAST(pre - post AS DOUBLE) AS diff,
        CASE WHEN post > 33 THEN 'abnormal' ELSE 'normal' END AS state
      FROM u JOIN supplier ON s_suppkey = l_suppkey
      WHERE pre > 33 AND s_nationkey NOT IN (1, 2)""",
    "backlog_eta": f"""WITH {SAMPLES_SQL},
      p AS (SELECT instance, item, ts, max(value) OVER (PARTITION BY instance, item) - value AS pending,
          date_diff('second', TIMESTAMP '1970-01-01', ts) AS s FROM samples WHERE item <> 'bytes_sent'),
      l AS (SELECT *, lag(pending) OVER w AS p0, lag(s) OVER w AS s0 FROM p
            WINDOW w AS (PARTITION BY instance, item ORDER BY ts)),
      e AS (SELECT *, CASE WHEN p0 <> pending THEN
          (2 * pending * (s - s0) + (p0 - pending)) // (2 * (p0 - pending)) END AS raw_s, least(raw_s, 3020399) AS left_s
        FROM l WHERE p0 IS NOT NULL)
      SELECT instance, item, ts, pending,
        CASE WHEN left_s IS NOT NULL THEN printf('%02d:%02d:%02d', CAST(left_s // 3600 AS BIGINT),
          CAST(left_s % 3600 // 60 AS BIGINT), CAST(left_s % 60 AS BIGINT)) END AS eta, CAST(raw_s AS BIGINT) AS eta_seconds
      FROM e""",
    "peak_interval": f"""WITH {_PEAK}
      SELECT snap - 1 AS begin_snap, snap AS end_snap, average, end_time FROM peak""",
    "peak_report_plan": f"""WITH {SAMPLES_SQL}, {_PEAK}
      SELECT instance, snap - 1 AS begin_snap, snap AS end_snap,
        'awr_2024_JAN_31_00_00_' || instance || '.html' AS file_name
      FROM (SELECT DISTINCT instance FROM hourly), peak""",
    "heartbeat_status": """
      WITH e AS (SELECT *, date_trunc('hour', ts) AS hour,
          row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS rn,
          CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
      p AS (SELECT user_id, hour, max(ts) AS sent, max(ts) FILTER (event_type IN ('view', 'click')) AS seen,
          max(event_type) FILTER (rn = 1) AS kind, max(k) FILTER (rn = 1) AS k FROM e GROUP BY user_id, hour)
      SELECT user_id, hour, CASE WHEN kind = 'signup' THEN 2 WHEN kind = 'error' THEN 3
          WHEN kind = 'click' AND k < 10 THEN 4 WHEN kind = 'view' AND k < 10 THEN 5
          WHEN kind = 'view' AND k > 90 THEN 6 WHEN seen = sent THEN 1 ELSE 4 END AS status_code FROM p""",
    "heartbeat_deadlines": """SELECT event_id AS probe,
        CASE WHEN event_id % 11 = 0 OR event_id % 7 > 5 THEN 2 WHEN event_id % 13 = 0 THEN 3 WHEN event_id % 17 = 0 THEN 4
          WHEN event_id % 19 = 0 OR 5 + event_id % 13 > 15 THEN 5 WHEN event_id % 23 = 0 THEN 6 WHEN event_id % 29 = 0 THEN 4 ELSE 1 END AS status_code
      FROM events""",
    "check_interval": f"""WITH {SAMPLES_SQL},
      d AS (SELECT instance, max(CAST(ts AS DATE)) AS day FROM samples GROUP BY instance)
      SELECT instance, date_diff('second', min(ts), TIMESTAMP '{EVENTS_NOW}') AS check_interval
      FROM samples JOIN d USING (instance) WHERE CAST(ts AS DATE) = day GROUP BY instance""",
    "health_changes": f"""WITH {SAMPLES_SQL},
      h AS (SELECT instance, ts, coalesce(sum(n) FILTER (item = 'error'), 0) * 4
          <= sum(n) FILTER (item <> 'bytes_sent') AS ok FROM hourly GROUP BY instance, ts),
      l AS (SELECT *, lag(ok) OVER (PARTITION BY instance ORDER BY ts) AS was FROM h)
      SELECT instance, ts, CASE WHEN ok THEN 'healthy' ELSE 'error' END AS notice FROM l
      WHERE NOT ok OR was IS NULL OR NOT was""",
    "throughput_rating": """
      WITH s AS (SELECT event_id, CASE event_type
          WHEN 'view' THEN floor(CAST(value AS DECIMAL(18,2)) * 100 / 1024) / 100
          WHEN 'click' THEN CAST(CAST(value AS DECIMAL(18,2)) * 1024 AS DOUBLE) WHEN 'error' THEN NULL
          ELSE CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) END AS mbps FROM events)
      SELECT event_id, mbps, CASE WHEN mbps > 100 THEN 'excellent' WHEN mbps > 50 THEN 'good'
        WHEN mbps IS NOT NULL THEN 'fair' END AS rating FROM s""",
    "server_items_long": f"""
      WITH s AS (SELECT '330' || CAST(c_custkey % 4 AS VARCHAR) AS instance, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS k FROM customer GROUP BY 1),
      g AS (SELECT *, CAST(round_even(k * 5.0::DOUBLE * 16 / 1024 / 1024, 0) AS BIGINT) AS most, CAST(round_even(n * 1000.0::DOUBLE * 16 / 1024 / 1024, 0) AS BIGINT) AS free FROM s)
      SELECT TIMESTAMP '{EVENTS_NOW}' AS ts, instance, unnest(['conn_active', 'mem_max_size_gb', 'buffer_max_size_gb', 'buffer_used_size_gb', 'buffer_used_ratio',
          'replica_delay_sec', 'error_io_thread', 'error_sql_thread']) AS item,
        unnest([n, CAST(round_even(k * 100.0::DOUBLE / 1024 / 1024, 0) AS BIGINT), most, most - free,
          CASE WHEN most <> 0 THEN CAST(round_even((most - free) / most::DOUBLE * 100, 0) AS BIGINT) END, 7, CAST(instance = '3301' AS BIGINT), 0]) AS value
      FROM g""",
    "replica_status_log": """SELECT c_custkey AS row_no, c_custkey * 3 AS replica_delay_sec, CAST(c_nationkey % 6 = 0 AS BIGINT) AS error_io_thread,
        CAST(0 AS BIGINT) AS error_sql_thread FROM customer""",
    "metric_log_changes": f"""WITH {SAMPLES_SQL},
      d AS (SELECT * FROM samples WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-13')
      SELECT ts, instance, item, value, value - lag(value) OVER (PARTITION BY instance, item ORDER BY ts) AS grown FROM d""",
    "replica_status": """SELECT c_custkey AS replica_id,
        CASE WHEN c_nationkey % 4 = 0 THEN 0 ELSE c_custkey * 7 END AS replica_delay_sec,
        CAST(c_nationkey % 6 = 0 AS BIGINT) AS error_io_thread,
        CAST(c_nationkey % 4 = 0 AS BIGINT) AS error_sql_thread FROM customer""",
    "dated_state_dump": f"""WITH {SESSIONS_SQL}
      SELECT 'processlist' AS kind, DATE '2024-01-31' AS dump_date, count(*) AS "rows",
        max("time") AS longest FROM processes WHERE info IS NOT NULL
      UNION ALL SELECT 'trx', DATE '2024-01-31', count(*), 0 FROM trx""",
    "distinct_instances": f"WITH {SAMPLES_SQL} SELECT DISTINCT instance FROM hourly",
}
