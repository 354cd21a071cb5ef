"""Readers of the given tables and the shapes the jobs derive from them.

Each adapter turns a given table into an input shape (a change feed, counter
samples, table statistics, ...). The SQL fragments are the same adapters for the
check queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.ordered import SEGMENT_ROWS, with_previous
from tidewright.functions.text import epoch_seconds, log_number

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a file stream. A stream's base path has to be a folder or a
    pattern, so the name ends in a one-letter pattern that also matches a single file."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def cents(col: str):
    """Money as a whole number of cents, exact in every engine."""
    return (F.col(col).cast("decimal(18,2)") * 100).cast("bigint")


# -- change feed -------------------------------------------------------------

def _note():
    kind = F.concat(F.col("event_type"), F.lit("'s C:\\dir\\"))
    return F.when(F.col("event_id") % 7 != 0, kind)


def feed_rows(events: DataFrame) -> DataFrame:
    """Events as flat change rows: signup inserts, error deletes, the rest update."""
    op = (
        F.when(F.col("event_type") == "signup", "insert")
        .when(F.col("event_type") == "error", "delete")
        .otherwise("update")
    )
    # The transaction is the shard's slice of ten events.
    uuid = F.concat(
        F.lit("3e11fa47-71ca-11e1-9e33-c80aa942956"), (F.col("user_id") % 3).cast("string")
    )
    number = F.floor(F.col("event_id") / 10) + 1
    file_no = F.floor(F.col("event_id") / SEGMENT_ROWS).cast("string")
    return events.select(
        F.col("user_id").cast("string").alias("id"),
        op.alias("op"),
        epoch_seconds(F.col("ts")).alias("event_time"),
        F.concat(F.lit("mysql-bin."), F.lpad(file_no, 12, "0")).alias("log_file"),
        F.col("event_id").alias("log_pos"),
        F.concat_ws(":", uuid, number.cast("string")).alias("gtid"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("value"),
        "props",
        _note().alias("note"),
    )


IMAGE_COLUMNS = ["value", "props", "note"]


def as_feed(rows: DataFrame, before: bool = True) -> DataFrame:
    """Flat change rows as a feed; ``before`` adds the previous image of the key."""

    def image(prefix: str):
        pairs = [F.lit("id"), F.col("id")]
        for name in IMAGE_COLUMNS:
            pairs += [F.lit(name), F.col(prefix + name)]
        return F.create_map(*pairs)

    if before:
        rows = with_previous(
            rows, ["id"], ["log_file", "log_pos"],
            {f"prev_{c}": c for c in IMAGE_COLUMNS}, log_number("log_file"),
        )
        old = image("prev_")
    else:
        old = F.create_map(F.lit("id"), F.col("id"))
    types = F.create_map(
        *[F.lit(x) for x in
          ("id", "bigint unsigned", "value", "decimal(18,2)", "props", "longtext", "note", "set('a','b')")]
    )
    return rows.select(
        F.lit("app").alias("db"),
        F.lit("accounts").alias("tbl"),
        "op", "event_time", "log_file", "log_pos", "gtid",
        F.when(F.col("op") != "insert", old).alias("before"),
        F.when(F.col("op") != "delete", image("")).alias("after"),
        types.alias("types"),
    )


def feed(
    spark: SparkSession, sf_dir: str, before: bool = True, start: str | None = None, end: str | None = None
) -> DataFrame:
    """The feed, or its changes between two times to the second; the times bound the stored column.

    A bounded feed has no images of changes before it.
    """
    events = table(spark, sf_dir, "events")
    if start is not None:
        events = events.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        events = events.filter(F.col("ts") < F.timestamp_add("SECOND", F.lit(1), F.lit(end).cast("timestamp_ntz")))
    return as_feed(feed_rows(events), before)


FEED_SQL = f"""
feed AS (
  SELECT CAST(user_id AS VARCHAR) AS id,
    CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
    CAST(date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) AS BIGINT) AS event_time,
    'mysql-bin.' || lpad(CAST(event_id // {SEGMENT_ROWS} AS VARCHAR), 12, '0') AS log_file,
    event_id AS log_pos,
    '3e11fa47-71ca-11e1-9e33-c80aa942956' || CAST(user_id % 3 AS VARCHAR) AS uuid,
    event_id // 10 + 1 AS txn,
    CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value, props,
    CASE WHEN event_id % 7 <> 0 THEN event_type || '''s C:\\dir\\' END AS note,
    ts
  FROM events),
imaged AS (
  SELECT *, lag(value) OVER w AS p_value, lag(props) OVER w AS p_props, lag(note) OVER w AS p_note
  FROM feed WINDOW w AS (PARTITION BY id ORDER BY log_pos))"""


# -- counter samples ---------------------------------------------------------

def hourly_counts(events: DataFrame) -> DataFrame:
    """Events per hour, instance and item, plus the bytes they sent."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    instance = F.concat(F.lit("330"), (F.col("user_id") % 4).cast("string"))
    flat = events.select(
        hour.alias("ts"), instance.alias("instance"),
        F.explode(
            F.array(
                F.struct(F.col("event_type").alias("item"), F.lit(1).cast("bigint").alias("n")),
                F.struct(F.lit("bytes_sent").alias("item"), (cents("value") * 37).alias("n")),
            )
        ).alias("c"),
    )
    return flat.groupBy("ts", "instance", F.col("c.item").alias("item")).agg(F.sum("c.n").alias("n"))


def samples(events: DataFrame) -> DataFrame:
    """Monotone counters polled hourly; uptime counts in hours.

    The running sum sees one row per hour, so its window is bounded by the time span.
    """
    w = Window.partitionBy("instance", "item").orderBy("ts")
    return hourly_counts(events).select(
        "ts", "instance", "item", F.sum("n").over(w).alias("value"),
        F.floor(epoch_seconds(F.col("ts")) / 3600).alias("uptime"),
    )


SAMPLES_SQL = """
flat AS (
  SELECT date_trunc('hour', ts) AS ts, '330' || CAST(user_id % 4 AS VARCHAR) AS instance,
    event_type AS item, 1 AS n FROM events
  UNION ALL
  SELECT date_trunc('hour', ts), '330' || CAST(user_id % 4 AS VARCHAR), 'bytes_sent',
    CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) * 37 FROM events),
hourly AS (SELECT ts, instance, item, CAST(sum(n) AS BIGINT) AS n FROM flat GROUP BY ts, instance, item),
samples AS (
  SELECT ts, instance, item,
    CAST(sum(n) OVER (PARTITION BY instance, item ORDER BY ts) AS BIGINT) AS value,
    CAST(date_diff('second', TIMESTAMP '1970-01-01', ts) // 3600 AS BIGINT) AS uptime
  FROM hourly)"""


# -- sessions ----------------------------------------------------------------

def processes(customer: DataFrame) -> DataFrame:
    """Customers as a server's process list."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    command = (
        F.when(nation % 5 == 0, "Sleep").when(nation % 5 == 2, "Binlog Dump")
        .when(nation % 5 == 3, "Execute").otherwise("Query")
    )
    segment = F.col("c_mktsegment")
    host = F.when(nation == 0, "localhost").otherwise(
        F.concat(F.lit("10.0.0."), nation.cast("string"), F.lit(":"), (key % 1000 + 50000).cast("string"))
    )
    return customer.select(
        key.alias("id"),
        F.when(segment == "MACHINERY", "system user").otherwise(F.lower(segment)).alias("user"),
        host.alias("host"),
        command.alias("command"),
        F.floor(F.abs(cents("c_acctbal")) / 100).alias("time"),
        F.when(segment == "BUILDING", "Waiting for table flush")
        .when(segment == "FURNITURE", "Waiting for table metadata lock")
        .otherwise("executing").alias("state"),
        F.when(command != "Sleep", F.concat(F.lit("select "), "c_name")).alias("info"),
        F.concat(F.lit("330"), (nation % 4).cast("string")).alias("instance"),
    )


def transactions(orders: DataFrame) -> DataFrame:
    """Orders as open transactions; the customer is the thread."""
    status = F.col("o_orderstatus")
    return orders.select(
        F.col("o_orderkey").alias("trx_id"),
        F.when(status == "P", "RUNNING").when(status == "O", "LOCK WAIT")
        .otherwise("ROLLING BACK").alias("trx_state"),
        F.col("o_custkey").alias("trx_mysql_thread_id"),
        F.col("o_orderdate").alias("trx_wait_started"),
        F.concat(F.lit("update "), "o_orderpriority").alias("trx_query"),
    )


SESSIONS_SQL = """
processes AS (
  SELECT c_custkey AS id,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'system user' ELSE lower(c_mktsegment) END AS "user",
    CASE WHEN c_nationkey = 0 THEN 'localhost' ELSE '10.0.0.' || CAST(c_nationkey AS VARCHAR) || ':'
      || CAST(c_custkey % 1000 + 50000 AS VARCHAR) END AS host,
    CASE c_nationkey % 5 WHEN 0 THEN 'Sleep' WHEN 2 THEN 'Binlog Dump' WHEN 3 THEN 'Execute'
      ELSE 'Query' END AS command,
    CAST(abs(CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT)) // 100 AS BIGINT) AS "time",
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Waiting for table flush'
      WHEN 'FURNITURE' THEN 'Waiting for table metadata lock' ELSE 'executing' END AS state,
    CASE WHEN c_nationkey % 5 <> 0 THEN 'select ' || c_name END AS info,
    '330' || CAST(c_nationkey % 4 AS VARCHAR) AS instance
  FROM customer),
trx AS (
  SELECT o_orderkey AS trx_id, CASE o_orderstatus WHEN 'P' THEN 'RUNNING' WHEN 'O' THEN 'LOCK WAIT'
      ELSE 'ROLLING BACK' END AS trx_state,
    o_custkey AS thread_id, o_orderdate AS wait_started, 'update ' || o_orderpriority AS trx_query
  FROM orders)"""


# -- table statistics --------------------------------------------------------

def table_stats(lineitem: DataFrame, *extra: str) -> DataFrame:
    """Line items per supplier as catalog statistics of one table (or partition) each."""
    return (
        lineitem.groupBy("l_suppkey", *extra)
        .agg(
            F.sum(F.col("l_quantity").cast("bigint")).alias("blocks"),
            F.count("*").alias("num_rows"),
        )
        .withColumn("avg_row_len", F.col("l_suppkey") % 100 * 2000)
        .withColumn("table_name", F.concat(F.lit("T_"), F.col("l_suppkey").cast("string")))
    )


def stats_sql(*extra: str) -> str:
    columns = "".join(f", {c}" for c in extra)
    return f"""
stats AS (
  SELECT l_suppkey{columns}, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS blocks,
    count(*) AS num_rows, l_suppkey % 100 * 2000 AS avg_row_len,
    'T_' || CAST(l_suppkey AS VARCHAR) AS table_name
  FROM line GROUP BY l_suppkey{columns})"""
