"""Queries over files, keys and lists, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions.ordered import SEGMENT_ROWS
from tidewright.functions.text import epoch_seconds
from tidewright.operators import retention as rt
from tidewright.plans.tables import Query, table
from tidewright.session import scratch_path
from tidewright.sources.inventory import read_files, read_keys

FILES_NOW, KEYS_NOW = "2001-08-02 00:00:00", "2024-02-01 00:00:00"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _files(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.concat_ws("_", "o_orderstatus", F.col("o_orderkey").cast("string"))
    return o.select(
        F.concat_ws("/", F.lit("/backup"), "o_orderpriority", name).alias("path"),
        F.col("o_orderdate").alias("mtime"),
    )


def retention_plan(spark, sf_dir):
    """180 days for every priority, 30 for its F files, nothing for 5-LOW."""
    rules = [(f"/backup/{p}", "", 180) for p in PRIORITIES[:-1]]
    rules += [(f"/backup/{p}/", "F_", 30) for p in PRIORITIES[:-1]]
    return rt.retention_plan(_files(spark, sf_dir), rules, at(FILES_NOW))


def history_expiry(spark, sf_dir):
    history = table(spark, sf_dir, "events").select("event_id", "ts")
    return rt.expired_days(history, "ts", at(KEYS_NOW), 15).select("event_id")


def incremental_copy_plan(spark, sf_dir):
    """Copies of recent files and clean-up of the old ones on the target."""
    files = _files(spark, sf_dir)
    copies = rt.copy_plan(files, "/backup", "/mnt/copy", 30, at(FILES_NOW))
    target = files.select(F.replace("path", F.lit("/backup/"), F.lit("/mnt/copy/")).alias("path"), "mtime")
    removed = rt.target_cleanup(target, 2000, at(FILES_NOW))
    return copies.withColumn("action", F.lit("copy")).unionByName(
        removed.select("path", F.lit(None).cast("string").alias("target"), F.lit("delete").alias("action"))
    )


def file_sync_plan(spark, sf_dir):
    """Customers as files on two sides, a folder per nation: the target lacks some, has shorter ones and ones of its own. The
    plan is made at once, and once more as if two years had passed."""
    work = scratch_path(spark, "sync")
    customer = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_name")
    n = F.col("nation")
    target = customer.filter((n < 20) & ((n % 5 != 0) | (F.col("c_custkey") % 2 == 0)))
    own = customer.filter(n < 3).withColumn("nation", n + 100)
    sides = customer.withColumn("side", F.lit("source")).unionByName(target.unionByName(own).withColumn("side", F.lit("target")))
    # One task writes all, so a nation's file has one name on both sides.
    sides.coalesce(1).write.partitionBy("side", "nation").parquet(work)

    def files(side):
        return read_files(spark, f"{work}/side={side}").withColumnRenamed("modificationTime", "mtime")

    plans = []
    for later in (False, True):
        now = F.current_timestamp() + F.expr(f"INTERVAL {730 * later} DAYS")
        roots = [f"{work}/side=source", f"{work}/side=target"]
        plan = rt.sync_plan(files("source"), files("target"), *roots, 30, now)
        nation = F.regexp_extract("relative", r"^nation=(\d+)/", 1).cast("bigint")
        plans.append(plan.select(nation.alias("nation"), "action", F.lit(later).alias("later")))
    return plans[0].unionByName(plans[1])


def idle_keys_file(spark, sf_dir):
    """The keys as an exported listing that is read back."""
    path = scratch_path(spark, "keys")
    _keys(spark, sf_dir).write.option("header", True).csv(path)
    return rt.idle_keys(read_keys(spark, path), 172_800)


def _keys(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max_by(F.struct("ts", "props"), "event_id").alias("l")
    )
    k = F.get_json_object("l.props", "$.k").cast("int")
    return last.select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        (epoch_seconds(at(KEYS_NOW)) - epoch_seconds(F.col("l.ts"))).alias("idle_sec"),
        F.when(k % 2 == 0, -1).otherwise(k).cast("bigint").alias("ttl_sec"),
    )


def idle_keys(spark, sf_dir):
    return rt.idle_keys(_keys(spark, sf_dir), 86_400 * 2)


def head_trim_rounds(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id")
    return rt.trim_rounds(rows, "event_type", "event_id", F.floor(F.col("event_id") / SEGMENT_ROWS))


def next_generation(spark, sf_dir):
    """Backups named per customer; only F ones carry a number."""
    o = table(spark, sf_dir, "orders")
    numbered = F.concat_ws("_", "o_orderpriority", (F.col("o_orderkey") % 1000).cast("string"))
    names = o.select(
        "o_custkey",
        F.when(F.col("o_orderstatus") == "F", numbered).otherwise(F.col("o_orderpriority")).alias("name"),
    )
    return rt.next_generation(names, "o_custkey", "name", start=1)


def completeness_check(spark, sf_dir):
    """Orders as backup files named by priority and day; one pattern for each priority."""
    day = F.lit("1998-10-03").cast("date")
    path = F.format_string(
        "/backup/db_%s_%s_%d.bak", "o_orderpriority", F.date_format("o_orderdate", "yyyyMMdd"), "o_orderkey"
    )
    files = table(spark, sf_dir, "orders").select(path.alias("path"), F.col("o_orderdate").alias("mtime"))
    patterns = [f"db_{p}_<day>_*.bak" for p in [*PRIORITIES, "6-NEVER"]]
    expected = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    return rt.completeness(expected, rt.by_pattern(files, patterns, day), day)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        retention_plan, history_expiry, incremental_copy_plan, idle_keys, idle_keys_file, file_sync_plan, head_trim_rounds,
        next_generation, completeness_check,
    )
}

_FILES = f"""
f AS (SELECT '/backup/' || o_orderpriority || '/' || o_orderstatus || '_' || CAST(o_orderkey AS VARCHAR) AS path,
    o_orderpriority AS p, o_orderstatus AS s, o_orderdate AS m,
    CAST(date_diff('second', o_orderdate, TIMESTAMP '{FILES_NOW}') // 86400 AS BIGINT) AS age_days
  FROM orders)"""

ORACLES: dict[str, str] = {
    "retention_plan": f"""WITH {_FILES},
      x AS (SELECT *, CASE WHEN p = '5-LOW' THEN NULL WHEN s = 'F' THEN 30 ELSE 180 END AS n FROM f)
      SELECT path, age_days, CASE WHEN n IS NULL OR age_days <= n THEN 'Kept'
        WHEN day(m) = 1 THEN 'Skipped' ELSE 'Deleted' END AS action FROM x""",
    "history_expiry": f"""SELECT event_id FROM events
      WHERE CAST(ts AS DATE) < CAST(TIMESTAMP '{KEYS_NOW}' - INTERVAL 15 DAY AS DATE)""",
    "incremental_copy_plan": f"""WITH {_FILES}
      SELECT path, '/mnt/copy' || substr(path, 8) AS target, 'copy' AS action FROM f WHERE age_days < 30
      UNION ALL SELECT '/mnt/copy' || substr(path, 8), NULL, 'delete' FROM f WHERE age_days > 2000""",
    "idle_keys": f"""WITH l AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
          row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
      SELECT 'user:' || CAST(user_id AS VARCHAR) AS key,
        date_diff('second', date_trunc('second', ts), TIMESTAMP '{KEYS_NOW}') AS idle_sec, CAST(-1 AS BIGINT) AS ttl_sec
      FROM l WHERE rn = 1 AND k % 2 = 0
        AND date_diff('second', date_trunc('second', ts), TIMESTAMP '{KEYS_NOW}') > 172800""",
    "file_sync_plan": """WITH n AS (SELECT DISTINCT c_nationkey AS nation FROM customer),
      p AS (SELECT nation, CASE WHEN nation >= 20 OR nation % 5 = 0 THEN 'copy' ELSE 'keep' END AS action, nation < 20 AS there FROM n
        UNION ALL SELECT nation + 100, 'keep', true FROM n WHERE nation < 3)
      SELECT nation, action, false AS later FROM p
      UNION ALL SELECT nation, CASE WHEN there THEN 'delete' ELSE 'skip' END, true FROM p""",
    "head_trim_rounds": """WITH n AS (SELECT event_type, event_id,
          row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn,
          count(*) OVER (PARTITION BY event_type) AS total FROM events)
      SELECT event_type, event_id, (rn - 1) // 200 + 1 AS round,
        CASE WHEN total - (rn - 1) // 200 * 200 < 200 THEN 'delete' ELSE 'trim' END AS how FROM n""",
    "next_generation": """SELECT o_custkey,
        coalesce(max(o_orderkey % 1000) FILTER (o_orderstatus = 'F') + 1, 1) AS next_no
      FROM orders GROUP BY o_custkey""",
    "completeness_check": """SELECT 'db_' || pattern || '_<day>_*.bak' AS pattern, count(o_orderkey) AS n,
        CASE WHEN count(o_orderkey) = 0 THEN 'error' ELSE 'ok' END AS state
      FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NEVER')) v(pattern)
      LEFT JOIN orders ON o_orderpriority = pattern AND CAST(o_orderdate AS DATE) = DATE '1998-10-03'
      GROUP BY pattern""",
}
ORACLES["idle_keys_file"] = ORACLES["idle_keys"]
