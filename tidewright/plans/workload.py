"""Queries that draw repeatable workload rows, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import workload as wl
from tidewright.plans.tables import Query, table

SEED = 42


def workload_actions(spark, sf_dir):
    """One worker action per order number."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"))
    return wl.workload_actions(rows, SEED)


def _results(spark, sf_dir):
    """Events as result messages of a load test: errors failed, the rest changed rows."""
    k = F.get_json_object("props", "$.k")
    message = F.when(
        F.col("event_type") == "error",
        F.concat(F.lit("更新失败："), "props"),
    ).when(
        k.cast("int") % 10 == 0, F.concat(F.lit("查询失败：id="), F.col("event_id").cast("string"))
    ).otherwise(F.concat(F.lit("插入成功：影响行数="), k))
    return table(spark, sf_dir, "events").select("event_type", "event_id", "ts", message.alias("message"))


def workload_summary(spark, sf_dir):
    return wl.run_summary(_results(spark, sf_dir), "event_type", "event_id")


def random_pick_per_user(spark, sf_dir):
    return wl.random_pick(table(spark, sf_dir, "events"), ["user_id"], "event_id", SEED)


def conditional_pick_change(spark, sf_dir):
    """Per user one signup row turns into an update."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    changes = {"event_type": F.lit("update"), "props": F.concat(F.lit("changed "), "props")}
    return wl.pick_and_change(rows, ["user_id"], "event_id", F.col("event_type") == "signup", changes, SEED)


def conditional_pick_remove(spark, sf_dir):
    """Per user one row is deleted."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return wl.pick_and_remove(rows, ["user_id"], "event_id", F.lit(True), SEED)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        workload_actions, workload_summary, random_pick_per_user, conditional_pick_change,
        conditional_pick_remove,
    )
}


def _fraction(salt: str) -> str:
    text = f"md5('{SEED}|{salt}|' || CAST(o_orderkey AS VARCHAR))"
    return f"(CAST('0x' || substr({text}, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


_DRAW = f"md5('{SEED}|' || CAST(event_id AS VARCHAR)), event_id"

ORACLES: dict[str, str] = {
    "workload_actions": f"""SELECT o_orderkey AS seq,
        CASE WHEN {_fraction('action')} * 10 < 5 THEN 'query' WHEN {_fraction('action')} * 10 < 7 THEN 'insert'
          ELSE 'update' END AS action,
        CAST(floor({_fraction('user')} * 100) + 1 AS BIGINT) AS user_id,
        (floor({_fraction('amount')} * 99000 + 0.5) + 1000) / 100 AS amount,
        ['pending', 'completed', 'cancelled'][CAST(floor({_fraction('state')} * 3) AS INT) + 1] AS state
      FROM orders""",
    "workload_summary": """WITH m AS (SELECT event_type, event_id, ts,
          CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type = 'error' AS err, props FROM events),
      x AS (SELECT *, err OR k % 10 = 0 AS bad, CASE WHEN err THEN '更新失败：' || props
          ELSE '查询失败：id=' || CAST(event_id AS VARCHAR) END AS message FROM m),
      r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM x WHERE bad),
      f AS (SELECT event_type, string_agg(message, '; ' ORDER BY event_id) AS first_failures FROM r
        WHERE rn <= 10 GROUP BY event_type)
      SELECT event_type, count(*) AS total, count(*) FILTER (NOT bad) AS successes,
        count(*) FILTER (bad) AS failures, CAST(coalesce(sum(k) FILTER (NOT bad), 0) AS BIGINT) AS affected,
        CAST(round(CAST(date_diff('microsecond', min(ts), max(ts)) AS DECIMAL(20,0)) / 1000000, 2) AS DOUBLE) AS elapsed,
        any_value(first_failures) AS first_failures
      FROM x LEFT JOIN f USING (event_type) GROUP BY event_type""",
    "random_pick_per_user": f"""SELECT * EXCLUDE rn FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_DRAW}) AS rn FROM events) WHERE rn = 1""",
    "conditional_pick_change": f"""WITH p AS (SELECT *, row_number() OVER (
          PARTITION BY user_id, event_type = 'signup' ORDER BY {_DRAW}) = 1 AND event_type = 'signup' AS hit FROM events)
      SELECT event_id, user_id, CASE WHEN hit THEN 'update' ELSE event_type END AS event_type,
        CASE WHEN hit THEN 'changed ' || props ELSE props END AS props FROM p""",
    "conditional_pick_remove": f"""SELECT event_id, user_id, event_type FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_DRAW}) AS rn FROM events) WHERE rn > 1""",
}
