"""Queries over the change feed, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import change_data as cd
from tidewright.plans.tables import FEED_SQL, Query, as_feed, feed, feed_rows, stream_table, table
from tidewright.session import scratch_path
from tidewright.sinks.tables import write_script
from tidewright.sources.change_feed import canal_changes, stream_feed
from tidewright.streaming.bucketed import BucketedTable, Flush, start_bucketed
from tidewright.streaming.tail import undo_available, undo_slice
from tidewright.streaming.upsert import current_rows, upsert_available

LOG_BYTES = 65_536
START, END, LATEST = "2024-01-05 00:00:00", "2024-01-20 00:00:00", "2024-01-25 00:00:00"


def image_columns(df, *extra: str):
    return df.select(
        F.col("image.id").alias("id"), F.col("image.value").alias("value"),
        F.col("image.props").alias("props"), F.col("image.note").alias("note"), *extra,
    )


def change_feed_filter(spark, sf_dir):
    kept = cd.filter_changes(
        feed(spark, sf_dir, before=False, start=START, end=END), START, END, "Update", ["accounts"],
        ("mysql-bin.000000000000", 0),
    )
    return kept.select("log_file", "log_pos", "event_time", "op", F.col("after.id").alias("id"))


def undo_statements(spark, sf_dir):
    return cd.undo_statements(feed(spark, sf_dir)).select("log_pos", "op", "sql", "rollback_sql")


def undo_update_as_replace(spark, sf_dir):
    changes = cd.filter_changes(feed(spark, sf_dir), operation="update")
    return cd.undo_statements(changes).select("log_pos", "replace_sql")


def undo_ordered_script(spark, sf_dir):
    return cd.recovery_script(feed(spark, sf_dir)).select("seq", "log_pos", "block")


def recovery_script_files(spark, sf_dir):
    """The recovery script as files in a folder per table, read back: each line, and how often it stands there."""
    path = scratch_path(spark, "script")
    write_script(cd.recovery_script(feed(spark, sf_dir)), path)
    # A line feed alone ends a line.
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.groupBy("db", "tbl", F.col("value").alias("line")).agg(F.count("*").alias("n"))


def rollback_to_time(spark, sf_dir):
    return image_columns(cd.state_as_of(feed(spark, sf_dir, before=False, end=END), "id", END), "log_pos")


def cdc_upsert_latest(spark, sf_dir):
    rows = feed_rows(table(spark, sf_dir, "events"))
    return image_columns(cd.state_as_of(as_feed(rows, before=False), "id"), "log_pos")


def cdc_stream_upsert(spark, sf_dir):
    """The events as canal-json messages on a file stream, upserted batch by batch."""
    events = stream_table(spark, sf_dir, "events")
    flat = feed_rows(events)
    image = F.struct("id", "value", "props", "note")
    message = F.to_json(
        F.struct(
            F.array(image).alias("data"), F.lit("app").alias("database"),
            F.lit("accounts").alias("table"), F.upper("op").alias("type"),
            (F.col("event_time") * 1000).alias("es"), F.col("gtid").alias("gtid"),
        )
    )
    changes = canal_changes(flat.select(message.alias("value"), "log_file", "log_pos"))
    keyed = cd.key_changes(changes, "id").select("id", "op", "log_file", "log_pos", "row_no", "image")
    order = ["log_file", "log_pos", "row_no"]
    work = scratch_path(spark, "cdc-upsert")
    upsert_available(keyed, ["id"], order, f"{work}/table", f"{work}/checkpoint")
    return image_columns(current_rows(spark, f"{work}/table", ["id"], order), "log_pos")


def cdc_bucketed_upsert(spark, sf_dir):
    """The events in order of time as eight files, one a batch, into buckets of the key; kept batches are flushed by rows."""
    work = scratch_path(spark, "cdc-buckets")
    changes = cd.key_changes(as_feed(feed_rows(table(spark, sf_dir, "events")), before=False), "id")
    keyed = changes.select("id", "op", "log_file", "log_pos", "image")
    keyed.repartitionByRange(8, "log_file", "log_pos").write.parquet(f"{work}/in")
    most = max(1, keyed.count() // 4)
    stored = BucketedTable(spark, f"{work}/table", ["id"], ["log_file", "log_pos"], 16, Flush(rows=most))
    stream = spark.readStream.schema(keyed.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in")
    start_bucketed(stream, stored, f"{work}/checkpoint").awaitTermination()
    stored.flush_now()
    return image_columns(stored.current_rows(), "log_pos")


def undo_stream_tail(spark, sf_dir):
    """The feed arrives as files in two instalments, of each a slice is taken up to another time.

    The first instalment holds changes beyond the first slice; the second run resumes the first.
    """
    work = scratch_path(spark, "undo-tail")
    early = F.col("event_time") < cd.epoch_seconds(F.lit(END).cast("timestamp_ntz"))
    feed(spark, sf_dir).withColumn("early", early.cast("int")).write.partitionBy("early").parquet(f"{work}/all")
    changes, slices = spark.read.parquet(f"{work}/all"), []
    for number, (part, end) in enumerate(((1, START), (0, LATEST)), 1):
        changes.filter(F.col("early") == part).drop("early").write.mode("append").parquet(f"{work}/feed")
        undo_available(stream_feed(spark, f"{work}/feed"), f"{work}/undo", f"{work}/checkpoint")
        taken = undo_slice(spark, f"{work}/undo", end=end)
        slices.append(taken.select("log_pos", "rollback_sql", F.lit(number).alias("slice")))
    return slices[0].unionByName(slices[1])


def gtid_next(spark, sf_dir):
    """One replica per customer, its GTID sets built from the customer's numbers."""
    c = table(spark, sf_dir, "customer")
    base = "3e11fa47-71ca-11e1-9e33-c80aa942956"
    own = F.concat(F.lit(base), (F.col("c_custkey") % 5).cast("string"))
    other = F.concat(F.lit(base), ((F.col("c_custkey") + 1) % 5).cast("string"))
    n = F.col("c_custkey")
    executed = F.concat(
        own, F.lit(":1-"), (n + 10).cast("string"), F.lit(":"), (n + 15).cast("string"), F.lit("-"),
        (n + 20).cast("string"), F.lit(",\n"), other, F.lit(":7"),
    )
    retrieved = F.concat(
        own, F.lit(":"), (n + 5).cast("string"), F.lit("-"), (n + 90).cast("string"),
        F.when(F.col("c_nationkey") < 12, F.concat(F.lit(","), other, F.lit(":2-9"))).otherwise(""),
    )
    status = c.select(
        "c_custkey",
        F.when(F.col("c_mktsegment") != "BUILDING", executed).alias("executed"),
        retrieved.alias("retrieved"),
    )
    return cd.next_gtid(status, "c_custkey")


def txn_slice(spark, sf_dir):
    """Per uuid: transactions before a time are executed, the slice is the next one."""
    changes = feed(spark, sf_dir, before=False)
    uuid, number = F.split("gtid", ":")[0], F.split("gtid", ":")[1].cast("bigint")
    done = F.col("event_time") < cd.epoch_seconds(F.lit(END).cast("timestamp_ntz"))

    def as_set(top):
        return F.concat(F.col("uuid"), F.lit(":1-"), top.cast("string"))

    status = (
        changes.groupBy(uuid.alias("uuid"))
        .agg(F.max(F.when(done, number)).alias("done"), F.max(number).alias("top"))
        .select("uuid", as_set(F.col("done")).alias("executed"), as_set(F.col("top")).alias("retrieved"))
    )
    wanted = cd.next_gtid(status.withColumnRenamed("uuid", "replica"), "replica")
    sliced = cd.transaction_slice(changes, wanted.select(F.col("next_gtid").alias("gtid")))
    return sliced.select("gtid", "log_pos", "op")


def _marked_log(spark, sf_dir):
    """The events as raw logs of three servers: ten events are a transaction between marker events, of which some lack.

    A seventh of the transactions is anonymous, an eleventh has no end, a thirteenth is rolled back; errors stand
    behind the end of theirs. Markers are made once for each transaction, rows carry no gtid.
    """
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("u"), "event_type")
    server, txn = F.col("u") % 3, F.floor(F.col("event_id") / 10) + 1
    start = (F.col("txn") - 1) * 100
    op = F.when(F.col("event_type") == "signup", "insert").otherwise("update")
    op = F.when((F.col("event_type") == "error"), "delete").otherwise(op)
    late = F.when(F.col("event_type") == "error", 99).otherwise(5)
    rows = events.select(server.alias("server"), txn.alias("txn"), op.alias("kind"), (F.col("event_id") * 10 + late).alias("log_pos"))
    gtid = F.concat_ws(":", F.concat(F.lit("3e11fa47-71ca-11e1-9e33-c80aa942956"), F.col("server").cast("string")), F.col("txn").cast("string"))
    t = F.col("txn")
    markers = F.array(
        F.when(t % 7 != 0, F.struct(F.lit("gtid").alias("kind"), start.alias("log_pos"), gtid.alias("gtid"))),
        F.struct(F.lit("BEGIN").alias("kind"), (start + 1).alias("log_pos"), F.lit(None).cast("string").alias("gtid")),
        F.when(
            t % 11 != 0,
            F.struct(F.when(t % 13 == 0, "rollback").otherwise("xid").alias("kind"), (start + 97).alias("log_pos"), F.lit(None).cast("string").alias("gtid")),
        ),
    )
    marked = rows.select("server", "txn").distinct().select("server", "txn", F.inline(F.array_compact(markers)))
    log = rows.select("server", "txn", "kind", "log_pos", F.lit(None).cast("string").alias("gtid")).unionByName(marked)
    return log.drop("txn").withColumn("log_file", F.concat(F.lit("mysql-bin."), F.lpad(F.floor(F.col("log_pos") / LOG_BYTES).cast("string"), 12, "0")))


def txn_of_rows(spark, sf_dir):
    """Every row event of a log whose rows know no transaction, with the one its markers tell."""
    rows = cd.with_transactions(_marked_log(spark, sf_dir), ["server"])
    return rows.select("server", "log_pos", F.col("kind").alias("op"), "gtid", "begin_pos", "outcome")


def txn_marker_span(spark, sf_dir):
    """Per server the rows from a transaction in the middle of its log up to the one with the next number."""
    log = _marked_log(spark, sf_dir)
    number = F.substring_index("gtid", ":", -1).cast("bigint")
    middle = log.filter("gtid IS NOT NULL").groupBy("server").agg(F.max(number).alias("top"), F.min(F.substring_index("gtid", ":", 1)).alias("uuid"))
    half = F.floor(F.col("top") / 2)
    wanted = middle.select("server", F.concat_ws(":", "uuid", (half - F.when(half % 7 == 0, 1).otherwise(0)).cast("string")).alias("gtid"))
    return cd.transaction_span(log, wanted, ["server"]).select("server", "log_pos", F.col("kind").alias("op"))


def _source_and_replica(spark, sf_dir):
    changes = feed(spark, sf_dir, before=False)
    return cd.key_state(changes, "id"), cd.state_as_of(changes, "id", END)


def replica_reconcile_plan(spark, sf_dir):
    source, replica = _source_and_replica(spark, sf_dir)
    return cd.reconcile_plan(source, replica, "id").select("id", "action", "error_code", "repair_sql")


def replica_repaired(spark, sf_dir):
    source, replica = _source_and_replica(spark, sf_dir)
    plan = cd.reconcile_plan(source, replica, "id")
    return image_columns(cd.apply_repairs(replica, plan, "id"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        change_feed_filter, undo_statements, undo_update_as_replace, undo_ordered_script, recovery_script_files,
        rollback_to_time, cdc_upsert_latest, cdc_stream_upsert, cdc_bucketed_upsert, undo_stream_tail, gtid_next, txn_slice, txn_of_rows, txn_marker_span,
        replica_reconcile_plan, replica_repaired,
    )
}


def _lit(col: str) -> str:
    """Quoted text: backslashes and quotes doubled."""
    doubled = rf"replace(replace({col}, '\', '\\'), '''', '''''')"
    return f"CASE WHEN {col} IS NULL THEN 'NULL' ELSE '''' || {doubled} || '''' END"


def _num(col: str) -> str:
    return f"coalesce({col}, 'NULL')"


def _vals(p: str) -> str:
    return f"id || ',' || {_num(p + 'value')} || ',' || {_lit(p + 'props')} || ',' || {_lit(p + 'note')}"


def _sets(p: str) -> str:
    return (
        f"'`id`=' || id || ',`value`=' || {_num(p + 'value')} || ',`props`=' || "
        f"{_lit(p + 'props')} || ',`note`=' || {_lit(p + 'note')}"
    )


def _where(p: str) -> str:
    def test(name: str, text: str) -> str:
        return (
            f"CASE WHEN {p}{name} IS NULL THEN '`{name}` IS NULL' ELSE '`{name}`=' || {text} END"
        )

    return (
        "'`id`=' || id || ' AND ' || " + test("value", f"{p}value") + " || ' AND ' || "
        + test("props", _lit(f"{p}props")) + " || ' AND ' || " + test("note", _lit(f"{p}note"))
    )


_T = "`app`.`accounts`"
_NAMES = "(`id`,`value`,`props`,`note`)"


def _insert(p: str) -> str:
    return f"'INSERT INTO {_T}{_NAMES} VALUES (' || {_vals(p)} || ');'"


def _delete(p: str) -> str:
    return f"'DELETE FROM {_T} WHERE ' || {_where(p)} || ';'"


def _update(new: str, old: str) -> str:
    return f"'UPDATE {_T} SET ' || {_sets(new)} || ' WHERE ' || {_where(old)} || ';'"


_UNDO = f"""
undo AS (
  SELECT *,
    CASE op WHEN 'insert' THEN {_insert('')} WHEN 'update' THEN {_update('', 'p_')}
            ELSE {_delete('p_')} END AS sql,
    CASE op WHEN 'insert' THEN {_delete('')} WHEN 'update' THEN {_update('p_', '')}
            ELSE {_insert('p_')} END AS rollback_sql
  FROM imaged)"""

_END_SECONDS = f"date_diff('second', TIMESTAMP '1970-01-01', TIMESTAMP '{END}')"
_START_SECONDS = f"date_diff('second', TIMESTAMP '1970-01-01', TIMESTAMP '{START}')"


def _state(where: str = "true") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY log_pos DESC) AS rn
      FROM feed WHERE {where}) WHERE rn = 1"""


_PLAN = f"""
src AS ({_state()}),
rep AS (SELECT * FROM ({_state(f'event_time <= {_END_SECONDS}')}) WHERE op <> 'delete'),
plan AS (
  SELECT coalesce(s.id, r.id) AS id, s.value, s.props, s.note,
    CASE WHEN (s.op IS NULL OR s.op = 'delete') AND r.id IS NOT NULL THEN 'skip'
         WHEN s.op <> 'delete' AND r.id IS NULL THEN 'insert'
         WHEN s.op <> 'delete' AND (s.value IS DISTINCT FROM r.value OR s.props IS DISTINCT FROM r.props
              OR s.note IS DISTINCT FROM r.note) THEN 'replace' END AS action
  FROM src s FULL JOIN rep r ON s.id = r.id)"""

_LOG = """
ev AS (SELECT user_id % 3 AS server, CAST(floor(event_id / 10) AS BIGINT) + 1 AS txn,
    CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS kind,
    event_id * 10 + CASE event_type WHEN 'error' THEN 99 ELSE 5 END AS log_pos FROM events),
tx AS (SELECT DISTINCT server, txn, (txn - 1) * 100 AS start FROM ev),
raw AS (SELECT server, kind, log_pos, NULL AS gtid FROM ev
  UNION ALL SELECT server, 'gtid', start, '3e11fa47-71ca-11e1-9e33-c80aa942956' || CAST(server AS VARCHAR) || ':' || CAST(txn AS VARCHAR)
    FROM tx WHERE txn % 7 <> 0
  UNION ALL SELECT server, 'begin', start + 1, NULL FROM tx
  UNION ALL SELECT server, CASE WHEN txn % 13 = 0 THEN 'rollback' ELSE 'xid' END, start + 97, NULL FROM tx WHERE txn % 11 <> 0)"""


ORACLES: dict[str, str] = {
    "change_feed_filter": f"""WITH {FEED_SQL}
      SELECT log_file, log_pos, event_time, op, id FROM feed
      WHERE op = 'update' AND event_time BETWEEN {_START_SECONDS} AND {_END_SECONDS}""",
    "undo_statements": f"WITH {FEED_SQL}, {_UNDO} SELECT log_pos, op, sql, rollback_sql FROM undo",
    "undo_stream_tail": f"""WITH {FEED_SQL}, {_UNDO}
      SELECT log_pos, rollback_sql, 1 AS slice FROM undo WHERE event_time <= {_START_SECONDS}
      UNION ALL SELECT log_pos, rollback_sql, 2 FROM undo
      WHERE event_time <= date_diff('second', TIMESTAMP '1970-01-01', TIMESTAMP '{LATEST}')""",
    "undo_update_as_replace": f"""WITH {FEED_SQL}
      SELECT log_pos, 'REPLACE INTO {_T} {_NAMES} VALUES (' || {_vals('p_')} || ');' AS replace_sql
      FROM imaged WHERE op = 'update'""",
    "undo_ordered_script": f"""WITH {FEED_SQL}, {_UNDO}
      SELECT row_number() OVER (ORDER BY log_pos DESC) AS seq, log_pos,
        '{cd.TIME_LINE}' || strftime(TIMESTAMP '1970-01-01' + to_seconds(event_time) + INTERVAL 8 HOUR,
          '%Y-%m-%d %H:%M:%S') || chr(10) || '{cd.ORIGINAL_LINE}' || sql || chr(10)
        || '{cd.ROLLBACK_LINE}' || rollback_sql || chr(10) || '{cd.RULE_LINE}' AS block
      FROM undo""",
    "rollback_to_time": f"""WITH {FEED_SQL}
      SELECT id, value, props, note, log_pos FROM ({_state(f'event_time <= {_END_SECONDS}')})
      WHERE op <> 'delete'""",
    "cdc_upsert_latest": f"""WITH {FEED_SQL}
      SELECT id, value, props, note, log_pos FROM ({_state()}) WHERE op <> 'delete'""",
    "gtid_next": """
      WITH c AS (SELECT c_custkey, c_custkey AS n, c_nationkey AS k, c_mktsegment <> 'BUILDING' AS e,
          '3e11fa47-71ca-11e1-9e33-c80aa942956' || CAST(c_custkey % 5 AS VARCHAR) AS own,
          '3e11fa47-71ca-11e1-9e33-c80aa942956' || CAST((c_custkey + 1) % 5 AS VARCHAR) AS other
        FROM customer),
      x AS (
        SELECT c_custkey, own AS uuid, CASE WHEN e THEN n + 21 ELSE n + 91 END AS next_no FROM c
        UNION ALL
        SELECT c_custkey, other, CASE WHEN e THEN 8 ELSE 10 END FROM c WHERE k < 12)
      SELECT c_custkey, uuid, next_no, uuid || ':' || CAST(next_no AS VARCHAR) AS next_gtid FROM x""",
    "txn_slice": f"""WITH {FEED_SQL},
      d AS (SELECT uuid, max(txn) FILTER (event_time < {_END_SECONDS}) + 1 AS nxt FROM feed GROUP BY uuid)
      SELECT f.uuid || ':' || CAST(f.txn AS VARCHAR) AS gtid, log_pos, op
      FROM feed f JOIN d ON f.uuid = d.uuid AND f.txn = d.nxt""",
    "txn_of_rows": f"""WITH {_LOG},
      carried AS (SELECT *,
          last_value(CASE WHEN kind = 'gtid' THEN log_pos END IGNORE NULLS) OVER w AS g_at,
          last_value(gtid IGNORE NULLS) OVER w AS g, last_value(CASE WHEN kind = 'begin' THEN log_pos END IGNORE NULLS) OVER w AS b_at,
          last_value(CASE WHEN kind IN ('xid', 'rollback') THEN log_pos END IGNORE NULLS) OVER w AS e_at,
          first_value(CASE WHEN kind IN ('gtid', 'begin', 'xid', 'rollback') THEN kind END IGNORE NULLS) OVER v AS nxt
        FROM raw WINDOW w AS (PARTITION BY server ORDER BY log_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          v AS (PARTITION BY server ORDER BY log_pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
      kept AS (SELECT *, CASE WHEN g_at > coalesce(e_at, -1) THEN g_at WHEN b_at > coalesce(e_at, -1) THEN b_at END AS begin_pos
        FROM carried WHERE kind IN ('insert', 'update', 'delete'))
      SELECT server, log_pos, kind AS op, CASE WHEN g_at > coalesce(e_at, -1) THEN g END AS gtid, begin_pos,
        CASE WHEN begin_pos IS NULL THEN NULL WHEN nxt = 'rollback' THEN 'rolled back' WHEN nxt = 'xid' THEN 'committed' ELSE 'open' END AS outcome
      FROM kept""",
    "txn_marker_span": f"""WITH {_LOG},
      top AS (SELECT server, max(txn) FILTER (txn % 7 <> 0) // 2 AS half FROM tx GROUP BY server),
      aim AS (SELECT server, half - CASE WHEN half % 7 = 0 THEN 1 ELSE 0 END AS n FROM top),
      span AS (SELECT server, (n - 1) * 100 AS start, (SELECT min(t.start) FROM tx t WHERE t.server = aim.server AND t.txn = aim.n + 1 AND t.txn % 7 <> 0) AS stop
        FROM aim WHERE EXISTS (SELECT 1 FROM tx t WHERE t.server = aim.server AND t.txn = aim.n))
      SELECT raw.server, log_pos, kind AS op FROM raw JOIN span ON raw.server = span.server
      WHERE kind IN ('insert', 'update', 'delete') AND log_pos >= start AND (stop IS NULL OR log_pos < stop)""",
    "replica_reconcile_plan": f"""WITH {FEED_SQL}, {_PLAN}
      SELECT id, action, CASE action WHEN 'replace' THEN 1062 ELSE 1032 END AS error_code,
        CASE WHEN action <> 'skip'
          THEN 'REPLACE INTO {_T} {_NAMES} VALUES (' || {_vals('')} || ');' END AS repair_sql
      FROM plan WHERE action IS NOT NULL""",
    "replica_repaired": f"""WITH {FEED_SQL}, {_PLAN}
      SELECT id, value, props, note FROM plan WHERE action IN ('insert', 'replace')
      UNION ALL
      SELECT r.id, r.value, r.props, r.note FROM rep r
      WHERE r.id NOT IN (SELECT id FROM plan WHERE action IN ('insert', 'replace'))""",
}
ORACLES["cdc_stream_upsert"] = ORACLES["cdc_bucketed_upsert"] = ORACLES["cdc_upsert_latest"]

ORACLES["recovery_script_files"] = f"""WITH b AS ({ORACLES['undo_ordered_script']})
  SELECT 'app' AS db, 'accounts' AS tbl, line, count(*) AS n FROM (SELECT unnest(string_split(block, chr(10))) AS line FROM b) GROUP BY line"""
