"""Row-change feeds: filtering, undo statements, state, GTID sets and replica repair.

A feed row is ``db, tbl, op, event_time, log_file, log_pos, gtid, before, after,
types``; images are ``map<string,string>`` and ``types`` tells how to quote them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.ordered import latest_per_key, numbered, with_last
from tidewright.functions.text import BARE_TYPES, clock_in_zone, epoch_seconds, log_number

OPERATIONS = ("insert", "update", "delete")


def filter_changes(
    feed: DataFrame,
    start: str | None = None,
    end: str | None = None,
    operation: str | None = None,
    tables: list[str] | None = None,
    from_position: tuple[str, int] | None = None,
) -> DataFrame:
    """Row events from a position on, between two inclusive times, of one kind and some tables."""
    keep = F.col("op").isin(*OPERATIONS)
    if operation is not None:
        wanted = operation.lower()
        if wanted not in OPERATIONS:
            raise ValueError(f"operation must be one of {OPERATIONS}: {operation!r}")
        keep = F.col("op") == wanted
    if tables:
        keep &= F.col("tbl").isin(*tables)
    if start is not None:
        keep &= F.col("event_time") >= epoch_seconds(F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        keep &= F.col("event_time") <= epoch_seconds(F.lit(end).cast("timestamp_ntz"))
    if from_position is not None:
        log_file, log_pos = from_position
        here, there = log_number("log_file"), log_number(F.lit(log_file))
        keep &= (here > there) | ((here == there) & (F.col("log_pos") >= log_pos))
    return feed.filter(keep)


def feed_usable(row_format: str, row_image: str) -> bool:
    """A feed can be undone only with row format and full images; both are required."""
    return row_format.upper() == "ROW" and row_image.upper() == "FULL"


# Columns whose values stand bare in SQL text; a column without a type counts as text.
_BARE = f"""map_keys(map_filter(types, (k, t) -> lower(substring_index(substring_index(trim(t), '(', 1), ' ', 1))
  IN ({", ".join(repr(t) for t in BARE_TYPES)})))"""


def _rendered(image: str, backslash_escapes: bool = True) -> Column:
    """An image's columns in their order: quoted name and value as SQL text.

    A server reads a backslash as an escape unless its mode says NO_BACKSLASH_ESCAPES.
    """
    value = r"replace(e.value, '\\', '\\\\')" if backslash_escapes else "e.value"
    return F.expr(
        f"""transform(map_entries({image}), e -> named_struct('n', concat('`', e.key, '`'),
          'v', CASE WHEN e.value IS NULL THEN NULL WHEN array_contains(_bare, e.key) THEN e.value
            ELSE concat("'", replace({value}, "'", "''"), "'") END))"""
    )


def _each(rendered: str, item: str, separator: str) -> Column:
    return F.expr(f"array_join(transform({rendered}, e -> {item}), '{separator}')")


def _assignments(rendered: str) -> Column:
    return _each(rendered, "concat(e.n, '=', coalesce(e.v, 'NULL'))", ",")


def _predicate(rendered: str) -> Column:
    return _each(rendered, "coalesce(concat(e.n, '=', e.v), concat(e.n, ' IS NULL'))", " AND ")


def _names(rendered: str) -> Column:
    return _each(rendered, "e.n", ",")


def _values(rendered: str) -> Column:
    return _each(rendered, "coalesce(e.v, 'NULL')", ",")


def _table_name() -> Column:
    plain = F.concat(F.lit("`"), F.col("tbl"), F.lit("`"))
    full = F.concat(F.lit("`"), F.col("db"), F.lit("`."), plain)
    return F.when(F.coalesce(F.col("db"), F.lit("")) == "", plain).otherwise(full)


def undo_statements(feed: DataFrame, limit_one: bool = False, backslash_escapes: bool = True) -> DataFrame:
    """Add ``sql``, ``rollback_sql`` and, for updates, ``replace_sql`` to each event.

    ``limit_one`` guards tables without a key, where a predicate over every column
    may match several rows. Without ``backslash_escapes`` the text is for a server in
    NO_BACKSLASH_ESCAPES mode.
    """
    table, before, after = _table_name(), "_before", "_after"
    end = F.lit(" LIMIT 1;" if limit_one else ";")

    def insert(image):
        return F.concat(
            F.lit("INSERT INTO "), table, F.lit("("), _names(image), F.lit(") VALUES ("),
            _values(image), F.lit(");"),
        )

    def delete(image):
        return F.concat(F.lit("DELETE FROM "), table, F.lit(" WHERE "), _predicate(image), end)

    def update(new, old):
        return F.concat(
            F.lit("UPDATE "), table, F.lit(" SET "), _assignments(new),
            F.lit(" WHERE "), _predicate(old), end,
        )

    op = F.col("op")
    rendered = feed.withColumn("_bare", F.expr(_BARE)).withColumns(
        {"_before": _rendered("before", backslash_escapes), "_after": _rendered("after", backslash_escapes)}
    )
    return rendered.withColumns(
        {
            "sql": F.when(op == "insert", insert(after))
            .when(op == "update", update(after, before))
            .when(op == "delete", delete(before)),
            "rollback_sql": F.when(op == "insert", delete(after))
            .when(op == "update", update(before, after))
            .when(op == "delete", insert(before)),
            "replace_sql": F.when(op == "update", _replace(before)),
        }
    ).drop("_bare", "_before", "_after")


def _replace(rendered: str) -> Column:
    return F.concat(
        F.lit("REPLACE INTO "), _table_name(), F.lit(" ("), _names(rendered), F.lit(") VALUES ("),
        _values(rendered), F.lit(");"),
    )


def with_replace(rows: DataFrame, image: str, name: str) -> DataFrame:
    """Add the ``REPLACE INTO`` of a row image."""
    rendered = rows.withColumn("_bare", F.expr(_BARE)).withColumn("_image", _rendered(image))
    return rendered.withColumn(name, _replace("_image")).drop("_bare", "_image")


# The comment lines around one event of a recovery script.
TIME_LINE = "-- SQL执行时间:"
ORIGINAL_LINE = "-- 原生sql:\n \t-- "
ROLLBACK_LINE = "-- 回滚sql:\n \t"
RULE_LINE = "-- ----------------------------------------------------------"


def recovery_script(
    feed: DataFrame, statement: str = "rollback_sql", zone: str = "Asia/Shanghai",
    newest_first: bool = True,
) -> DataFrame:
    """One numbered text block per event: time, original, undo, rule.

    Undo has to run backwards, so the newest event comes first unless asked otherwise.
    Log files are the segments of the numbering, in the order of their numbers: a server bounds their size.
    """
    block = F.concat(
        F.lit(TIME_LINE), clock_in_zone(F.col("event_time"), zone), F.lit("\n" + ORIGINAL_LINE),
        F.col("sql"), F.lit("\n" + ROLLBACK_LINE), F.col(statement), F.lit("\n" + RULE_LINE),
    )
    kept = feed.filter(F.col("op").isin(["update"] if statement == "replace_sql" else list(OPERATIONS)))
    # Numbered before the text is built, so the short rows are shuffled.
    kept = kept.withColumn("_log", log_number("log_file"))
    placed = numbered(kept, [], ["_log", "log_file", "log_pos"], F.col("_log"), "seq", newest_first).drop("_log")
    return undo_statements(placed).select(
        "seq", "db", "tbl", "event_time", "log_file", "log_pos", block.alias("block")
    )


def key_changes(feed: DataFrame, key: str) -> DataFrame:
    """The feed per key: ``op`` and ``image`` (the row after it). An update that changes the
    key also deletes the old one."""
    before, after, op = F.col("before"), F.col("after"), F.col("op")
    moved = (op == "update") & before[key].isNotNull() & (before[key] != after[key])
    here = F.struct(
        F.coalesce(after, before)[key].alias(key), op.alias("op"), after.alias("image")
    )
    gone = F.struct(
        before[key].alias(key), F.lit("delete").alias("op"),
        F.lit(None).cast("map<string,string>").alias("image"),
    )
    rest = [c for c in feed.columns if c not in ("op", "before", "after")]
    return feed.select(*rest, F.inline(F.when(moved, F.array(here, gone)).otherwise(F.array(here))))


def key_state(feed: DataFrame, key: str) -> DataFrame:
    """The last change per key, deletions kept."""
    changes = key_changes(feed, key).select(
        "db", "tbl", key, "op", "log_file", "log_pos", "image", "types", log_number("log_file").alias("_log")
    )
    return latest_per_key(changes, ["db", "tbl", key], ["_log", "log_file", "log_pos"]).drop("_log")


def state_as_of(feed: DataFrame, key: str, until: str | None = None) -> DataFrame:
    """The live row per key at a time (inclusive): last image wins, deleted keys are gone.

    This is both the primary-key upsert of a feed and its point-in-time rollback.
    """
    if until is not None:
        feed = filter_changes(feed, end=until)
    return key_state(feed, key).filter(F.col("op") != "delete").drop("op")


# Server error codes a repair answers to.
DUPLICATE_KEY, MISSING_ROW = 1062, 1032


def reconcile_plan(source: DataFrame, replica: DataFrame, key: str) -> DataFrame:
    """What makes a replica equal to its source, one row per differing key.

    ``source`` is ``key_state`` of the feed, ``replica`` the live rows there. A missing
    row is inserted and a differing one replaced, both as ``REPLACE``; a row whose last
    event is a delete is skipped, as the repair skips deletes.
    """
    theirs = replica.select(*["db", "tbl", key], F.col("image").alias("replica_image"))
    both = source.join(theirs, ["db", "tbl", key], "full")
    gone = F.col("op").isNull() | (F.col("op") == "delete")
    has_row = F.col("replica_image").isNotNull()
    # Maps do not compare, sorted entry arrays do.
    ours, other = (F.array_sort(F.map_entries(c)) for c in ("image", "replica_image"))
    differs = ~ours.eqNullSafe(other)
    action = (
        F.when(gone & has_row, "skip")
        .when(~gone & ~has_row, "insert")
        .when(~gone & differs, "replace")
    )
    planned = with_replace(both.withColumn("action", action), "image", "_replace").filter(
        F.col("action").isNotNull()
    )
    return planned.select(
        "db", "tbl", key, "action",
        F.when(F.col("action") == "replace", DUPLICATE_KEY).otherwise(MISSING_ROW).alias("error_code"),
        F.when(F.col("action") != "skip", F.col("_replace")).alias("repair_sql"),
        "image",
    )


def apply_repairs(replica: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """The replica after the plan: replaced and inserted rows win over the old ones."""
    keys = ["db", "tbl", key]
    new = plan.filter(F.col("action") != "skip").select(*keys, F.col("image").alias("new_image"))
    return (
        replica.select(*keys, "image")
        .join(new, keys, "full")
        .select(*keys, F.coalesce("new_image", "image").alias("image"))
    )


def gtid_ranges(text: Column) -> Column:
    """``uuid:1-5:7, uuid:9`` as ``array<struct<uuid,lo,hi>>``; every range of an entry is read."""
    entry = F.lit(r"(\w+-\w+-\w+-\w+-\w+)((?::\d+(?:-\d+)?)+)")
    entries = F.arrays_zip(
        F.regexp_extract_all(text, entry, F.lit(1)).alias("uuid"),
        F.regexp_extract_all(text, entry, F.lit(2)).alias("spans"),
    )
    return F.flatten(
        F.transform(
            entries,
            lambda e: F.transform(
                F.regexp_extract_all(e["spans"], F.lit(r"\d+(?:-\d+)?"), F.lit(0)),
                lambda r: F.struct(
                    e["uuid"].alias("uuid"),
                    F.substring_index(r, "-", 1).cast("bigint").alias("lo"),
                    F.substring_index(r, "-", -1).cast("bigint").alias("hi"),
                ),
            ),
        )
    )


def next_gtid(status: DataFrame, id_col: str) -> DataFrame:
    """The next transaction to apply per replica and uuid.

    ``status`` has ``executed`` and ``retrieved`` set texts. Executed ranges count when
    their uuid occurs among the retrieved ones; with nothing executed the retrieved set
    stands in. Everything happens inside the row, nothing is shuffled.
    """
    executed = gtid_ranges(
        F.when(F.coalesce(F.col("executed"), F.lit("")) == "", F.col("retrieved")).otherwise(
            F.col("executed")
        )
    )
    ranges = status.select(
        id_col,
        executed.alias("_executed"),
        F.transform(gtid_ranges(F.col("retrieved")), lambda r: r["uuid"]).alias("_retrieved"),
    )
    known = F.filter(
        "_executed", lambda r: F.array_contains(F.col("_retrieved"), r["uuid"])
    )
    uuids = F.array_distinct(F.transform("_known", lambda r: r["uuid"]))
    per_uuid = F.transform(
        uuids,
        lambda u: F.struct(
            u.alias("uuid"),
            (
                F.array_max(
                    F.transform(
                        F.filter("_known", lambda r: r["uuid"] == u), lambda r: r["hi"]
                    )
                )
                + 1
            ).alias("next_no"),
        ),
    )
    return (
        ranges.withColumn("_known", known)
        .select(id_col, F.explode(per_uuid).alias("n"))
        .select(
            id_col,
            "n.uuid",
            "n.next_no",
            F.concat_ws(":", "n.uuid", F.col("n.next_no").cast("string")).alias("next_gtid"),
        )
    )


def transaction_slice(feed: DataFrame, gtids: DataFrame) -> DataFrame:
    """The row events of the given transactions (``gtid`` column)."""
    return feed.join(gtids.select("gtid").distinct(), "gtid", "left_semi")


# Kinds of log events that open and end a transaction.
OPENING, ENDING, UNDONE = "begin", ("commit", "xid", "rollback"), "rollback"


def with_transactions(log: DataFrame, keys: list[str], segment: Column | None = None) -> DataFrame:
    """The row events of a raw log, each with its transaction.

    ``log`` has row events and marker events (``kind`` gtid, begin, commit, xid, rollback) in the order of ``log_file,
    log_pos``; only a gtid event has a ``gtid``. Markers are carried to the row events behind them: ``gtid`` is the one opened
    last, NULL for an anonymous transaction, ``begin_file`` and ``begin_pos`` are where the transaction starts (its gtid event, else
    its BEGIN), and ``outcome`` is ``committed``, ``rolled back``, or ``open`` if the log or another
    transaction comes before its end. Rows outside a transaction have none of these. Log files go by their numbers; they
    are the segments of the carry unless another one is given.
    """
    log = log.withColumn("_log", log_number("log_file"))
    segment = F.col("_log") if segment is None else segment
    order, place = ["_log", "log_pos"], F.struct("_log", "log_pos", "log_file")
    kind = F.lower("kind")
    starts = (kind == "gtid") | (kind == OPENING)
    marked = with_last(
        log, keys, order,
        {
            "_gtid": F.when(kind == "gtid", F.struct(place.alias("at"), F.col("gtid").alias("gtid"))),
            "_begin": F.when(kind == OPENING, place),
            "_end": F.when(kind.isin(*ENDING), place),
        },
        segment,
    )
    # What comes next: an end, or another start before it.
    ahead = with_last(
        marked, keys, order,
        {"_next": F.when(starts | kind.isin(*ENDING), F.struct(place.alias("at"), kind.alias("kind")))}, segment, descending=True,
    )
    rows = ahead.filter(kind.isin("insert", "update", "delete"))

    def since_end(at: Column) -> Column:
        return at.isNotNull() & (F.col("_end").isNull() | (at > F.col("_end")))

    named, begun = since_end(F.col("_gtid.at")), since_end(F.col("_begin"))
    # A BEGIN that follows a gtid event is that transaction's; one before it is another's.
    first = F.when(named, F.col("_gtid.at")).when(begun, F.col("_begin"))
    outcome = F.when(F.col("_next.kind") == UNDONE, "rolled back").when(F.col("_next.kind").isin(*ENDING), "committed").otherwise("open")
    return rows.withColumns(
        {
            "gtid": F.when(named, F.col("_gtid.gtid")), "begin_file": first["log_file"], "begin_pos": first["log_pos"],
            "outcome": F.when(first.isNotNull(), outcome),
        }
    ).drop("_log", "_gtid", "_begin", "_end", "_next")


def transaction_span(log: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The row events from a gtid event up to the one with the next number of the same uuid, whatever stands in between.

    ``wanted`` has at most one ``gtid`` for each of ``keys``; without a next one the span ends with the log. The spans are found
    by equality among the gtid events and joined to the rows by key, of which they have one each.
    """
    place = F.struct(log_number("log_file"), "log_pos")
    numbers = log.filter(F.lower("kind") == "gtid").select(*keys, "gtid", place.alias("_at"))
    number = F.substring_index("gtid", ":", -1).cast("bigint") + 1
    following = F.concat_ws(":", F.substring_index("gtid", ":", 1), number.cast("string"))
    first = numbers.join(wanted.select(*keys, "gtid").distinct(), [*keys, "gtid"]).groupBy(*keys, "gtid").agg(F.min("_at").alias("_start"))
    after = numbers.withColumnRenamed("gtid", "_following").withColumnRenamed("_at", "_later")
    spans = (
        first.withColumn("_following", following).join(after, [*keys, "_following"], "left")
        .filter(F.col("_later").isNull() | (F.col("_later") > F.col("_start")))
        .groupBy(*keys, "_start").agg(F.min("_later").alias("_stop"))
    )
    inside = (place >= F.col("_start")) & (F.col("_stop").isNull() | (place < F.col("_stop")))
    rows = log.filter(F.lower("kind").isin("insert", "update", "delete"))
    return rows.join(spans, keys).filter(inside).drop("_start", "_stop")
