"""Age-based retention, incremental copies, idle keys, list trimming, generations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.ordered import numbered
from tidewright.functions.text import epoch_seconds


def age_days(mtime: Column, now: Column) -> Column:
    """Whole days since a file was modified."""
    return F.floor((epoch_seconds(now) - epoch_seconds(mtime)) / 86400)


def younger_than(mtime: Column, days: int, now: Column) -> Column:
    """``age_days < days`` as a range on the column itself, which a scan can prune on."""
    return mtime >= F.timestamp_add("SECOND", F.lit(1 - days * 86400), now)


def older_than(mtime: Column, days: int, now: Column) -> Column:
    """``age_days > days`` as a range on the column itself."""
    return mtime < F.timestamp_add("SECOND", F.lit(1 - (days + 1) * 86400), now)


def retention_plan(files: DataFrame, rules: list[tuple[str, str, int]], now: Column) -> DataFrame:
    """What happens to each file (``path, mtime``) under (directory, name prefix, days) rules.

    The shortest matching retention wins. A file past it is deleted unless it was modified
    on the first of a month, which is reported as skipped.
    """
    name = F.element_at(F.split("path", "/"), -1)
    limits = [
        F.when(F.startswith("path", F.lit(d.rstrip("/") + "/")) & F.startswith(name, F.lit(p)), n)
        for d, p, n in rules
    ]
    limit = F.array_min(F.array(*limits))
    past = F.coalesce(F.col("age_days") > limit, F.lit(False))
    first = F.dayofmonth("mtime") == 1
    return files.withColumn("age_days", age_days(F.col("mtime"), now)).select(
        "path", "age_days",
        F.when(past & first, "Skipped").when(past, "Deleted").otherwise("Kept").alias("action"),
    )


def expired_days(history: DataFrame, day: str, now: Column, keep_days: int = 30) -> DataFrame:
    """Rows of days past the limit; every such day goes, not one per run.

    The column is compared as it is, so day partitions or file statistics prune the scan.
    """
    limit = F.date_sub(now.cast("date"), keep_days)
    return history.filter(F.col(day) < limit.cast(history.schema[day].dataType))


def copy_plan(
    files: DataFrame, source_root: str, target_root: str, days: int, now: Column
) -> DataFrame:
    """Files modified within the days are copied to the same relative path."""
    root = source_root.rstrip("/") + "/"
    relative = F.substring("path", len(root) + 1, 2**31 - 1)
    fresh = younger_than(F.col("mtime"), days, now)
    inside = F.startswith("path", F.lit(root))
    return files.filter(inside & fresh).select(
        "path", F.concat(F.lit(target_root.rstrip("/") + "/"), relative).alias("target")
    )


def target_cleanup(files: DataFrame, days: int, now: Column) -> DataFrame:
    """Files of the target older than the days."""
    return files.filter(older_than(F.col("mtime"), days, now)).select("path")


def relative_path(path: Column, root: str) -> Column:
    """The path below a root, NULL for one elsewhere; a scheme and host in front of either do not matter."""
    scheme = r"^[A-Za-z][\w+.\-]*:(?://[^/]*)?"
    bare, top = F.regexp_replace(path, scheme, ""), re.sub(scheme, "", root).rstrip("/") + "/"
    return F.when(F.startswith(bare, F.lit(top)), F.substring(bare, len(top) + 1, 2**31 - 1))


def sync_plan(source: DataFrame, target: DataFrame, source_root: str, target_root: str, days: int, now: Column) -> DataFrame:
    """What makes a target folder follow a source folder, one row per relative path of either listing (``path, mtime, length``).

    A source file modified within the days is copied if the target lacks it, has another length or an older
    time; a target file older than the days is deleted; else a file of the target is kept and one of the source alone is skipped.
    """
    def side(files: DataFrame, root: str, prefix: str) -> DataFrame:
        rows = files.withColumn("relative", relative_path(F.col("path"), root)).filter(F.col("relative").isNotNull())
        return rows.select("relative", F.col("mtime").alias(f"{prefix}_mtime"), F.col("length").alias(f"{prefix}_length"))

    both = side(source, source_root, "source").join(side(target, target_root, "target"), "relative", "full")
    there = F.col("target_mtime").isNotNull()
    same = there & (F.col("target_length") == F.col("source_length")) & (F.col("target_mtime") >= F.col("source_mtime"))
    fresh = F.coalesce(younger_than(F.col("source_mtime"), days, now), F.lit(False))
    action = (
        F.when(fresh & ~same, "copy").when(there & older_than(F.col("target_mtime"), days, now), "delete")
        .when(there, "keep").otherwise("skip")
    )
    return both.select(
        "relative", action.alias("action"), F.when(action == "copy", F.col("source_length")).alias("bytes"),
        F.when(action == "copy", F.concat(F.lit(target_root.rstrip("/") + "/"), "relative")).alias("target"),
    )


def idle_keys(keys: DataFrame, idle_sec: int = 259_200) -> DataFrame:
    """Keys idle for longer than the limit that would never expire by themselves."""
    return keys.filter((F.col("idle_sec") > idle_sec) & (F.col("ttl_sec") == -1))


def trim_rounds(
    elements: DataFrame, list_col: str, order: str, segment: Column, batch: int = 200
) -> DataFrame:
    """The round in which each list element is trimmed from the head, and how.

    The last round deletes the whole list once fewer than ``batch`` elements remain.
    """
    placed = numbered(elements, [list_col], [order], segment, "rn", total="total")
    step = F.floor((F.col("rn") - 1) / batch)
    left = F.col("total") - step * batch
    return placed.select(
        list_col, order, (step + 1).alias("round"),
        F.when(left < batch, "delete").otherwise("trim").alias("how"),
    )


def next_generation(names: DataFrame, group: str, name: str, start: int = 1) -> DataFrame:
    """The greatest numeric suffix plus one per group, or a start value."""
    suffix = F.regexp_extract(name, r"_(\d+)$", 1).try_cast("bigint")
    return names.groupBy(group).agg(F.coalesce(F.max(suffix) + 1, F.lit(start)).alias("next_no"))


def by_pattern(files: DataFrame, patterns: list[str], day: Column) -> DataFrame:
    """Files (``path``) with each ``pattern`` their name matches: ``*`` any text, ``?`` one character,
    ``<day>`` the day as yyyyMMdd. The few patterns are tested inside the row."""
    name = F.substring_index("path", "/", -1)
    stamp = F.date_format(day, "yyyyMMdd")
    tests = []
    for pattern in patterns:
        shape = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern).replace(re.escape("<day>"), "<day>")
        fits = F.regexp_like(name, F.concat(F.lit("^"), F.replace(F.lit(shape), F.lit("<day>"), stamp), F.lit("$")))
        tests.append(F.when(fits, F.lit(pattern)))
    return files.withColumn("pattern", F.explode(F.array_compact(F.array(*tests))))


def completeness(expected: DataFrame, files: DataFrame, day: Column) -> DataFrame:
    """How many files of a day match each expected pattern; none is an error."""
    mtime = F.col("mtime")
    of_day = (mtime >= day.cast("timestamp_ntz")) & (mtime < F.date_add(day, 1).cast("timestamp_ntz"))
    counts = files.filter(of_day).groupBy("pattern").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return expected.join(counts, "pattern", "left").select(
        "pattern", n.alias("n"), F.when(n == 0, "error").otherwise("ok").alias("state")
    )
