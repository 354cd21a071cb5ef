"""CSV loading with types voted over the rows."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What counts as a decimal (any text a float parser takes) and as a date.
DIGITS = r"^[0-9]+$"
DECIMAL = r"(?i)^[+-]?(nan|inf|infinity|([0-9][0-9_]*\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"
DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"


def table_name(path: str) -> str:
    """A file's table: its name without folder and ending."""
    return os.path.splitext(os.path.basename(path))[0]


def read_strings(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns as text, blanks kept as empty text; the first row names the columns.

    Large files split over tasks; values that hold a newline need ``multi_line``, which makes each
    file one task.
    """
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    # The reader turns blanks into NULL; there is no other way to write a NULL in the file.
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns])


def _as_date(value: Column) -> Column:
    return F.when(value.rlike(DATE), F.try_to_timestamp(value, F.lit("yyyy-M-d")).cast("date"))


def _vote(name: str) -> Column:
    """The type of a column: the first rule all its non-blank values pass."""
    raw = F.col(f"`{name}`")
    value = F.trim(raw)
    blank = raw.isNull() | (value == "")

    def all_pass(test: Column) -> Column:
        return F.coalesce(F.bool_and(blank | test), F.lit(True))

    longest = F.coalesce(F.max(F.when(~blank, F.length(raw))), F.lit(0))
    return (
        F.when(all_pass(value.rlike(DIGITS)), "BIGINT")
        .when(all_pass(value.rlike(DECIMAL)), "DECIMAL(36,6)")
        .when(all_pass(_as_date(value).isNotNull()), "DATE")
        .when(longest <= 255, "VARCHAR(255)")
        .otherwise("TEXT")
    )


def infer_types(rows: DataFrame, sample: int | None = None) -> DataFrame:
    """One row per column: ``ordinal, column, type``, voted over all rows.

    The votes are plain aggregates. With ``sample`` only so many first rows of the file vote.
    """
    if sample is not None:
        rows = rows.sparkSession.createDataFrame(rows.take(sample), rows.schema)
    votes = rows.agg(
        F.array(
            *[
                F.struct(F.lit(i + 1).alias("ordinal"), F.lit(c).alias("column"), _vote(c).alias("type"))
                for i, c in enumerate(rows.columns)
            ]
        ).alias("votes")
    )
    return votes.select(F.inline("votes"))


def type_map(votes: DataFrame) -> dict[str, str]:
    """The votes on the driver: one short row per column."""
    return {r["column"]: r["type"] for r in votes.collect()}


def load_typed(rows: DataFrame, types: dict[str, str], strict: bool = False) -> DataFrame:
    """Cast every column to its voted type over the full scan.

    Blanks become NULL in typed columns and stay as they are in text. A value that does
    not fit is NULL and flags its row ``_corrupt``, and ``_misfits`` keeps its text by column; ``strict``
    fails the load instead.
    """
    columns, misfits = [], []
    for name in rows.columns:
        raw, kind = F.col(f"`{name}`"), types[name]
        if kind not in ("BIGINT", "DECIMAL(36,6)", "DATE"):
            columns.append(raw.alias(name))
            continue
        value = F.nullif(F.trim(raw), F.lit(""))
        cast = _as_date(value) if kind == "DATE" else value.try_cast(kind)
        columns.append(cast.alias(name))
        misfits.append(F.when(value.isNotNull() & cast.isNull(), F.struct(F.lit(name).alias("key"), raw.alias("value"))))
    kept = F.map_from_entries(F.array_compact(F.array(*misfits))) if misfits else F.create_map().cast("map<string,string>")
    corrupt = F.size(kept) > 0
    if strict:
        failed = F.raise_error(F.lit("a value does not fit its column type")).cast("boolean")
        corrupt = F.when(corrupt, failed).otherwise(F.lit(False))
    return rows.select(*columns, corrupt.alias("_corrupt"), kept.alias("_misfits"))
