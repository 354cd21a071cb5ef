"""Status text, metric logs and job listings as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def key_value_rows(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``Key: value`` lines as rows; lines without a colon are dropped."""
    line = F.explode(F.split(text_col, r"\r?\n"))
    pattern = r"^\s*([^:\s]+)\s*:\s*(.*?)\s*$"
    return (
        texts.select(id_col, line.alias("line"))
        .filter(F.col("line").rlike(pattern))
        .select(
            id_col,
            F.regexp_extract("line", pattern, 1).alias("key"),
            F.regexp_extract("line", pattern, 2).alias("value"),
        )
    )


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """``name<TAB>value`` lines of a status snapshot; non-numbers are NULL."""
    rows = spark.read.schema("item string, value string").csv(path, sep="\t")
    return rows.withColumn("value", F.col("value").try_cast("double"))


def metric_rows(lines: DataFrame) -> DataFrame:
    """``ts | instance | item value`` lines (column ``value``) as metric samples."""
    parts = F.split("value", r"\s*\|\s*")
    pair = r"^\s*(\S+)\s+(\S+)\s*$"
    return (
        lines.filter(F.size(parts) == 3)
        .select(parts.alias("p"))
        .select(
            F.try_to_timestamp(F.trim(F.col("p")[0]), F.lit("yyyy-MM-dd HH:mm:ss"))
            .cast("timestamp_ntz").alias("ts"),
            F.trim(F.col("p")[1]).alias("instance"),
            F.regexp_extract(F.col("p")[2], pair, 1).alias("item"),
            F.regexp_extract(F.col("p")[2], pair, 2).try_cast("double").alias("value"),
        )
    )


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    return metric_rows(spark.read.text(path))


def read_dated_log(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The metric samples of a log kept in ``dump_date=…`` folders, of the days asked for; other folders are not read."""
    lines = spark.read.schema("value string, dump_date date").text(path)
    if first:
        lines = lines.filter(F.col("dump_date") >= F.lit(first).cast("date"))
    if last:
        lines = lines.filter(F.col("dump_date") <= F.lit(last).cast("date"))
    return metric_rows(lines)


# Fixed value: what stands before every record of vertical output, around its number.
RECORD_LINE = "*************************** "


def read_vertical(spark: SparkSession, path: str) -> DataFrame:
    """The records of vertical (``\\G``) output, whole: ``file, row_no, record``.

    The reader cuts the files at the line before a record, so a record is one row however many lines it has,
    and a long file still is many tasks.
    """
    parts = spark.read.option("lineSep", RECORD_LINE).text(path).select(F.input_file_name().alias("file"), "value")
    head = r"^(\d+)\. row \*+\s*\n"
    return parts.filter(F.col("value").rlike(head)).select(
        "file", F.regexp_extract("value", head, 1).cast("bigint").alias("row_no"), F.regexp_replace("value", head, "").alias("record")
    )


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot listing: name, timestamp text and status."""
    return spark.read.schema("snapshot string, ts string, status string").csv(path, header=True)
