"""Writing results: appends, dated appends, batch replacement, scripts, exports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException, ArithmeticException, DateTimeException, IllegalArgumentException, NumberFormatException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


WRONG_QUERY = (AnalysisException, ArithmeticException, DateTimeException, IllegalArgumentException, NumberFormatException)


def append_table(df: DataFrame, name: str) -> None:
    """Create the table if absent, then append."""
    df.write.mode("append").saveAsTable(name)


def append_dated(df: DataFrame, path: str, now: Column) -> None:
    """Append a dump under its kind and day (``df`` has a ``kind`` column)."""
    dated = df.withColumn("dump_date", now.cast("date"))
    dated.write.mode("append").partitionBy("kind", "dump_date").parquet(path)


def replace_batch(df: DataFrame, path: str, batch_col: str = "batchno") -> None:
    """Replace only the batches present in ``df``; a re-run of a batch changes nothing else."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(batch_col).parquet(path)
    )


def write_script(blocks: DataFrame, path: str) -> None:
    """Numbered text blocks, one folder per table, in order across the files of a folder.

    A range sort keeps the order without pulling a script into one task.
    """
    (
        blocks.repartitionByRange("db", "tbl", "seq")
        .sortWithinPartitions("db", "tbl", "seq")
        .select("db", "tbl", "block")
        .write.partitionBy("db", "tbl").text(path)
    )


def export_queries(
    spark: SparkSession, workbooks: dict[str, Iterable[tuple[str, str]]], path: str,
    **tables: DataFrame,
) -> DataFrame:
    """Run named queries, one output folder per title, and report each.

    Queries name the given tables in braces, or anything in the session catalog.

    An empty result is reported and skipped; a query that is wrong ends its own workbook only and is
    reported with its message. What fails for other reasons, as a lost cluster, is raised. Rows are
    counted while they are written.
    """
    report = []
    for workbook, specs in workbooks.items():
        for title, sql in specs:
            seen = Observation()
            try:
                rows = spark.sql(sql, **tables).observe(seen, F.count(F.lit(1)).alias("n"))
                rows.write.mode("overwrite").parquet(f"{path}/{workbook}/{title}")
                n = seen.get["n"]
                report.append((workbook, title, "done" if n else "empty", n, None))
            except WRONG_QUERY as wrong:
                report.append((workbook, title, "failed", 0, str(wrong)))
                break
    return spark.createDataFrame(report, "workbook string, title string, status string, rows bigint, message string")
