"""Following a change feed and writing undo statements for what arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.operators.change_data import filter_changes, undo_statements


def undo_available(
    feed: DataFrame, target: str, checkpoint: str, operation: str | None = None, tables: list[str] | None = None
) -> None:
    """Undo statements of all changes since the checkpoint, then stop.

    The next run continues where this one ended. The checkpoint moves past every change that is
    read, so no time bound is taken here: what arrives early for one slice is kept for the
    next, and ``undo_slice`` takes the times. Nothing needs state; the file sink commits each batch once.
    """
    (
        undo_statements(filter_changes(feed, operation=operation, tables=tables))
        .select("db", "tbl", "op", "event_time", "log_file", "log_pos", "sql", "rollback_sql", "replace_sql")
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def undo_slice(
    spark: SparkSession, target: str, start: str | None = None, end: str | None = None,
    operation: str | None = None, tables: list[str] | None = None,
) -> DataFrame:
    """The kept statements of the changes between two inclusive times; the range reaches the scan."""
    return filter_changes(spark.read.parquet(target), start, end, operation, tables)
