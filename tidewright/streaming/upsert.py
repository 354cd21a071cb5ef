"""Keeping a primary-key table current from a change stream.

Every micro-batch is reduced to its last change per key and written to a folder named
after the batch, so a replayed batch overwrites itself. Reading takes the last change
over all batches; ``compact`` folds them into one. Nothing rewrites the whole table per
batch, and order comes from log positions, not from arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewright.functions.ordered import latest_per_key


def start_upsert(
    changes: DataFrame, keys: list[str], order: list[str], target: str, checkpoint: str,
    etl_time: bool = False, interval: str | None = None,
) -> StreamingQuery:
    """Start ingesting: every ``interval`` (such as ``5 seconds``), or once over what is there.

    The size of a batch is the reader's (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        last = latest_per_key(batch, keys, order)
        if etl_time:
            last = last.withColumn("etl_time", F.localtimestamp())
        last.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    writer = changes.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (
        writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    ).start()


def upsert_available(
    changes: DataFrame, keys: list[str], order: list[str], target: str, checkpoint: str,
    etl_time: bool = False,
) -> None:
    """Ingest everything available since the checkpoint, then stop."""
    start_upsert(changes, keys, order, target, checkpoint, etl_time).awaitTermination()


def current_rows(spark: SparkSession, target: str, keys: list[str], order: list[str]) -> DataFrame:
    """The live rows: last change per key, deleted keys gone."""
    changes = spark.read.parquet(target).drop("batch_id")
    return latest_per_key(changes, keys, order).filter(F.col("op") != "delete")


def compact(spark: SparkSession, target: str, keys: list[str], order: list[str]) -> None:
    """Fold the batches that are there into one, in place; deletions are kept so that late changes still lose.

    The folded rows go to a new folder with the next negative number, then the folders they
    come from are removed. A failure in between leaves rows twice, which reading takes as once, and a
    running stream only adds folders. A read that began before the removal may have to be repeated.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [f.getPath() for f in files.listStatus(root) if f.getPath().getName().startswith("batch_id=")]
    numbers = [int(f.getName().removeprefix("batch_id=")) for f in folders]
    changes = spark.read.option("basePath", target).parquet(*[f.toString() for f in folders]).drop("batch_id")
    folded = latest_per_key(changes, keys, order)
    folded.write.mode("overwrite").parquet(f"{target}/batch_id={min([0, *numbers]) - 1}")
    for folder in folders:
        files.delete(folder, True)
