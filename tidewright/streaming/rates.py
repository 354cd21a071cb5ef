"""Counter rates over a stream of samples.

The last sample per (instance, item) lives in a key-bucketed table. A batch reads the buckets its counters are in, as of the
batch before, and rewrites only these; a replayed batch reads the same state and overwrites what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.ordered import latest_per_key
from tidewright.operators.monitoring import counter_rates
from tidewright.streaming.bucketed import BucketedTable

KEYS = ["instance", "item"]


def last_samples(spark: SparkSession, state: str, buckets: int = 64) -> BucketedTable:
    """The state of a run: the last sample of each counter."""
    return BucketedTable(spark, state, KEYS, ["ts"], buckets)


def rates_available(samples: DataFrame, target: str, state: str, checkpoint: str, buckets: int = 64) -> None:
    """Rates for all samples available since the checkpoint, then stop.

    The first sample of a counter gives no rate; a sample not newer than the stored one
    is out of order and ignored. ``buckets`` stays the same for the life of a state.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        stored = last_samples(batch.sparkSession, state, buckets)
        # The batch and the state beside it are read for the rates and for the new state.
        rows = batch.select(*KEYS, "ts", "value", "uptime").persist()
        before = stored.near(rows, batch_id)
        if before is not None:
            before = before.drop("op").join(rows.select(*KEYS).distinct(), KEYS, "left_semi").persist()
        try:
            new = rows.withColumn("_old", F.lit(False))
            if before is not None:
                seen = before.select(*KEYS, F.col("ts").alias("_seen"))
                newer = F.col("_seen").isNull() | (F.col("ts") > F.col("_seen"))
                new = new.join(seen, KEYS, "left").filter(newer).drop("_seen").unionByName(before.withColumn("_old", F.lit(True)))
            rates = counter_rates(new, extra=["_old"]).filter(~F.col("_old")).drop("_old")
            rates.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
            stored.take(latest_per_key(rows, KEYS, ["ts"]).withColumn("op", F.lit("update")), batch_id)
        finally:
            for kept in (rows, before):
                if kept is not None:
                    kept.unpersist()

    (
        samples.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
