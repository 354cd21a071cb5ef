"""Whether what was written can be read back in time, worked out from streams of what happened.

A probe writes a heartbeat, expects an answer within ``ANSWER``, waits, and reads the row back. Sent heartbeats,
answers and readings arrive as streams of their own, in any order and some never. Each pair is a stream-stream outer
join with a bound on event time: a heartbeat is held until its echo comes or the watermark passes its deadline, and is then
written once, with or without the echo. No outcome is taken from a clock of this job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Seconds: for an answer to the write; from sending to the reading, of which five are the wait before it is asked for.
ANSWER, READING = 5, 15
LATENESS = "1 minute"

LOADED = "answer_ts timestamp, http int, load_status string"
READ = "read_ts timestamp, value timestamp, read_error string"


def matched(sent: DataFrame, echoes: DataFrame, echo_ts: str, seconds: int, lateness: str = LATENESS) -> DataFrame:
    """Each heartbeat (``probe, sent_ts``) with the echoes of its probe within ``seconds`` of it, or none after that time.

    A heartbeat's state goes once the watermark, ``lateness`` behind the slower of the two streams, has passed its deadline;
    an echo that is later than this counts as none. Several echoes give several rows.
    """
    asked = sent.withWatermark("sent_ts", lateness).alias("s")
    heard = echoes.withColumnRenamed("probe", "_probe").withWatermark(echo_ts, lateness).alias("e")
    in_time = F.expr(f"_probe = probe AND {echo_ts} >= sent_ts AND {echo_ts} <= sent_ts + INTERVAL {seconds} SECONDS")
    return asked.join(heard, in_time, "left_outer").drop("_probe")


def follow(sent: DataFrame, answers: DataFrame, readings: DataFrame, target: str, checkpoint: str, lateness: str = LATENESS) -> None:
    """Match what is available since the checkpoint, then stop; the next run goes on with the heartbeats still held.

    Two file sinks: ``loads`` has heartbeats with their answers, ``reads`` with their readings.
    """
    pairs = {
        "loads": matched(sent, answers, "answer_ts", ANSWER, lateness),
        "reads": matched(sent, readings, "read_ts", READING, lateness),
    }
    running = [
        rows.writeStream.format("parquet").option("path", f"{target}/{name}")
        .option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
        for name, rows in pairs.items()
    ]
    for query in running:
        query.awaitTermination()


def probe_code() -> Column:
    """The code of a probe's first answer and first reading.

    Fixed values: 1 read back, 2 no answer in time, 3 refused, 4 not loaded or stale, 5 no reading in time, 6 reading failed.
    """
    return (
        F.when(F.col("answer_ts").isNull(), 2)
        .when(F.coalesce("http", F.lit(0)) != 200, 3)
        .when(F.coalesce("load_status", F.lit("")) != "Success", 4)
        .when(F.col("read_ts").isNull(), 5)
        .when(F.col("read_error").isNotNull(), 6)
        .when(F.col("value") == F.col("sent_ts"), 1)
        .otherwise(4)
    )


def probe_status(spark: SparkSession, target: str) -> DataFrame:
    """``(probe, sent_ts, status_code)`` of every heartbeat that both sinks have settled."""

    def first(name: str, ts: str) -> DataFrame:
        rows = spark.read.parquet(f"{target}/{name}")
        echo = F.struct(*[c for c in rows.columns if c not in ("probe", "sent_ts")])
        return rows.groupBy("probe", "sent_ts").agg(F.min_by(echo, F.col(ts)).alias("e")).select("probe", "sent_ts", "e.*")

    both = first("loads", "answer_ts").join(first("reads", "read_ts"), ["probe", "sent_ts"])
    return both.select("probe", "sent_ts", probe_code().alias("status_code"))
