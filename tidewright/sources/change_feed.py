"""Change feeds from files, file streams and a Kafka topic of canal-json messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.once import settled

FEED_SCHEMA = (
    "db string, tbl string, op string, event_time bigint, log_file string, log_pos bigint, "
    "gtid string, before map<string,string>, after map<string,string>, types map<string,string>"
)

CANAL_SCHEMA = (
    "data array<map<string,string>>, old array<map<string,string>>, database string, "
    "`table` string, type string, es bigint, mysqlType map<string,string>, gtid string"
)


def read_feed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(FEED_SCHEMA).format(fmt).load(path)


def stream_feed(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """The same feed as a stream; the checkpoint remembers where the tail stopped."""
    reader = spark.readStream.schema(FEED_SCHEMA).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def kafka_options(servers: str, topic: str, start_ms: int | None = None) -> dict[str, str]:
    """Reader options: earliest offset, or the first offset at a time."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic}
    if start_ms is None:
        options["startingOffsets"] = "earliest"
    else:
        options["startingTimestamp"] = str(start_ms)
    return options


def stream_topic(spark: SparkSession, servers: str, topic: str, start_ms: int | None = None) -> DataFrame:
    """Needs Spark's Kafka package on the classpath."""
    raw = spark.readStream.format("kafka").options(**kafka_options(servers, topic, start_ms)).load()
    return canal_changes(
        raw.select(F.col("value").cast("string"), F.format_string("%08d", "partition").alias("log_file"),
                   F.col("offset").alias("log_pos"))
    )


def canal_changes(messages: DataFrame) -> DataFrame:
    """canal-json messages (``value, log_file, log_pos``) as feed rows.

    Messages that do not parse, and kinds other than row changes, are dropped. A message
    may carry several rows; ``row_no`` keeps their order. For an update ``old`` holds only
    the changed columns, so the before image is the row overlaid with them.
    """
    message = F.from_json("value", CANAL_SCHEMA, {"mode": "PERMISSIVE"})
    parsed = settled(messages.select("value", "log_file", "log_pos"), {"m": message})
    rows = parsed.filter(
        F.upper("m.type").isin("INSERT", "UPDATE", "DELETE") & F.col("m.data").isNotNull()
    ).select("log_file", "log_pos", "m", F.posexplode("m.data").alias("row_no", "row"))
    op = F.lower("m.type")
    changed = F.get("m.old", F.col("row_no"))
    overlaid = F.transform_values(
        "row", lambda k, v: F.when(F.map_contains_key(changed, k), F.element_at(changed, k)).otherwise(v)
    )
    return rows.select(
        F.col("m.database").alias("db"),
        F.col("m.table").alias("tbl"),
        op.alias("op"),
        F.floor(F.col("m.es") / 1000).alias("event_time"),
        "log_file",
        "log_pos",
        "row_no",
        F.col("m.gtid").alias("gtid"),
        F.when(op == "delete", F.col("row")).when(
            op == "update", F.when(changed.isNull(), F.col("row")).otherwise(overlaid)
        ).alias("before"),
        F.when(op != "delete", F.col("row")).alias("after"),
        F.col("m.mysqlType").alias("types"),
    )
