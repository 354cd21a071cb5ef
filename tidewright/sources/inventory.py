"""Listings: files, keys, catalog tables, partitions, calendar days, JDBC queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Path, mtime and length of all files under a root; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select("path", "modificationTime", "length")
    )


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """An exported key listing with idle seconds and time to live."""
    return spark.read.schema("key string, idle_sec bigint, ttl_sec bigint").csv(path, header=True)


def catalog_tables(spark: SparkSession, schema: str) -> DataFrame:
    """Tables of a schema in the session catalog."""
    listed = spark.sql(f"SHOW TABLES IN {schema}")
    return listed.select(
        F.col("namespace").alias("table_schema"), F.col("tableName").alias("table_name")
    ).filter(F.col("table_schema") != "")


def catalog_statistics(spark: SparkSession, schema: str) -> DataFrame:
    """Kind, provider, partition columns and, after ANALYZE TABLE, size and rows of a schema's tables and views.

    The catalog is asked in one command; its descriptions are taken apart by expressions.
    """
    listed = spark.sql(f"SHOW TABLE EXTENDED IN {schema} LIKE '*'").filter("namespace <> ''")

    def fact(name: str, pattern: str = "(.*)") -> Column:
        found = F.regexp_extract("information", rf"(?m)^{name}: {pattern}$", 1)
        return F.when(found != "", found)

    def number(unit: str) -> Column:
        found = F.regexp_extract("information", rf"(?m)^Statistics: (?:.*, )?(\d+) {unit}", 1)
        return F.when(found != "", found.cast("long"))

    columns = F.translate(fact("Partition Columns", r"\[(.*)\]"), "` ", "")
    return listed.select(
        F.col("namespace").alias("table_schema"), F.col("tableName").alias("table_name"), fact("Type").alias("table_type"),
        fact("Provider").alias("provider"), columns.isNotNull().alias("is_partitioned"), columns.alias("partition_columns"),
        number("bytes").alias("size_bytes"), number("rows").alias("num_rows"),
    )


def jdbc_query(
    spark: SparkSession, url: str, query: str, partition_column: str | None = None,
    bounds: tuple[int, int] | None = None, partitions: int = 1, **options: str,
) -> DataFrame:
    """Rows of a query on another database; needs its driver on the classpath.

    With a partition column the read runs as parallel range queries.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q")
    if partition_column and bounds:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0]).option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return reader.options(**options).load()


def partition_listing(partitions: DataFrame, table: str | None = None) -> DataFrame:
    """Partition name and the first 50 characters of its high value, by upper-cased table."""
    rows = partitions
    if table is not None:
        rows = rows.filter(F.col("table_name") == table.upper())
    return rows.select(
        "table_name", "partition_name", F.substring("high_value", 1, 50).alias("partition_value")
    )


def calendar_days(spark: SparkSession, last: Column, back: int) -> DataFrame:
    """Every day from ``back`` days before ``last`` up to it."""
    days = F.explode(F.sequence(F.date_sub(last.cast("date"), back), last.cast("date")))
    return spark.range(1).select(days.alias("day"))
