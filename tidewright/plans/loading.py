"""Queries over CSV loads, exports and snapshots, with their check SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from tidewright.functions.ordered import SEGMENT_ROWS
from tidewright.operators import snapshots as sn
from tidewright.plans.tables import Query, table
from tidewright.session import scratch_path
from tidewright.sinks.tables import append_table, export_queries
from tidewright.sources import csv_load
from tidewright.sources.inventory import catalog_statistics

STAMP = "20240131020000"


def _order_text(spark, sf_dir):
    """Orders as the text columns of a CSV file sorted by day."""
    o = table(spark, sf_dir, "orders")
    late = F.col("o_orderdate") >= F.lit("2001-07-01").cast("timestamp_ntz")
    blank_cust = F.col("o_orderpriority") == "5-LOW"
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(blank_cust, "").otherwise(F.col("o_custkey").cast("string")).alias("cust"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"),
        F.date_format("o_orderdate", "yyyy-M-d").alias("odate"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("sort_day"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(late, "late").otherwise(F.date_format("o_orderdate", "yyyyMM")).alias("batch"),
    )


def _document_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source",
        F.concat(F.lit("-"), F.col("n_chars").cast("string")).alias("balance"),
    )


def csv_type_inference(spark, sf_dir):
    orders = csv_load.infer_types(_order_text(spark, sf_dir)).withColumn("table_name", F.lit("orders"))
    documents = csv_load.infer_types(_document_text(spark, sf_dir))
    return orders.unionByName(documents.withColumn("table_name", F.lit("documents")))


def csv_typed_load(spark, sf_dir):
    """The orders written as CSV files, read back and cast; the batch is declared a number."""
    path = scratch_path(spark, "csv")
    _order_text(spark, sf_dir).write.option("header", True).csv(path)
    rows = csv_load.read_strings(spark, path)
    types = csv_load.type_map(csv_load.infer_types(rows)) | {"batch": "BIGINT"}
    loaded = csv_load.load_typed(rows, types)
    return loaded.select(
        "id", "cust", F.col("price").cast("double").alias("price"), "odate", "status", "batch",
        F.col("_corrupt").alias("corrupt"), F.col("_misfits")["batch"].alias("batch_text"),
    )


def query_batch_export(spark, sf_dir):
    """Two workbooks: one with an empty result, one that a failing query ends."""
    workbooks = {
        "daily": [
            ("open_orders", "SELECT * FROM {orders} WHERE o_orderstatus = 'O'"),
            ("unknown_status", "SELECT * FROM {orders} WHERE o_orderstatus = 'X'"),
            ("segments", "SELECT c_mktsegment, count(*) AS n FROM {customer} GROUP BY c_mktsegment"),
        ],
        "broken": [
            ("suppliers", "SELECT * FROM {supplier}"),
            ("no_such_column", "SELECT missing FROM {supplier}"),
            ("never_run", "SELECT * FROM {supplier}"),
        ],
    }
    frames = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "supplier")}
    return export_queries(spark, workbooks, scratch_path(spark, "export"), **frames).drop("message")


def schema_snapshot_manifest(spark, sf_dir):
    """Documents as tables of their source; French ones are views, src0 is a system schema."""
    d = table(spark, sf_dir, "documents")
    tables = d.select(
        F.when(F.col("source") == "src0", "sys").otherwise(F.col("source")).alias("table_schema"),
        F.concat(F.lit("t_"), F.col("doc_id").cast("string")).alias("table_name"),
        F.when(F.col("lang") == "fr", "VIEW").otherwise("BASE TABLE").alias("table_type"),
        "doc_id",
    )
    return sn.snapshot_manifest(
        tables, STAMP, "doc_id", F.floor(F.col("doc_id") / SEGMENT_ROWS), per_list=25
    )


def _snapshots(spark, sf_dir):
    """Orders as snapshot names; some are named wrongly, some failed."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")

    def two(n):
        return F.lpad((key % n).cast("string"), 2, "0")

    database = F.when(
        (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"), "sys"
    ).otherwise(F.concat_ws("_", F.lit("db"), F.lower("o_orderstatus"), F.substring("o_orderpriority", 1, 1)))
    month = F.when(key % 13 == 0, "13").otherwise(F.date_format("o_orderdate", "MM"))
    stamp = F.concat(F.date_format("o_orderdate", "yyyy"), month, F.date_format("o_orderdate", "dd"),
                     two(24), two(60), two(60))
    tail = F.when(F.col("o_custkey") % 11 == 0, "latest").otherwise(F.concat(stamp, F.lit("_backup")))
    return o.select(
        key.alias("ordinal"), F.concat_ws("_", database, tail).alias("snapshot"),
        F.when(F.col("o_custkey") % 7 == 0, "FAILED").otherwise("OK").alias("status"),
    )


def latest_snapshot_plan(spark, sf_dir):
    return sn.latest_snapshots(_snapshots(spark, sf_dir), "ordinal")


def snapshot_round_trip(spark, sf_dir):
    """Three exports of five tables in lists of two: one whole, a newer one that breaks off in its last list, and
    a whole one of another schema. The latest whole ones are restored and summed up."""
    work = scratch_path(spark, "snapshots")
    shop = [("shop", name) for name in ("nation", "customer", "orders", "supplier", "region")]

    def read(schema, name):
        rows = table(spark, sf_dir, name)
        return rows.filter(F.col(rows.columns[0]) % 3 != 0) if schema == "parts" else rows

    def broken(schema, name):
        rows = table(spark, sf_dir, name)
        return rows.select(F.raise_error(F.lit("gone")).alias("x")) if name == "region" else rows.limit(1)

    sn.export_snapshot(spark, shop, f"{work}/repo", "20240101000000", 2, read=read)
    sn.export_snapshot(spark, shop, f"{work}/repo", "20240201000000", 2, read=broken)
    sn.export_snapshot(spark, [("parts", "part"), ("parts", "supplier")], f"{work}/repo", "20240301000000", read=read)
    latest = sn.latest_snapshots(sn.list_snapshots(spark, f"{work}/repo"), "ordinal")

    def write(schema, name, rows):
        rows.write.mode("overwrite").parquet(f"{work}/back/{schema}/{name}")

    done = sn.restore_snapshots(spark, f"{work}/repo", latest, write).collect()
    parts = []
    for row in done:
        back = spark.read.parquet(f"{work}/back/{row.table_schema}/{row.table_name}")
        sums = back.agg(F.count("*").alias("n"), F.sum(F.col(back.columns[0])).cast("long").alias("keys"))
        parts.append(sums.select(*[F.lit(v).alias(c) for c, v in (("db", row.table_schema), ("snapshot", row.label), ("table_name", row.table_name), ("status", row.status))], "n", "keys"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _new_schema(spark) -> str:
    """A schema of its own, with its tables in the shared folder."""
    name = f"tidewright_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_path(spark, 'schema')}'")
    return name


def append_in_batches(spark, sf_dir):
    """Orders appended to a catalog table by status: the first batch creates it, later ones add to it."""
    name = f"{_new_schema(spark)}.orders"
    orders = table(spark, sf_dir, "orders")
    for status in ("O", "F", "P"):
        append_table(orders.filter(F.col("o_orderstatus") == status).select("o_orderkey", "o_orderstatus", "o_orderpriority"), name)
    return spark.table(name)


def catalog_sizes(spark, sf_dir):
    """Tables of a schema, one of them partitioned, one a view, and their rows as the catalog knows them."""
    schema = _new_schema(spark)
    for name in ("nation", "customer", "orders", "lineitem"):
        writer = table(spark, sf_dir, name).write
        (writer.partitionBy("o_orderstatus") if name == "orders" else writer).saveAsTable(f"{schema}.{name}")
        spark.sql(f"ANALYZE TABLE {schema}.{name} COMPUTE STATISTICS")
    spark.sql(f"CREATE VIEW {schema}.buyers AS SELECT c_custkey FROM {schema}.customer")
    return catalog_statistics(spark, schema).select(
        "table_name", "table_type", "provider", "is_partitioned", "partition_columns", (F.col("size_bytes") > 0).alias("sized"), "num_rows"
    )


def invalid_snapshot_names(spark, sf_dir):
    return sn.invalid_names(_snapshots(spark, sf_dir)).select("ordinal", "snapshot")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        csv_type_inference, csv_typed_load, query_batch_export, schema_snapshot_manifest,
        latest_snapshot_plan, invalid_snapshot_names, snapshot_round_trip, append_in_batches, catalog_sizes,
    )
}


def _vote(col: str) -> str:
    decimal = csv_load.DECIMAL.replace("(?i)", "")
    return f"""CASE
      WHEN coalesce(bool_and(trim({col}) = '' OR regexp_matches(trim({col}), '{csv_load.DIGITS}')), true) THEN 'BIGINT'
      WHEN coalesce(bool_and(trim({col}) = '' OR regexp_matches(trim({col}), '{decimal}', 'i')), true) THEN 'DECIMAL(36,6)'
      WHEN coalesce(bool_and(trim({col}) = '' OR try_strptime(trim({col}), '%Y-%m-%d') IS NOT NULL), true) THEN 'DATE'
      WHEN coalesce(max(length({col})) FILTER (trim({col}) <> ''), 0) <= 255 THEN 'VARCHAR(255)' ELSE 'TEXT' END"""


def _votes(name: str, columns: list[str]) -> str:
    return "\n UNION ALL ".join(
        f"SELECT '{name}' AS table_name, {i + 1} AS ordinal, '{c}' AS \"column\", {_vote(c)} AS type FROM {name}_s"
        for i, c in enumerate(columns)
    )


_ORDER_TEXT = """
orders_t AS (SELECT CAST(o_orderkey AS VARCHAR) AS id,
    CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS cust,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price,
    strftime(o_orderdate, '%Y-%-m-%-d') AS odate, strftime(o_orderdate, '%Y-%m-%d') AS sort_day,
    CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS status,
    CASE WHEN o_orderdate >= TIMESTAMP '2001-07-01' THEN 'late' ELSE strftime(o_orderdate, '%Y%m') END AS batch
  FROM orders)"""

_SNAP = """
s AS (SELECT o_orderkey AS ordinal,
    CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'sys'
      ELSE 'db_' || lower(o_orderstatus) || '_' || substr(o_orderpriority, 1, 1) END AS db,
    strftime(o_orderdate, '%Y') || CASE WHEN o_orderkey % 13 = 0 THEN '13' ELSE strftime(o_orderdate, '%m') END
      || strftime(o_orderdate, '%d') || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0')
      || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS stamp,
    o_custkey % 11 = 0 AS latest, o_custkey % 7 <> 0 AS ok FROM orders),
n AS (SELECT *, db || '_' || CASE WHEN latest THEN 'latest' ELSE stamp || '_backup' END AS snapshot,
    CASE WHEN NOT latest THEN try_strptime(stamp, '%Y%m%d%H%M%S') END AS taken_at FROM s)"""

ORACLES: dict[str, str] = {
    "csv_type_inference": f"""WITH {_ORDER_TEXT},
      orders_s AS (SELECT * FROM orders_t),
      documents_s AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source,
          '-' || CAST(n_chars AS VARCHAR) AS balance FROM documents)
      {_votes('orders', ['id', 'cust', 'price', 'odate', 'sort_day', 'status', 'batch'])}
      UNION ALL {_votes('documents', ['doc_id', 'text', 'lang', 'source', 'balance'])}""",
    "csv_typed_load": f"""WITH {_ORDER_TEXT}
      SELECT CAST(id AS BIGINT) AS id, TRY_CAST(nullif(cust, '') AS BIGINT) AS cust,
        CAST(CAST(price AS DECIMAL(36,6)) AS DOUBLE) AS price, CAST(sort_day AS DATE) AS odate, status,
        TRY_CAST(batch AS BIGINT) AS batch, batch = 'late' AS corrupt, CASE WHEN batch = 'late' THEN batch END AS batch_text
      FROM orders_t""",
    "query_batch_export": """
      SELECT 'daily' AS workbook, 'open_orders' AS title, 'done' AS status, count(*) AS "rows"
        FROM orders WHERE o_orderstatus = 'O'
      UNION ALL SELECT 'daily', 'unknown_status', 'empty', 0
      UNION ALL SELECT 'daily', 'segments', 'done', count(DISTINCT c_mktsegment) FROM customer
      UNION ALL SELECT 'broken', 'suppliers', 'done', count(*) FROM supplier
      UNION ALL SELECT 'broken', 'no_such_column', 'failed', 0""",
    "schema_snapshot_manifest": f"""
      WITH b AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
        FROM documents WHERE source <> 'src0' AND lang <> 'fr')
      SELECT source AS table_schema, CAST((rn - 1) // 25 + 1 AS INT) AS list_no, count(*) AS n_tables,
        string_agg('`t_' || CAST(doc_id AS VARCHAR) || '`', ', ' ORDER BY rn) AS tables,
        source || '_{STAMP}_backup' || CASE WHEN (rn - 1) // 25 > 0 THEN '_' || CAST((rn - 1) // 25 + 1 AS VARCHAR) ELSE '' END AS label
      FROM b GROUP BY source, (rn - 1) // 25""",
    "latest_snapshot_plan": f"""WITH {_SNAP},
      r AS (SELECT *, row_number() OVER (PARTITION BY db ORDER BY taken_at DESC, ordinal) AS rn FROM n
        WHERE ok AND taken_at IS NOT NULL AND db <> 'sys')
      SELECT db, snapshot, taken_at FROM r WHERE rn = 1""",
    "snapshot_round_trip": " UNION ALL ".join(
        f"""SELECT '{db}' AS db, '{db}_{stamp}_backup{list_no}' AS snapshot, '{name}' AS table_name, 'done' AS status,
          count(*) AS n, CAST(coalesce(sum({key}), 0) AS BIGINT) AS keys FROM {name} WHERE {kept}"""
        for db, stamp, list_no, name, key, kept in (
            ("shop", "20240101000000", "", "nation", "n_nationkey", "true"), ("shop", "20240101000000", "", "customer", "c_custkey", "true"),
            ("shop", "20240101000000", "_2", "orders", "o_orderkey", "true"), ("shop", "20240101000000", "_2", "supplier", "s_suppkey", "true"),
            ("shop", "20240101000000", "_3", "region", "r_regionkey", "true"), ("parts", "20240301000000", "", "part", "p_partkey", "p_partkey % 3 <> 0"),
            ("parts", "20240301000000", "", "supplier", "s_suppkey", "s_suppkey % 3 <> 0"),
        )
    ),
    "invalid_snapshot_names": f"WITH {_SNAP} SELECT ordinal, snapshot FROM n WHERE ok AND taken_at IS NULL",
    "append_in_batches": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'F', 'P')",
    "catalog_sizes": " UNION ALL ".join(
        f"""SELECT '{name}' AS table_name, 'MANAGED' AS table_type, 'parquet' AS provider, {part is not None} AS is_partitioned,
          {f"'{part}'" if part else 'NULL'} AS partition_columns, true AS sized, count(*) AS num_rows FROM {name}"""
        for name, part in (("nation", None), ("customer", None), ("orders", "o_orderstatus"), ("lineitem", None))
    )
    + " UNION ALL SELECT 'buyers', 'VIEW', NULL, false, NULL, NULL, NULL",
}
