"""Per-schema snapshots: what to export, and the latest one to restore."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.once import settled
from tidewright.functions.ordered import numbered
from tidewright.operators.maintenance import user_schemas

TABLES_PER_LIST = 1000


def snapshot_manifest(
    tables: DataFrame, stamp: str, order: str, segment: Column, per_list: int = TABLES_PER_LIST
) -> DataFrame:
    """Base tables of every user schema under its label, as ordered quoted lists.

    ``tables`` has ``table_schema, table_name, table_type``. Lists are cut to a bounded
    length and numbered, so a schema with very many tables never meets in one row; each list
    has a label of its own. A schema without base tables has no list.
    """
    base = user_schemas(tables.filter(F.col("table_type") == "BASE TABLE"), "table_schema")
    placed = numbered(base, ["table_schema"], [order], segment, "rn")
    number = F.when(F.col("list_no") > 1, F.concat(F.lit("_"), F.col("list_no").cast("string"))).otherwise("")
    label = F.concat(F.col("table_schema"), F.lit(f"_{stamp}_backup"), number)
    quoted = F.concat(F.lit("`"), "table_name", F.lit("`"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("rn", quoted.alias("name")))), lambda s: s["name"])
    return (
        placed.withColumn("list_no", (F.floor((F.col("rn") - 1) / per_list) + 1).cast("int"))
        .groupBy("table_schema", "list_no")
        .agg(F.count("*").alias("n_tables"), F.array_join(names, ", ").alias("tables"))
        .withColumn("label", label)
    )


MANIFEST = (
    "label string, table_schema string, stamp string, list_no int, n_lists int, table_name string, "
    "n_rows bigint, n_files bigint, n_bytes bigint"
)
REPORT = "table_schema string, label string, table_name string, status string, n_rows bigint, message string"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _files_of(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number and bytes of the data files directly in a folder; none if it is not there."""
    files, place = _folder(spark, path)
    found = [f for f in files.listStatus(place) if f.isFile() and not f.getPath().getName().startswith(("_", "."))] if files.exists(place) else []
    return len(found), sum(f.getLen() for f in found)


def export_snapshot(
    spark: SparkSession, tables: list[tuple[str, str]], repo: str, stamp: str, per_list: int = TABLES_PER_LIST, at_once: int = 4,
    read: Callable[[str, str], DataFrame] | None = None,
) -> DataFrame:
    """Write the listed tables (schema, name) under ``repo/label/table``, and report each.

    A schema's tables go in lists of ``per_list``, each with the label that ``snapshot_manifest`` gives it. ``at_once`` tables are
    written side by side, their rows counted on the way. A list's manifest, with rows, files and bytes of each table, is written
    last and only if all its tables are there: it is the mark of a finished list, and a list that is exported
    again loses its old mark first. A table that cannot be read or written is reported and leaves its list without one.
    """
    read = read or (lambda schema, name: spark.table(f"{schema}.{name}"))
    lists: dict[tuple[str, int], list[str]] = {}
    for schema in dict.fromkeys(schema for schema, _ in tables):
        names = [name for own, name in tables if own == schema]
        for at in range(0, len(names), per_list):
            lists[schema, at // per_list + 1] = names[at : at + per_list]
    n_lists = {schema: max(number for own, number in lists if own == schema) for schema, _ in lists}

    def label_of(schema: str, number: int) -> str:
        return f"{schema}_{stamp}_backup" + (f"_{number}" if number > 1 else "")

    def write(job: tuple[str, int, str]) -> tuple:
        schema, number, name = job
        label, seen = label_of(schema, number), Observation()
        path = f"{repo}/{label}/{name}"
        try:
            read(schema, name).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
        except (PySparkException, Py4JJavaError) as failure:
            return job, (schema, label, name, "failed", None, str(failure)), None
        n = seen.get["n"]
        return job, (schema, label, name, "done", n, None), (label, schema, stamp, number, n_lists[schema], name, n, *_files_of(spark, path))

    for schema, number in lists:
        files, mark = _folder(spark, f"{repo}/{label_of(schema, number)}/_manifest")
        files.delete(mark, True)
    jobs = [(schema, number, name) for (schema, number), names in lists.items() for name in names]
    with ThreadPoolExecutor(at_once) as pool:
        written = list(pool.map(write, jobs))
    for (schema, number), names in lists.items():
        whole = [facts for job, _, facts in written if job[:2] == (schema, number) and facts]
        if len(whole) == len(names):
            spark.createDataFrame(whole, MANIFEST).coalesce(1).write.parquet(f"{repo}/{label_of(schema, number)}/_manifest")
    return spark.createDataFrame([report for _, report, _ in written], REPORT)


def _manifests(spark: SparkSession, repo: str) -> tuple[list[str], DataFrame]:
    """All labels of a repository, and the manifests of the finished ones."""
    files, root = _folder(spark, repo)
    labels = sorted(f.getPath().getName() for f in files.listStatus(root) if f.isDirectory()) if files.exists(root) else []
    marked = [f"{repo}/{label}/_manifest" for label in labels if files.exists(_folder(spark, f"{repo}/{label}/_manifest/_SUCCESS")[1])]
    rows = spark.read.schema(MANIFEST).parquet(*marked) if marked else spark.createDataFrame([], MANIFEST)
    return labels, rows


def list_snapshots(spark: SparkSession, repo: str) -> DataFrame:
    """``(ordinal, snapshot, status)`` of a repository, as ``latest_snapshots`` takes them.

    ``OK`` is a label whose list and all other lists of the same schema and time are finished, anything else ``INCOMPLETE``.
    """
    labels, rows = _manifests(spark, repo)
    whole = rows.groupBy("table_schema", "stamp").agg((F.countDistinct("list_no") == F.max("n_lists")).alias("_whole"))
    done = rows.join(whole, ["table_schema", "stamp"]).filter("_whole").select(F.col("label").alias("snapshot")).distinct()
    listed = spark.createDataFrame(list(enumerate(labels)), "ordinal int, snapshot string")
    known = done.withColumn("_done", F.lit(True))
    status = F.when(F.col("_done"), "OK").otherwise("INCOMPLETE")
    return listed.join(known, "snapshot", "left").select("ordinal", "snapshot", status.alias("status"))


def read_snapshot(spark: SparkSession, repo: str, label: str, name: str) -> DataFrame:
    """A table of a finished list; refused without its mark, or if files of the table are missing or altered."""
    mark = f"{repo}/{label}/_manifest"
    if not _folder(spark, mark)[0].exists(_folder(spark, f"{mark}/_SUCCESS")[1]):
        raise ValueError(f"{label} is not finished")
    facts = spark.read.schema(MANIFEST).parquet(mark).filter(F.col("table_name") == name).first()
    if facts is None:
        raise ValueError(f"{label} has no table {name}")
    if _files_of(spark, f"{repo}/{label}/{name}") != (facts.n_files, facts.n_bytes):
        raise ValueError(f"files of {name} in {label} are not those of its export")
    return spark.read.parquet(f"{repo}/{label}/{name}")


def restore_snapshots(
    spark: SparkSession, repo: str, latest: DataFrame, write: Callable[[str, str, DataFrame], None], at_once: int = 4, attempts: int = 3
) -> DataFrame:
    """Hand every table of the chosen snapshots (``snapshot``) to ``write(schema, name, rows)``, and report each.

    All lists are checked before the first table is written. A table's rows are counted against the manifest while they are
    written; a failure is tried again up to ``attempts`` times and then reported. ``write`` replaces what a former attempt left.
    """
    labels = [r.snapshot for r in latest.select("snapshot").distinct().collect()]
    _, rows = _manifests(spark, repo)
    tables = rows.filter(F.col("label").isin(labels)).collect()
    for label in set(labels) - {t.label for t in tables}:
        raise ValueError(f"{label} is not finished")
    ready = [(t, read_snapshot(spark, repo, t.label, t.table_name)) for t in tables]

    def restore(job) -> tuple:
        table, stored = job
        for attempt in range(1, attempts + 1):
            seen = Observation()
            try:
                write(table.table_schema, table.table_name, stored.observe(seen, F.count(F.lit(1)).alias("n")))
            except (PySparkException, Py4JJavaError) as failure:
                message = str(failure)
                continue
            n = seen.get["n"]
            status = "done" if n == table.n_rows else "failed"
            return table.table_schema, table.label, table.table_name, status, n, None if status == "done" else f"{table.n_rows} rows expected"
        return table.table_schema, table.label, table.table_name, "failed", None, message

    with ThreadPoolExecutor(at_once) as pool:
        return spark.createDataFrame(list(pool.map(restore, ready)), REPORT)


NAME_PATTERN = r"^(.+)_(\d{14})_backup(?:_(\d+))?$"


def parsed_snapshots(snapshots: DataFrame) -> DataFrame:
    """Add ``db``, ``taken_at`` and ``list_no`` from the name; all NULL when the name is not valid."""
    taken = F.try_to_timestamp(
        F.nullif(F.regexp_extract("snapshot", NAME_PATTERN, 2), F.lit("")), F.lit("yyyyMMddHHmmss")
    ).cast("timestamp_ntz")
    valid = F.col("taken_at").isNotNull()
    number = F.coalesce(F.nullif(F.regexp_extract("snapshot", NAME_PATTERN, 3), F.lit("")).cast("int"), F.lit(1))
    return settled(snapshots, {"taken_at": taken}).withColumns(
        {"db": F.when(valid, F.regexp_extract("snapshot", NAME_PATTERN, 1)), "list_no": F.when(valid, number)}
    )


def latest_snapshots(snapshots: DataFrame, ordinal: str) -> DataFrame:
    """The newest good snapshot per user database, all its lists; of equal names the first listed wins."""
    good = parsed_snapshots(snapshots).filter((F.col("status") == "OK") & F.col("db").isNotNull())
    best = F.max_by(F.struct("snapshot", "taken_at"), F.struct("taken_at", -F.col(ordinal)))
    lists = user_schemas(good, "db").groupBy("db", "list_no").agg(best.alias("b")).select("db", "b.*")
    newest = F.max("taken_at").over(Window.partitionBy("db"))
    return lists.withColumn("_newest", newest).filter("taken_at = _newest").drop("_newest")


def invalid_names(snapshots: DataFrame) -> DataFrame:
    """Good snapshots that cannot be restored because their name does not parse."""
    return parsed_snapshots(snapshots).filter((F.col("status") == "OK") & F.col("db").isNull())
