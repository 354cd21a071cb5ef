"""Lineage queries. The definitions are written from rows of the given tables, so the
expected edges follow from the same rows without reading any statement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidewright.operators import lineage as ln
from tidewright.plans.tables import Query, table
from tidewright.session import dealt, settled_rows
from tidewright.sources.definitions import datasource_urls, stream_scripts, task_rows

DEFAULT = "default-service"


def _text(col: str):
    return F.col(col).cast("string")


def _definitions(spark, sf_dir, name):
    """A table whose rows become definitions: small in bytes, long to read as text."""
    return dealt(table(spark, sf_dir, name))


def _services(spark, sf_dir):
    """URL patterns of the nations' hosts; service names with a dot get quoted later."""
    nation, n = table(spark, sf_dir, "nation"), _text("n_nationkey")
    served = nation.filter(F.col("n_nationkey") < 23)
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("svc."), n)).otherwise(F.concat(F.lit("svc-"), n))
    sql = served.select(
        F.col("n_nationkey").alias("id"), F.concat(F.lit("h"), n, F.lit(":3306")).alias("url_pattern"),
        name.alias("service_name"),
    )
    star = served.select(
        (F.col("n_nationkey") + 100).alias("id"), F.concat(F.lit("h"), n, F.lit(":8030")).alias("url_pattern"),
        F.concat(F.lit("sr-"), n).alias("service_name"),
    )
    bus = table(spark, sf_dir, "region").filter(F.col("r_regionkey") == 0).select(
        F.lit(1000).alias("id"), F.lit("kafka").alias("url_pattern"), F.lit("bus").alias("service_name")
    )
    return ln.services(sql.unionByName(star).unionByName(bus), DEFAULT)


def _datasources(spark, sf_dir):
    nation, n = table(spark, sf_dir, "nation"), _text("n_nationkey")
    database = F.when(F.col("n_nationkey") != 19, F.concat(F.lit("db_"), n)).otherwise("")
    url = F.concat(F.lit("jdbc:mysql://h"), n, F.lit(":3306/"), database)
    params = F.when(F.col("n_nationkey") == 20, F.lit("{}")).otherwise(F.to_json(F.struct(url.alias("jdbcUrl"))))
    return datasource_urls(nation.select(F.col("n_nationkey").alias("id"), params.alias("connectionParams")))


def _tasks(spark, sf_dir):
    """Parts as scheduler tasks; the part type picks the shape of the statement."""
    part = _definitions(spark, sf_dir, "part")
    kind = F.col("p_type")
    k, s, b = _text("p_partkey"), _text("p_size"), F.replace("p_brand", F.lit("Brand#"), F.lit(""))
    joined = F.format_string(
        "-- load %s\ninsert into dw.fact_%s (creator, tenant_%s, updator) select A.creator, B.tenant_id, "
        "B.office_%s from ods.ledger_%s A left join ods.borrow_%s B on B.mid = A.id where A.state = 'a, (b'",
        k, k, s, b, b, s,
    )
    plain = F.format_string(
        "INSERT INTO `t_%s` SELECT `id`, `name` AS `label_%s` FROM `src_%s` UNION ALL\nselect o.k, upper(o.nm) from alt_%s o;",
        k, s, b, b,
    )
    computed = F.format_string(
        "insert into dw.agg_%s select max(a.v) as mx, a.grp, concat(a.x, '(', f(g(h(f(g(h(coalesce(a.y, 0)))))))) as xy, "
        "now() as etl_time, 1 as one from ods.m_%s as a group by a.grp, a.x", k, b,
    )
    two_lines = F.format_string("insert into\ndw.x_%s\nselect a from ods.b", k)
    nested = F.format_string("insert into dw.s_%s select a.id from (select id from ods.z) a", k)
    starred = F.format_string("insert into dw.copy_%s select * from ods.big_%s, ods.dim_%s d", k, b, s)
    worded = F.format_string(
        "insert into dw.w_%s select max(date) as last_date, cast(text as date) as d_%s, o.first from ods.k_%s o where o.day > now() - interval 1 day",
        k, s, b,
    )
    looked_up = F.format_string(
        "insert into dw.j_%s select id, b.x_%s, note, z.gone, amount * rate as total from ods.led_%s a join ods.bor_%s b on a.id = b.mid",
        k, s, b, s,
    )
    spelled = F.format_string("insert into dw.star_%s (c1, c2, c3, c4) select a.*, b.mid from ods.led_%s a, ods.bor_%s b", k, b, s)
    arms = F.format_string("insert into dw.p_%s (v) ( select a from ods.pa_%s) union all (select b from ods.pb_%s limit 3)", k, b, s)
    third = F.col("p_partkey") % 3
    sql = (
        F.when(kind == "ECONOMY", joined).when((kind == "SMALL") & (third == 1), worded).when(kind == "SMALL", plain)
        .when(kind == "MEDIUM", computed).when((kind == "PROMO") & (third == 1), arms).when(kind == "PROMO", two_lines)
        .when(kind == "STANDARD", nested).when(third == 1, looked_up).when(third == 2, spelled).otherwise(starred)
    )
    document = F.to_json(
        F.struct(
            F.lit("SQL").alias("taskType"), F.col("p_brand").alias("projectName"),
            F.col("p_partkey").alias("taskCode"), F.col("p_name").alias("taskName"),
            F.lit("nightly").alias("processDefinitionName"), F.lit("etl").alias("userName"),
            F.struct(sql.alias("sql"), (F.col("p_size") % 25).alias("datasource")).alias("taskParams"),
        )
    )
    tasks = task_rows(part.select(document.alias("value"))).filter(F.col("task_type") == "SQL")
    return tasks.join(_datasources(spark, sf_dir), "datasource")


def _columns(spark, sf_dir):
    """The catalog's columns of the ledgers and loans that statements of the parts read."""
    n = F.col("p_size") % 25
    service = (
        F.when(n >= 23, DEFAULT).when(n % 2 == 0, F.concat(F.lit('"svc.'), n.cast("string"), F.lit('"')))
        .otherwise(F.concat(F.lit("svc-"), n.cast("string")))
    )
    size = _text("p_size")
    ledger = F.concat(F.lit("ods.led_"), F.replace("p_brand", F.lit("Brand#"), F.lit("")))
    tables = F.array(
        F.struct(ledger.alias("name"), F.array(F.lit("id"), F.lit("amount"), F.lit("note")).alias("columns")),
        F.struct(
            F.concat(F.lit("ods.bor_"), size).alias("name"),
            F.array(F.lit("mid"), F.lit("rate"), F.concat(F.lit("x_"), size), F.lit("note")).alias("columns"),
        ),
    )
    known = table(spark, sf_dir, "part").select(service.alias("svc"), F.explode(tables).alias("t")).distinct()
    return known.select(
        ln.table_fqn(F.col("svc"), F.lit(""), F.col("t.name")).alias("fqn"), F.posexplode("t.columns").alias("position", "column_name")
    )


def _sql_edges(spark, sf_dir, names):
    return ln.sql_edges(_tasks(spark, sf_dir), names, _columns(spark, sf_dir))


def lineage_sql_edges(spark, sf_dir):
    return _sql_edges(spark, sf_dir, _services(spark, sf_dir)).drop("kind")


def lineage_sql_unparsed(spark, sf_dir):
    return ln.sql_unparsed(_tasks(spark, sf_dir), _services(spark, sf_dir), _columns(spark, sf_dir))


def _copy_jobs(spark, sf_dir):
    """Customers as reader-to-writer jobs; the nation picks the writer's column list."""
    nation, k, n = F.col("c_nationkey"), _text("c_custkey"), _text("c_nationkey")
    segment = F.lower("c_mktsegment")
    query = F.format_string(
        "select `id`, name_%s,\n balance as bal, f(f(f(f(f(f(f(concat(x, '(', y)))))))) as etl_time from src_%s.t_%s where id > 0",
        n, segment, k,
    )
    columns = (
        F.when(nation < 8, F.array(F.lit("*")))
        .when(nation < 16, F.array(F.lit("id"), F.lit("nm"), F.lit("bal"), F.lit("etl")))
        .otherwise(F.array(F.lit("id")))
    )

    def url(key):
        return F.concat(F.lit("jdbc:mysql://h"), key.cast("string"), F.lit(":3306/x"))

    document = F.to_json(
        F.struct(F.struct(F.array(F.struct(
            F.struct(F.struct(F.array(F.struct(
                F.array(query).alias("querySql"), F.array(url(nation)).alias("jdbcUrl"),
            )).alias("connection")).alias("parameter")).alias("reader"),
            F.struct(F.struct(
                url((nation + 1) % 25).alias("jdbcUrl"), F.lit("ods").alias("database"),
                F.concat(F.lit("o_"), k).alias("table"), columns.alias("column"),
            ).alias("parameter")).alias("writer"),
        )).alias("content")).alias("job"))
    )
    jobs = _definitions(spark, sf_dir, "customer").select(
        k.alias("source_id"), document.alias("json"), F.concat(F.lit("copy "), k).alias("description")
    )
    return jobs


def _copy_edges(spark, sf_dir, names):
    return ln.copy_edges(_copy_jobs(spark, sf_dir), names)


def lineage_datax_edges(spark, sf_dir):
    return _copy_edges(spark, sf_dir, _services(spark, sf_dir)).drop("kind")


def _stream_scripts(spark, sf_dir):
    """Suppliers as stream jobs: topics for most nations, a change-capture table for some."""
    k, n = _text("s_suppkey"), _text("s_nationkey")
    topic = F.format_string(
        "CREATE TABLE `Src_%s` (\n  `id` bigint, -- key\n  PRIMARY KEY (`id`) NOT ENFORCED\n) WITH (\n"
        "  'connector' = 'kafka',\n  'topic' = 'ods_%s',\n"
        "  'properties.bootstrap.servers' = 'h%s:9092,h2:9092');\n", k, k, n,
    )
    capture = F.format_string(
        "CREATE TABLE src_%s (id bigint) WITH ('connector'='mysql-cdc', 'hostname'='h%s', 'port'='3306',"
        " 'database-name'='app_%s', 'table-name'='acc_%s');\n", k, n, n, k,
    )
    sink = F.format_string(
        "\n\nCREATE TABLE dst_%s (id bigint) WITH ('connector'='starrocks', 'load-url'='h%s:8030',"
        " 'database-name'='dw', 'table-name'='Dim_%s');\n\n", k, n, k,
    )
    copy_all = F.format_string("insert into dst_%s select *, LOCALTIMESTAMP as etl_time from src_%s;", k, k)
    columns = F.format_string("INSERT INTO dst_%s\nSELECT Id, s.name AS label FROM `src_%s` s;\n", k, k)
    captured = F.col("s_nationkey") % 3 == 0
    script = F.concat(
        F.lit("-- job\n"), F.when(captured, capture).otherwise(topic), sink,
        F.when(captured, columns).otherwise(copy_all),
    )
    jobs = _definitions(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("app_id"), F.when(F.col("s_acctbal") >= 0, 1).otherwise(2).alias("app_type"),
        F.base64(F.encode(script, "UTF-8")).alias("flink_sql"),
    )
    scripts = stream_scripts(jobs).select(
        _text("app_id").alias("source_id"), "script", F.concat(F.lit("stream "), _text("app_id")).alias("description")
    )
    return scripts


def _stream_edges(spark, sf_dir, names):
    return ln.stream_edges(_stream_scripts(spark, sf_dir), names)


def lineage_flink_edges(spark, sf_dir):
    return _stream_edges(spark, sf_dir, _services(spark, sf_dir)).drop("kind")


def _properties(spark, sf_dir):
    """Customers as replication instances; some lack an address or the topic block."""
    nation, k, n = F.col("c_nationkey"), _text("c_custkey"), _text("c_nationkey")
    address = F.when(nation != 21, F.format_string("canal.instance.master.address=h%s:3306\n", n)).otherwise("")
    block = F.when(
        nation != 22,
        F.format_string(
            "canal.mq.dynamicTopic=\\\nods-%s-a:db_%s\\\\.t_%s,\\\nods-%s-b:db_%s\\\\.u_%s,\\\n\n",
            k, n, k, k, n, k,
        ),
    ).otherwise("")
    text = F.concat(F.lit("# position\n"), address, F.lit("canal.mq.topic=x\n"), block, F.lit("canal.mq.partition=0\na:b\n"))
    properties = _definitions(spark, sf_dir, "customer").select(
        k.alias("source_id"), text.alias("text"), F.concat(F.lit("topic "), k).alias("description")
    )
    return properties


def _topic_edges(spark, sf_dir, names):
    return ln.topic_edges(_properties(spark, sf_dir), names)


def lineage_skipped_jobs(spark, sf_dir):
    """Jobs of every other kind that give no edge, with the reason."""
    parts = {
        "copy": ln.copy_unparsed(_copy_jobs(spark, sf_dir)),
        "stream": ln.stream_unparsed(_stream_scripts(spark, sf_dir)),
        "topic": ln.topic_unparsed(_properties(spark, sf_dir)),
    }
    named = [rows.select(F.lit(kind).alias("kind"), "source_id", "reason") for kind, rows in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


def lineage_canal_edges(spark, sf_dir):
    return _topic_edges(spark, sf_dir, _services(spark, sf_dir)).drop("kind")


def _all(spark, sf_dir):
    names = _services(spark, sf_dir)
    parts = [f(spark, sf_dir, names) for f in (_sql_edges, _copy_edges, _stream_edges, _topic_edges)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def lineage_all_edges(spark, sf_dir):
    edges = ln.collect_edges(_all(spark, sf_dir))
    pairs = F.transform("columns", lambda c: F.concat_ws(">", c["from_col"], c["to_col"]))
    return edges.select(
        "from_fqn", "to_fqn", F.size("columns").alias("n_columns"), F.array_join(pairs, ",").alias("columns"),
        "description",
    )


def edges_known_entities(spark, sf_dir):
    """Known are the sources of SQL, copy and topic jobs and the targets of all but copy jobs. The edges are read once:
    they are settled before the entities are taken from them."""
    edges = settled_rows(_all(spark, sf_dir).select("kind", "from_fqn", "to_fqn").distinct())
    sources = edges.filter(F.col("kind") != "stream").select(F.col("from_fqn").alias("fqn"))
    targets = edges.filter(F.col("kind") != "copy").select(F.col("to_fqn").alias("fqn"))
    checked = ln.check_entities(edges.select("from_fqn", "to_fqn").distinct(), sources.union(targets))
    return checked.select("from_fqn", "to_fqn", "reason")


def lineage_edges_upsert(spark, sf_dir):
    """A store with the edges of copy and topic jobs, into which those of half the topic jobs are loaded again, described anew."""
    names = _services(spark, sf_dir)
    topics = _topic_edges(spark, sf_dir, names)
    stored = ln.collect_edges(_copy_edges(spark, sf_dir, names).unionByName(topics))
    again = topics.filter(F.col("source_id").cast("bigint") % 2 == 0).withColumn("description", F.concat(F.lit("again "), "description"))
    edges = ln.upsert_edges(stored, ln.collect_edges(again))
    return edges.select("from_fqn", "to_fqn", F.size("columns").alias("n_columns"), "description")


def url_service_lookup(spark, sf_dir):
    """Hosts with their language and bare hosts of the pages as patterns, oldest page first."""
    pages = table(spark, sf_dir, "pages")
    located = pages.select(
        "page_id", F.regexp_extract("url", r"^[a-z]+://([^/]+)/[a-z]+", 0).alias("head"),
        F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"),
    )
    pattern = F.explode(
        F.array(
            F.struct(F.regexp_extract("head", r"://(.*)$", 1).alias("p"), F.lit(0).alias("late")),
            F.struct(F.col("host").alias("p"), F.lit(1).alias("late")),
        )
    )
    services = (
        located.select("page_id", "host", pattern.alias("x")).filter(F.col("x.p") != "")
        .groupBy(F.col("x.p").alias("url_pattern"))
        .agg(
            F.min(F.col("x.late") * 1_000_000_000_000 + F.col("page_id")).alias("id"),
            F.min(F.substring_index("host", ".", 2)).alias("service_name"),
        )
    )
    found = ln.with_service(pages.select("page_id", "url"), {"url": "service"}, ln.services(services, DEFAULT))
    return found.select("page_id", "service")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        lineage_sql_edges, lineage_sql_unparsed, lineage_datax_edges, lineage_flink_edges,
        lineage_canal_edges, lineage_skipped_jobs, lineage_all_edges, lineage_edges_upsert, edges_known_entities, url_service_lookup,
    )
}


def _svc(n: str) -> str:
    """The service of host number ``n``."""
    return f"""CASE WHEN {n} >= 23 THEN '{DEFAULT}' WHEN {n} % 2 = 0 THEN '"svc.' || CAST({n} AS VARCHAR) || '"'
      ELSE 'svc-' || CAST({n} AS VARCHAR) END"""


_EDGES = f"""
tk AS (SELECT CAST(p_partkey AS VARCHAR) AS k, p_partkey % 3 AS third, CAST(p_size AS VARCHAR) AS s, replace(p_brand, 'Brand#', '') AS b,
    p_type, p_size % 25 AS n, {_svc('p_size % 25')} || '.default.' AS svc,
    CASE WHEN p_size % 25 = 19 THEN '' ELSE 'db_' || CAST(p_size % 25 AS VARCHAR) || '.' END AS db,
    'kind: SQL' || chr(10) || 'project: ' || p_brand || chr(10) || 'workflow: nightly' || chr(10) || 'task: '
      || p_name || chr(10) || 'owner: etl' AS d
  FROM part WHERE p_size % 25 <> 20),
sql_e AS (
  SELECT 'sql' AS kind, k AS source_id, d AS description, svc || 'ods.ledger_' || b AS from_fqn, 'creator' AS from_col,
    svc || 'dw.fact_' || k AS to_fqn, 'creator' AS to_col FROM tk WHERE p_type = 'ECONOMY'
  UNION ALL SELECT 'sql', k, d, svc || 'ods.borrow_' || s, 'tenant_id', svc || 'dw.fact_' || k, 'tenant_' || s
    FROM tk WHERE p_type = 'ECONOMY'
  UNION ALL SELECT 'sql', k, d, svc || 'ods.borrow_' || s, 'office_' || b, svc || 'dw.fact_' || k, 'updator'
    FROM tk WHERE p_type = 'ECONOMY'
  UNION ALL SELECT 'sql', k, d, svc || db || 'src_' || b, 'id', svc || db || 't_' || k, 'id' FROM tk WHERE p_type = 'SMALL' AND third <> 1
  UNION ALL SELECT 'sql', k, d, svc || db || 'src_' || b, 'name', svc || db || 't_' || k, 'label_' || s
    FROM tk WHERE p_type = 'SMALL' AND third <> 1
  UNION ALL SELECT 'sql', k, d, svc || db || 'alt_' || b, 'k', svc || db || 't_' || k, 'id' FROM tk WHERE p_type = 'SMALL' AND third <> 1
  UNION ALL SELECT 'sql', k, d, svc || db || 'alt_' || b, 'nm', svc || db || 't_' || k, 'label_' || s
    FROM tk WHERE p_type = 'SMALL' AND third <> 1
  UNION ALL SELECT 'sql', k, d, svc || 'ods.m_' || b, unnest(['v', 'grp', 'x', 'y']), svc || 'dw.agg_' || k,
    unnest(['mx', 'grp', 'xy', 'xy']) FROM tk WHERE p_type = 'MEDIUM'
  UNION ALL SELECT 'sql', k, d, svc || 'ods.big_' || b, NULL, svc || 'dw.copy_' || k, NULL
    FROM tk WHERE p_type NOT IN ('ECONOMY', 'SMALL', 'MEDIUM', 'PROMO', 'STANDARD') AND third = 0
  UNION ALL SELECT 'sql', k, d, svc || 'ods.dim_' || s, NULL, svc || 'dw.copy_' || k, NULL
    FROM tk WHERE p_type NOT IN ('ECONOMY', 'SMALL', 'MEDIUM', 'PROMO', 'STANDARD') AND third = 0
  UNION ALL SELECT 'sql', k, d, svc || 'ods.k_' || b, unnest(['date', 'text', 'first']), svc || 'dw.w_' || k,
    unnest(['last_date', 'd_' || s, 'first']) FROM tk WHERE p_type = 'SMALL' AND third = 1
  UNION ALL SELECT 'sql', k, d, svc || unnest(['ods.pa_' || b, 'ods.pb_' || s]), unnest(['a', 'b']), svc || 'dw.p_' || k, 'v'
    FROM tk WHERE p_type = 'PROMO' AND third = 1
  UNION ALL SELECT 'sql', k, d, svc || unnest(['ods.led_' || b, 'ods.bor_' || s, 'ods.led_' || b, 'ods.bor_' || s]),
    unnest(['id', 'x_' || s, 'amount', 'rate']), svc || 'dw.j_' || k, unnest(['id', 'x_' || s, 'total', 'total'])
    FROM tk WHERE p_type NOT IN ('ECONOMY', 'SMALL', 'MEDIUM', 'PROMO', 'STANDARD') AND third = 1
  UNION ALL SELECT 'sql', k, d, svc || unnest(['ods.led_' || b, 'ods.led_' || b, 'ods.led_' || b, 'ods.bor_' || s]),
    unnest(['id', 'amount', 'note', 'mid']), svc || 'dw.star_' || k, unnest(['c1', 'c2', 'c3', 'c4'])
    FROM tk WHERE p_type NOT IN ('ECONOMY', 'SMALL', 'MEDIUM', 'PROMO', 'STANDARD') AND third = 2),
ck AS (SELECT CAST(c_custkey AS VARCHAR) AS k, c_nationkey AS n, CAST(c_nationkey AS VARCHAR) AS nt,
    lower(c_mktsegment) AS seg, {_svc('c_nationkey')} || '.default.' AS svc,
    {_svc('((c_nationkey + 1) % 25)')} || '.default.' AS svc2 FROM customer),
copy_e AS (
  SELECT 'copy' AS kind, k AS source_id, 'copy ' || k AS description, svc || 'src_' || seg || '.t_' || k AS from_fqn,
    f AS from_col, svc2 || 'ods.o_' || k AS to_fqn, CASE WHEN n < 8 THEN f ELSE t END AS to_col
  FROM (SELECT *, unnest(['id', 'name_' || nt, 'balance as bal']) AS f, unnest(['id', 'nm', 'bal']) AS t
    FROM ck WHERE n < 16)),
sk AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, s_nationkey AS n, {_svc('s_nationkey')} AS svc,
    CASE WHEN s_nationkey >= 23 THEN '{DEFAULT}' ELSE 'sr-' || CAST(s_nationkey AS VARCHAR) END AS sr
  FROM supplier WHERE s_acctbal >= 0),
stream_e AS (
  SELECT 'stream' AS kind, k AS source_id, 'stream ' || k AS description, '{DEFAULT}.ods_' || k AS from_fqn,
    NULL AS from_col, sr || '.default.dw.Dim_' || k AS to_fqn, NULL AS to_col FROM sk WHERE n % 3 <> 0
  UNION ALL SELECT 'stream', k, 'stream ' || k, svc || '.default.app_' || CAST(n AS VARCHAR) || '.acc_' || k,
    unnest(['id', 'name']), sr || '.default.dw.Dim_' || k, unnest(['id', 'label']) FROM sk WHERE n % 3 = 0),
topic_e AS (
  SELECT 'topic' AS kind, k AS source_id, 'topic ' || k AS description,
    svc || 'db_' || nt || '.' || unnest(['t_', 'u_']) || k AS from_fqn, CAST(NULL AS VARCHAR) AS from_col,
    'bus.ods-' || k || '-' || unnest(['a', 'b']) AS to_fqn, CAST(NULL AS VARCHAR) AS to_col
  FROM ck WHERE n NOT IN (21, 22)),
all_e AS (SELECT * FROM sql_e UNION ALL SELECT * FROM copy_e UNION ALL SELECT * FROM stream_e
  UNION ALL SELECT * FROM topic_e)"""


def _edges_of(cte: str) -> str:
    return f"WITH {_EDGES} SELECT * EXCLUDE kind FROM {cte}"


ORACLES: dict[str, str] = {
    "lineage_sql_edges": _edges_of("sql_e"),
    "lineage_sql_unparsed": """SELECT p_partkey AS task_code, CAST(NULL AS VARCHAR) AS item,
        CASE p_type WHEN 'PROMO' THEN 'skipped' ELSE 'subquery' END AS reason
      FROM part WHERE p_size % 25 <> 20 AND (p_type = 'STANDARD' OR (p_type = 'PROMO' AND p_partkey % 3 <> 1))
      UNION ALL SELECT p_partkey, unnest(['note', 'gone']), unnest(['ambiguous column', 'unknown qualifier'])
      FROM part WHERE p_size % 25 <> 20 AND p_type NOT IN ('ECONOMY', 'SMALL', 'MEDIUM', 'PROMO', 'STANDARD') AND p_partkey % 3 = 1""",
    "lineage_datax_edges": _edges_of("copy_e"),
    "lineage_flink_edges": _edges_of("stream_e"),
    "lineage_canal_edges": _edges_of("topic_e"),
    "lineage_skipped_jobs": """
      SELECT 'copy' AS kind, CAST(c_custkey AS VARCHAR) AS source_id, 'column count differs' AS reason
        FROM customer WHERE c_nationkey >= 16
      UNION ALL SELECT 'topic', CAST(c_custkey AS VARCHAR), CASE c_nationkey WHEN 21 THEN 'no address' ELSE 'no topic block' END
        FROM customer WHERE c_nationkey IN (21, 22)""",
    "lineage_all_edges": f"""WITH {_EDGES},
      u AS (SELECT from_fqn, to_fqn, from_col, to_col, min(description) AS description FROM all_e
        GROUP BY from_fqn, to_fqn, from_col, to_col)
      SELECT from_fqn, to_fqn, CAST(count(from_col) AS INT) AS n_columns,
        coalesce(string_agg(from_col || '>' || to_col, ',' ORDER BY from_col, to_col), '') AS columns,
        min(description) AS description
      FROM u GROUP BY from_fqn, to_fqn""",
    "lineage_edges_upsert": f"""WITH {_EDGES}
      SELECT from_fqn, to_fqn, CAST(count(DISTINCT from_col || '>' || to_col) AS INT) AS n_columns,
        min(CASE WHEN kind = 'topic' AND CAST(source_id AS BIGINT) % 2 = 0 THEN 'again ' ELSE '' END || description) AS description
      FROM all_e WHERE kind IN ('copy', 'topic') GROUP BY from_fqn, to_fqn""",
    "edges_known_entities": f"""WITH {_EDGES},
      known AS (SELECT from_fqn AS fqn FROM all_e WHERE kind <> 'stream'
        UNION SELECT to_fqn FROM all_e WHERE kind <> 'copy')
      SELECT DISTINCT from_fqn, to_fqn,
        CASE WHEN from_fqn NOT IN (SELECT fqn FROM known) THEN 'source unknown'
          WHEN to_fqn NOT IN (SELECT fqn FROM known) THEN 'target unknown' END AS reason
      FROM all_e""",
    "url_service_lookup": f"""WITH h AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host,
          regexp_extract(url, '^[a-z]+://([^/]+/[a-z]+)', 1) AS head FROM pages),
      p AS (SELECT head AS pat, page_id AS id, host FROM h UNION ALL
        SELECT host, page_id + 1000000000000, host FROM h),
      s AS (SELECT pat, min(id) AS id, min(array_to_string(string_split(host, '.')[1:2], '.')) AS service
        FROM p WHERE pat <> '' GROUP BY pat),
      m AS (SELECT page_id, min(id) AS id FROM h JOIN s ON contains(url, pat) GROUP BY page_id)
      SELECT h.page_id, CASE WHEN service IS NULL THEN '{DEFAULT}' WHEN contains(service, '.')
          THEN '"' || service || '"' ELSE service END AS service
      FROM h LEFT JOIN m USING (page_id) LEFT JOIN s ON s.id = m.id""",
}
