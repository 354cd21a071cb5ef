import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewright.operators import lineage as ln
from tidewright.operators.statements import Dictionary
from tidewright.plans import lineage as plans
from tidewright.sources.definitions import datasource_urls, stream_scripts, task_rows


@pytest.fixture(scope="module")
def patterns(spark):
    return spark.createDataFrame(
        [(1, "h1:3306", "svc-a"), (2, "h1", "svc.b"), (3, "db9", "Test-MySQL"), (4, "kafka", "bus"),
         (5, "star:8030", "star")],
        "id int, url_pattern string, service_name string",
    )


@pytest.fixture(scope="module")
def names(patterns):
    return ln.services(patterns, "uat")


def parsed(spark, sql):
    df = spark.createDataFrame([(sql,)], "sql string")
    r = ln.parse_insert_select(df, "sql").first()
    return r.target, [tuple(p) for p in r.pairs], r.reason


@pytest.mark.parametrize(
    "sql,target,pairs",
    [
        ("insert into d.t select a, b x from s", "d.t", [("s", "a", "a"), ("s", "b", "x")]),
        ("INSERT INTO d.t (c1, c2) SELECT A.x, B.y FROM d.u A left join d.w B on A.i = B.i where A.s = 1", "d.t",
         [("d.u", "x", "c1"), ("d.w", "y", "c2")]),
        ("insert into `d`.`t`(`c`) select `u`.`x` from `d`.`u`", "d.t", [("d.u", "x", "c")]),
        ("insert into t select d.u.x from d.u join d.v on 1 = 1", "t", [("d.u", "x", "x")]),
        ("insert overwrite table t select distinct x from s group by x, y order by x, z", "t", [("s", "x", "x")]),
        ("insert into t select a.x from s a, r as b", "t", [("s", "x", "x")]),
        ("insert into t select * from s a join r b on a.i = b.i", "t", [("s", "*", "*"), ("r", "*", "*")]),
        ("insert into t select b.* from s a join r b on a.i = b.i", "t", [("r", "*", "*")]),
        ("insert into t select f(g(a, b), c) as m, x, 1 as one, 'a, from b' as l, a.x + a.y as z, null as n from s a", "t",
         [("s", "a", "m"), ("s", "b", "m"), ("s", "c", "m"), ("s", "x", "x"), ("s", "x", "z"), ("s", "y", "z")]),
        ("insert into dw.t (a,b) select max(x.v) as mx, coalesce(x.w,0) as w from ods.s x", "dw.t",
         [("ods.s", "v", "a"), ("ods.s", "w", "b")]),
        ("insert into t select " + "f(" * 8 + "x, '('" + ")" * 8 + " y from s", "t", [("s", "x", "y")]),
        ("insert into t select extract(year from s.d) as y, case when s.k in ('a', 'b') then s.v end as v from s", "t",
         [("s", "d", "y"), ("s", "k", "v"), ("s", "v", "v")]),
        ("insert into t select max(x), y from s", "t", [("s", "y", "y")]),
        ("insert into t select x -- , y from nowhere\nfrom s where n = '(select'", "t", [("s", "x", "x")]),
        ("insert into t select x from s where n = '-- not a comment' and m in (1, 2);\n", "t", [("s", "x", "x")]),
        ("insert into 表 select 列 from 源", "表", [("源", "列", "列")]),
        # Columns that are called as types, units and frame words are.
        ("insert into t select max(date) as last_date, id from ods.s", "t", [("ods.s", "date", "last_date"), ("ods.s", "id", "id")]),
        ("insert into t select upper(text) as u, first + last as n, max(current) as c from s", "t",
         [("s", "text", "u"), ("s", "first", "n"), ("s", "last", "n"), ("s", "current", "c")]),
        ("insert into t select cast(date as date) as d, cast(x as decimal(9, 2)) as x, time::date as y, convert(day, signed integer) as z from s", "t",
         [("s", "date", "d"), ("s", "x", "x"), ("s", "time", "y"), ("s", "day", "z")]),
        ("insert into t select date + interval n day as d, extract(year from year) as y, timestampdiff(month, a, month) as m, date '2024-01-01' as f from s",
         "t", [("s", "date", "d"), ("s", "n", "d"), ("s", "year", "y"), ("s", "a", "m"), ("s", "month", "m")]),
        ("insert into t select sum(row) over (partition by day order by hour desc nulls last rows between unbounded preceding and current row) as w, "
         "trim(both 'x' from text) as v, group_concat(distinct first order by last separator ';') as g from s", "t",
         [("s", "row", "w"), ("s", "day", "w"), ("s", "hour", "w"), ("s", "text", "v"), ("s", "first", "g"), ("s", "last", "g")]),
        # A partition, and targets behind a star.
        ("insert overwrite table d.t partition (dt = '1', hr) select a, b from s", "d.t", [("s", "a", "a"), ("s", "b", "hr")]),
        ("insert overwrite table d.t partition (dt) (x, y) select a, b, c from s", "d.t", [("s", "a", "x"), ("s", "b", "y"), ("s", "c", "dt")]),
        ("insert into t (x, y, z, w) select a, r.*, b from s a join r on 1 = 1 where a.k = 2", "t", [("r", "*", "*")]),
        ("insert into t (x, y, z, w) select a, *, b from s", "t", [("s", "a", "x"), ("s", "*", "*"), ("s", "b", "w")]),
        ("insert into t (select a, (b) as c from s where (k = 1))", "t", [("s", "a", "a"), ("s", "b", "c")]),
    ],
)
def test_statements_that_are_read(spark, sql, target, pairs):
    assert parsed(spark, sql) == (target, pairs, None)


@pytest.mark.parametrize(
    "sql,reason",
    [
        ("insert into t select a from (select b from s) x", "subquery"),
        ("insert into t select a from s where i in ( select i from r)", "subquery"),
        ("with x as (select 1) insert into t select a from x", "subquery"),
        ("update t set a = 1", "not insert select"),
        ("insert into t values (1)", "not insert select"),
        ("insert into t select 1", "no source"),
        ("insert into t (a, b) select x from s", "column count differs"),
        ("insert into t select f((x) as y from s", "unbalanced"),
        ("insert into t select x from s, r", "no source column"),
        ("insert into t select cast(x as int) as y, z from s left join r using (i)", "no source column"),
        ("insert into t select count(*) as n from s", "no source column"),
    ],
)
def test_statements_that_are_reported(spark, sql, reason):
    assert parsed(spark, sql)[2] == reason


def test_arms_of_a_set_operation(spark):
    sql = "insert into t select a, f(b) as c from s union all select x, y from r except distinct select count(*), z from q"
    df = spark.createDataFrame([(sql,)], "sql string")
    got = [[tuple(p) for p in r.pairs] for r in ln.parse_insert_select(df, "sql").collect()]
    assert got == [[("s", "a", "a"), ("s", "b", "c")], [("r", "x", "a"), ("r", "y", "c")], [("q", "z", "c")]]


def test_arms_in_parentheses(spark):
    sql = "insert into t (x) (select a from s where k in (1, 2)) union all (select f(b) from r limit 3)union(select c from q)"
    df = spark.createDataFrame([(sql,), ("insert into t (select a from s union select b from r)",)], "sql string")
    got = [([tuple(p) for p in r.pairs], r.reason) for r in ln.parse_insert_select(df, "sql").collect()]
    assert got[:3] == [([("s", "a", "x")], None), ([("r", "b", "x")], None), ([("q", "c", "x")], None)]
    assert got[3:] == [([], "nested set operation")]


@pytest.fixture(scope="module")
def dictionary(spark):
    columns = [("S1", "Id", 1), ("s1", "id", 1), ("s1", "amount", 2), ("s2", "x", 2), ("s2", "note", 1), ("s3", "amount", 1), (None, "q", 1), ("s2", None, 3)]
    return Dictionary(spark.createDataFrame(columns, "place string, column_name string, position int"), F.lower)


@pytest.mark.parametrize(
    "sql,pairs,lost",
    [
        ("select id, b.x from s1 a join s2 b", [("s1", "id", "id"), ("s2", "x", "x")], []),
        ("select * from s1 a join s2 b", [("s1", "id", "id"), ("s1", "amount", "amount"), ("s2", "note", "note"), ("s2", "x", "x")], []),
        ("select b.*, id + amount as n from s1 a join s2 b", [("s2", "note", "note"), ("s2", "x", "x"), ("s1", "id", "n"), ("s1", "amount", "n")], []),
        ("select NOTE as n, amount from S1 a, S3 b, s2", [("s2", "NOTE", "n")], [("amount", "ambiguous column")]),
        ("select id, other from s1, s2, far", [("s1", "id", "id"), ("far", "other", "other")], []),
        ("select id, other from s1, far, away", [("s1", "id", "id")], [("other", "unqualified column")]),
        ("select id, other, z.k, upper(id) from s1, s2", [("s1", "id", "id")], [("other", "unknown column"), ("k", "unknown qualifier"), ("id", "no target name")]),
        ("select *, x as y from far f join s2", [("far", "*", "*"), ("s2", "note", "note"), ("s2", "x", "x"), ("s2", "x", "y")], []),
        ("select z.*, id from s1, s2", [("s1", "id", "id")], [("*", "unknown qualifier")]),
    ],
)
def test_column_dictionary(spark, dictionary, sql, pairs, lost):
    df = spark.createDataFrame([(f"insert into t {sql}",)], "sql string")
    r = ln.parse_insert_select(df, "sql", dictionary).first()
    assert ([tuple(p) for p in r.pairs], [tuple(x) for x in r.lost], r.reason) == (pairs, lost, None)


def test_spelled_stars_count_as_columns(spark, dictionary):
    sqls = ["insert into t (a, b, c) select *, note from s1, s2 where s1.id = 1", "insert into t (a, b, c) select s1.*, note from s1, s2"]
    df = spark.createDataFrame([(s,) for s in sqls], "sql string")
    got = [(r.reason, [tuple(p) for p in r.pairs]) for r in ln.parse_insert_select(df, "sql", dictionary).orderBy(F.length("sql")).collect()]
    assert got == [(None, [("s1", "id", "a"), ("s1", "amount", "b"), ("s2", "note", "c")]), ("column count differs", [])]


def test_lost_columns_are_reported(spark, names):
    tasks = spark.createDataFrame(
        [(1, "insert into t select x, b.y from s a join r b", "x/", "d"), (2, "insert into t select a from s", "x/", "d"), (3, "update t", "x/", "d"),
         (4, "insert into t select count(*) as n from s", "x/", "d")],
        "task_code int, sql string, jdbc_url string, description string",
    )
    found = [(1, "x", "unqualified column"), (3, None, "skipped"), (4, None, "no source column")]
    assert sorted(map(tuple, ln.sql_unparsed(tasks).collect()), key=str) == sorted(found, key=str)
    columns = spark.createDataFrame([("uat.default.r", "X", 1)], "fqn string, column_name string, position int")
    assert sorted(map(tuple, ln.sql_unparsed(tasks, names, columns).collect()), key=str) == sorted(found[1:], key=str)
    assert rows(ln.sql_edges(tasks, names, columns), "from_fqn", "from_col") == [("uat.default.r", "x"), ("uat.default.r", "y"), ("uat.default.s", "a")]


def test_long_statements_are_read_in_line_with_their_length(spark):
    items = ", ".join(f"f({k}, (c{k})) as d{k}" for k in range(600))
    r = ln.parse_insert_select(spark.createDataFrame([(f"insert into t select {items} from s",)], "sql string"), "sql").first()
    assert [tuple(p) for p in r.pairs] == [("s", f"c{k}", f"d{k}") for k in range(600)]


def test_classifier_stops_at_the_line(spark):
    df = spark.createDataFrame([("insert into t select 1",), ("INSERT  into t (a)\nselect 1",), ("insert into\nt\nselect 1",)], "s string")
    assert [r[0] for r in df.select(ln.is_insert_select(F.col("s"))).collect()] == [True, True, False]


def test_joined_statement_edges(spark, names):
    """An insert with a column list maps by position, whatever the select names."""
    sql = """insert
        into
        my_test.fee_info (creator, tenant_id, updator)
        select
            A.creator,
            B.tenant_id,
            B.office_name
        from
            my_test.ledger A
        left join my_test.borrowing B on
            B.mid = A.ledger_id
        where
            A.state_id = 1"""
    one_line = "insert into x(creator, tenant_id, updator) select 1"
    assert ln.is_insert_select(F.lit(one_line)) is not None
    target, pairs, reason = parsed(spark, sql)
    assert (target, reason) == ("my_test.fee_info", None)
    assert pairs == [
        ("my_test.ledger", "creator", "creator"), ("my_test.borrowing", "tenant_id", "tenant_id"),
        ("my_test.borrowing", "office_name", "updator"),
    ]


def test_sql_edges_name_service_and_database(spark, names):
    tasks = spark.createDataFrame(
        [(1, "insert into t select a from s", "jdbc:mysql://db9/app", "d"),
         (2, "insert into t select a from x.s", "jdbc:mysql://other/", "d"),
         (3, "insert into t select * from s", "jdbc:mysql://h1:9/app", "d")],
        "task_code int, sql string, jdbc_url string, description string",
    )
    assert rows(ln.sql_edges(tasks, names), "from_fqn", "from_col", "to_fqn", "to_col") == [
        ('"svc.b".default.app.s', None, '"svc.b".default.app.t', None),
        ("Test-MySQL.default.app.s", "a", "Test-MySQL.default.app.t", "a"),
        ("uat.default.x.s", "a", "uat.default.t", "a"),
    ]


URLS = ["jdbc:mysql://h1:3306/x", "jdbc:mysql://h1:9/x", "zzz", None, "", "db9h1", "kafka"]


def test_url_lookup_by_rare_pieces(spark):
    """Every pattern length around that of a piece, against plain containment; pieces that all patterns share."""
    patterns = [(k, text, f"s{k}") for k, text in enumerate(["a", "ab", "abc", "abcd", "abcde", "://h1:3306/", "://h2:3306/", "3306", "中文:3306", "zz", "h1:3306", "h1:3306"])]
    urls = ["jdbc://h1:3306/x", "jdbc://h2:3306/", "x://中文:3306", "abce", "xabcdex", "zzz", "a", "", "q"]
    names = ln.services(spark.createDataFrame(patterns, "id int, url_pattern string, service_name string"), "none")
    rows_of = spark.createDataFrame([(i, u, urls[-1 - i]) for i, u in enumerate(urls)], "i int, u string, v string")
    got = [(r.s, r.t) for r in ln.with_service(rows_of, {"u": "s", "v": "t"}, names).orderBy("i").collect()]
    want = [next((s for _, p, s in patterns if p in u), "none") for u in urls]
    assert got == list(zip(want, want[::-1]))


def test_url_lookup_shuffles_no_more_pieces_than_characters(spark, names):
    url = "jdbc:mysql://" + "x" * 500 + "h1:3306/y"
    found = ln.with_service(spark.createDataFrame([(url,)], "u string"), {"u": "s"}, names)
    assert found.first().s == "svc-a"
    made = spark.range(1).select(F.size(ln._pieces(F.lit(url), F.array(F.lit(ln.PIECE))))).first()[0]
    assert made <= len(url)


@pytest.mark.parametrize("extra", [[], [(None, None, "n"), (9, None, "n"), (2, "h1:", "tie"), (10, "", "empty")]])
def test_url_lookup(spark, patterns, extra):
    """Equal ids go by pattern text, NULL patterns match nothing."""
    names = ln.services(patterns.union(spark.createDataFrame(extra, patterns.schema)).filter("url_pattern IS NULL OR url_pattern <> ''"), "uat")
    urls = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "i int, url string")
    got = [r.s for r in ln.with_service(urls, {"url": "s"}, names).orderBy("i").collect()]
    assert got == ["svc-a", '"svc.b"', "uat", "uat", "uat", '"svc.b"', "bus"]


def test_lookup_equals_a_scan_of_all_patterns(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    parts = sorted({p for r in pages.collect() for p in re.split("[/?#=&.]", r.url) if p})
    pats = spark.createDataFrame([(i, p, f"s-{p}") for i, p in enumerate(parts)], "id int, url_pattern string, service_name string")
    got = ln.with_service(pages, {"url": "s"}, ln.services(pats, "none"))
    want = [(r.page_id, r.url, next(f"s-{p}" for p in parts if p in r.url)) for r in pages.collect()]
    assert rows(got) == sorted(want, key=repr)


def copy_job(items, columns, table="src.t"):
    import json

    return json.dumps({"job": {"setting": {"speed": {"channel": 3}}, "content": [{
        "reader": {"parameter": {"connection": [{"querySql": [f"select {items} from {table}"], "jdbcUrl": ["jdbc:mysql://db9/x"]}]}},
        "writer": {"parameter": {"jdbcUrl": "jdbc:mysql://star:8030/y", "database": "ods", "table": "o", "column": columns}},
    }]}})


def test_copy_jobs_without_edges_have_a_reason(spark, names):
    deep = "f(" * 8 + "concat(x, '(')" + ")" * 8 + " as d"
    jobs = [("1", copy_job(f"a, {deep}", ["x", "y"])), ("2", copy_job("a, b", ["x"])), ("3", copy_job("a", ["x"], "bare")),
            ("4", copy_job(deep, ["x"])), ("5", "not json"), ("6", copy_job("'a, (b', c", ["x", "y"]))]
    df = spark.createDataFrame([(i, j, "d") for i, j in jobs], "source_id string, json string, description string")
    assert rows(ln.copy_unparsed(df)) == [
        ("2", "column count differs"), ("3", "no qualified table"), ("4", "no bare column"), ("5", "not a query copy")]
    assert rows(ln.copy_edges(df, names), "source_id", "from_col", "to_col") == [("1", "a", "x"), ("6", "'a, (b'", "x"), ("6", "c", "y")]


def test_copy_edges_pair_by_position(spark, names):
    many = ", ".join(f"`c{i}`" for i in range(41)) + ",\n now() as etl_time"
    jobs = [
        ("1", copy_job(many, ["*"])), ("2", copy_job("a, b", ["x", "y"])), ("3", copy_job("a, b", ["x"])),
        ("4", copy_job("a, concat(b, ',', c) as d", ["x", "y"])), ("5", copy_job("a", ["x"], "unqualified")),
        ("6", copy_job("*", ["*"])), ("7", "not json"),
    ]
    df = spark.createDataFrame([(i, j, "d") for i, j in jobs], "source_id string, json string, description string")
    edges = ln.copy_edges(df, names)
    counts = {r.source_id: r["count"] for r in edges.groupBy("source_id").count().collect()}
    assert counts == {"1": 41, "2": 2, "4": 1, "6": 1}
    assert rows(edges.filter("source_id = '2'"), "from_fqn", "from_col", "to_fqn", "to_col") == [
        ("Test-MySQL.default.src.t", "a", "star.default.ods.o", "x"),
        ("Test-MySQL.default.src.t", "b", "star.default.ods.o", "y"),
    ]
    assert edges.filter("source_id = '6'").first().from_col is None


SCRIPT = """
-- two topics and a sink each, one job
CREATE TABLE `T_in` (
  `id` bigint NOT NULL COMMENT 'key: 1 (one)',
  PRIMARY KEY (`id`) NOT ENFORCED
--)WITH ( 'connector' = 'mysql-cdc',
--    'hostname' = 'old');
)WITH ( 'connector' = 'kafka',
    'topic' = 'ods_pay-uat',
    'properties.bootstrap.servers' = 'k3:9092,k2:9092,k1:9092',
    'format' = 'canal-json');\t\t

CREATE TABLE t_out (id bigint, etl_time timestamp)WITH( 'connector' = 'starrocks',
    'load-url'='star:8030',
    'database-name' = 'ods',
    'table-name' = 'pay');

CREATE TABLE m (id bigint) WITH ('connector'='mongodb-cdc','hosts'='h1:27017','database'='md','collection'='mc');
create table j (id bigint) with ('connector'='jdbc','url'='jdbc:mysql://db9/q','table-name'='jt');
create table bad (id bigint) with ('connector'='filesystem','path'='/x');

insert into t_out select *,LOCALTIMESTAMP as etl_time from T_in;
INSERT INTO j
SELECT Id AS key FROM `m`;
insert into j select a from elsewhere;
"""


def test_stream_edges(spark, names):
    df = spark.createDataFrame([("1", SCRIPT, "d")], "source_id string, script string, description string")
    assert rows(ln.stream_edges(df, names), "from_fqn", "from_col", "to_fqn", "to_col") == [
        ('"svc.b".default.md.mc', "id", "Test-MySQL.default.j.jt", "key"),
        ("uat.default.elsewhere.elsewhere", "a", "Test-MySQL.default.j.jt", "a"),
        ("uat.ods_pay-uat", None, "star.default.ods.pay", None),
    ]


def test_option_values_keep_their_commas(spark):
    df = spark.createDataFrame([(SCRIPT,)], "s string").withColumn("st", ln.script_statements(F.col("s")))
    declared = df.select(F.inline(ln.connector_tables("st"))).filter("name = 't_in'").first()
    assert {o["key"]: o["value"] for o in declared.options}["properties.bootstrap.servers"] == "k3:9092,k2:9092,k1:9092"
    located = df.withColumn("d", ln.connector_tables("st")).select(F.inline(ln.connector_locations("d")))
    assert [r.name for r in located.collect()] == ["t_in", "t_out", "m", "j"]


PROPERTIES = """# position
canal.instance.master.address=db9.local:3306
canal.instance.master.gtid=

# table regex
canal.instance.filter.regex=\\
h.a,\\
h.b,\\

# topics
canal.mq.dynamicTopic=\\
ods-h-a-test:h\\\\.a,\\
ods_h_b_test:h\\\\.b,\\

canal.mq.partition=0
#canal.mq.partitionHash=test.table:id^name,.*\\\\..*
"""


def test_topic_edges(spark, names):
    bare = PROPERTIES.replace("canal.instance.master.address=db9.local:3306\n", "")
    none = PROPERTIES.replace("dynamicTopic", "staticTopic")
    df = spark.createDataFrame(
        [("1", PROPERTIES, "d"), ("2", bare, "d"), ("3", none, "d")], "source_id string, text string, description string"
    )
    assert rows(ln.topic_edges(df, names), "source_id", "from_fqn", "to_fqn") == [
        ("1", "Test-MySQL.default.h.a", "bus.ods-h-a-test"), ("1", "Test-MySQL.default.h.b", "bus.ods_h_b_test"),
    ]


EDGE = "kind string, source_id string, description string, from_fqn string, from_col string, to_fqn string, to_col string"


def test_edges_collect_replace_and_check(spark):
    raw = [
        ("sql", "2", "later", "a", "x", "b", "y"), ("sql", "1", "first", "a", "x", "b", "y"),
        ("sql", "1", "first", "a", "w", "b", "v"), ("topic", "1", "t", "a", None, "c", None),
    ] * 50
    edges = ln.collect_edges(spark.createDataFrame(raw, EDGE).repartition(6))
    got = {(r.from_fqn, r.to_fqn): ([tuple(c) for c in r["columns"]], r.description) for r in edges.collect()}
    assert got == {("a", "b"): ([("w", "v"), ("x", "y")], "first"), ("a", "c"): ([], "t")}
    newer = ln.collect_edges(spark.createDataFrame([("sql", "3", "new", "a", "q", "b", "q")], EDGE))
    stored = {(r.from_fqn, r.to_fqn): [tuple(c) for c in r["columns"]] for r in ln.upsert_edges(edges, newer).collect()}
    assert stored == {("a", "b"): [("q", "q")], ("a", "c"): []}
    entities = spark.createDataFrame([("a",), ("b",)], "fqn string")
    assert rows(ln.check_entities(edges, entities), "to_fqn", "reason") == [("b", None), ("c", "target unknown")]
    assert rows(ln.known_edges(edges, entities), "to_fqn") == [("b",)]


def test_definition_readers(spark):
    import base64
    import json

    doc = json.dumps({"taskType": "SQL", "projectName": "p", "taskName": "t", "taskCode": 7, "userName": "u",
                      "processDefinitionName": "w", "taskParams": {"sql": "select 1", "datasource": 3}})
    task = task_rows(spark.createDataFrame([(doc,), ("broken",)], "value string")).collect()
    assert [(r.task_code, r.sql, r.datasource) for r in task] == [(7, "select 1", 3)]
    assert task[0].description == "kind: SQL\nproject: p\nworkflow: w\ntask: t\nowner: u"
    sources = spark.createDataFrame(
        [(1, '{"jdbcUrl":"jdbc:mysql://h/x"}'), (2, "{}"), (3, None)], "id int, connectionParams string"
    )
    assert rows(datasource_urls(sources)) == [(1, "jdbc:mysql://h/x")]
    encoded = base64.b64encode("insert 表".encode()).decode()
    jobs = spark.createDataFrame([(1, 1, encoded), (2, 2, encoded)], "app_id int, app_type int, flink_sql string")
    assert rows(stream_scripts(jobs)) == [(1, "insert 表")]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_definitions_of_one_file_are_read_in_many_tasks(spark, sf_dir):
    """The tables are files of one row group each."""
    for made in (plans._copy_jobs, plans._stream_scripts, plans._properties, plans._tasks):
        assert "RoundRobinPartitioning" in physical_plan(made(spark, sf_dir)), made.__name__
    for made in (plans._copy_jobs, plans._stream_scripts, plans._properties):
        assert made(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, made.__name__


def test_select_list_is_cut_out_once(spark):
    df = spark.createDataFrame([("select `a`, f(b, ')') as c, 'x, (y' from s.t",), ("no list",), (None,)], "q string")
    read = df.select(ln.select_items(F.col("q")).alias("i"))
    assert [r.i for r in read.collect()] == [["`a`", "f(b, ')') as c", "'x, (y'"], [], None]
    assert plan_of(read).count(ln.SELECTED) == 1


def test_copy_jobs_are_taken_apart_once(spark, names):
    """Their URLs are looked up without it; a job without edges asks as well, and changes nothing."""
    df = spark.createDataFrame([("1", copy_job("a, b", ["x", "y"]), "d"), ("2", copy_job("a, b", ["x"]), "d"), ("3", "not json", "d")],
                               "source_id string, json string, description string")
    edges = ln.copy_edges(df, names)
    assert plan_of(edges).count(ln.SELECTED) == 1
    assert rows(edges, "source_id", "from_col", "to_col") == [("1", "a", "x"), ("1", "b", "y")]


def test_topics_do_not_meet_in_one_task(spark, names):
    """The bus is the same for all instances, so their rows must not be shuffled by it."""
    text = "canal.instance.master.address=h1:3306\ncanal.mq.dynamicTopic=\\\nods-a:db.t,\n\n"
    edges = ln.topic_edges(spark.createDataFrame([("1", text, "d"), ("2", "a=b", "d")], "source_id string, text string, description string"), names)
    assert rows(edges, "source_id", "from_fqn", "to_fqn") == [("1", "svc-a.default.db.t", "bus.ods-a")]
    assert plan_of(edges).count("Join LeftOuter, (") == 1
    assert plan_of(edges).count(ln.TOPIC_BLOCK) == 1


def test_tasks_of_one_url_are_read_in_many_tasks(spark, names):
    """The lookup brings them together, and reading them is the long part."""
    sql = "insert into a.b select c from d.e"
    df = spark.createDataFrame([(k, sql, "jdbc:mysql://h1:3306/x", "d") for k in range(500)], "task_code int, sql string, jdbc_url string, description string")
    read = ln._read_tasks(df, names, None)
    assert {len(p) > 0 for p in read.select("target").rdd.glom().collect()} == {True}
    assert read.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {r.from_fqn for r in ln.sql_edges(df, names).collect()} == {"svc-a.default.d.e"}


def test_stream_scripts_are_taken_apart_once(spark, names):
    """Their URLs are those of the declared tables, used or not, and that of names without a table."""
    script = (
        "create table s (id bigint) with ('connector'='mysql-cdc', 'hostname'='h1', 'port'='3306', 'database-name'='d', 'table-name'='t');\n"
        "create table o (id bigint) with ('connector'='starrocks', 'load-url'='star:8030', 'database-name'='w', 'table-name'='p');\n"
        "insert into o select id from s;\ninsert into o select id from other;"
    )
    edges = ln.stream_edges(spark.createDataFrame([("1", script, "d"), ("2", None, "d")], "source_id string, script string, description string"), names)
    assert rows(edges, "from_fqn", "to_fqn") == [("svc-a.default.d.t", "star.default.w.p"), ("uat.default.other.other", "star.default.w.p")]
    assert plan_of(edges).count("overwrite)") == 1


def test_topic_reasons_are_not_found_before_the_rows_are_dealt_out(spark, sf_dir):
    plan = plan_of(ln.topic_unparsed(plans._properties(spark, sf_dir)))
    assert ln.ADDRESS not in plan[plan.index("Repartition"):]
