import random

import numpy as np
import pytest

from tests.llm import brute
from tidewright.llm import queries, substring


def check(spark, docs, window=13):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring.without_repeats(df, window).collect()}
    assert got == brute.cut(docs, window)


def test_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    want = brute.cut(docs)
    got = queries.op6_substring(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {
        i: (n, gone, brute.sha(text.encode())) for i, (n, gone, text) in want.items()
    }


@pytest.mark.parametrize("portion", [200, 3 << 20])
@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps(spark, monkeypatch, portion, seed):
    monkeypatch.setattr(substring, "PORTION", portion)
    rng = random.Random(seed)
    source = [f"w{i}" for i in range(400)]
    docs = {}
    for i in range(60):
        text = []
        for _ in range(rng.randrange(6)):
            a = rng.randrange(380)
            text += source[a : a + rng.randrange(5, 40)] + rng.choices("abc", k=rng.randrange(12))
        docs[rng.randrange(10**6) - 5000] = rng.choice([" ", "\n", "\t "]).join(text)
    check(spark, docs)


def test_small_window_and_few_words(spark):
    check(spark, {1: "a b c a b c", 2: "x a b c y", 3: "b c a", 4: "", 5: None, 6: "a a a a a a a"}, window=3)


def test_rows_of_one_id_do_not_cut_each_other(spark):
    line = " ".join(f"t{i}" for i in range(20))
    df = spark.createDataFrame([(4, line, 1), (4, line, 2), (None, line, 3), (9, "x " + line, 4), (9, None, 5)], "doc_id long, text string, n_words int")
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in substring.without_repeats(df).collect()), key=repr)
    assert got == sorted([(4, line, 0), (4, line, 0), (None, line, 0), (9, "x", 20), (9, "", 0)], key=repr)


def test_a_passage_all_documents_share(spark):
    line = " ".join(f"p{i}" for i in range(40))
    docs = {i: f"own{i} words{i} {line} tail{i}" for i in range(300)}
    check(spark, docs)


def test_empty_table(spark):
    assert substring.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_are_dealt_out_once(spark, sf_dir):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = queries.table(spark, sf_dir, "documents")
        plan = substring.without_repeats(docs)._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_groups_as_spark_counts_them(spark):
    ids = [0, 1, -1, 42, 2**63 - 1, -(2**63), 123456789]
    df = spark.createDataFrame([(i,) for i in ids], "i long").selectExpr("i", "pmod(xxhash64(i), 97) AS p")
    assert {r.i: r.p for r in df.collect()} == dict(zip(ids, substring.part_of(np.array(ids), 97).tolist()))
