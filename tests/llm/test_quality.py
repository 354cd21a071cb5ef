import pytest

from tests.llm.brute import WORD
from tests.oracle import compare
from tidewright.llm import quality, queries


def by_hand(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, again, covered = {}, set(), set()
    for i in range(len(words) - 4):
        win = tuple(words[i : i + 5])
        again.add(win) if win in seen else seen.setdefault(win, i)
    for i in range(len(words) - 4):
        if tuple(words[i : i + 5]) in again:
            covered |= set(range(i, i + 5))
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


ODD = [None, "", "\n\n", "one", "a b c d e a b c d e", "x " * 7, "l\nl\nl\n \n", "ä # | é", "a b c d e f " * 3 + "tail", "w " * 30_000, "\x1c\x0b\x0c\r",
       "the house is in the garden and the dog of it is on a mat by an old tree", "A\nthe B\nthe B\n" * 4]


def test_counts(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(ODD)] + [(1, "a", 1), (1, "a", 1)], "doc_id long, text string, n_words int")
    got = quality.judged(docs).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == by_hand(r.text)
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    for r in queries.op5_quality(spark, sf_dir).collect():
        assert tuple(r)[1:7] == by_hand(texts[r.doc_id])


def test_oracle(spark):
    assert not compare(spark, "/root/testdata/sf0.01", "op5_quality", queries.op5_quality, queries.OP5_SQL)[0]


def test_labelled_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = queries.table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = queries.op5_quality(spark, sf_dir).join(labels, "doc_id").filter("NOT base_failed").select("quality", "kept").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.05 * len(junk)


def test_a_table_of_rules(spark):
    docs = spark.createDataFrame([(1, "the aa bb cc dd ee ff gg hh ii #")], "doc_id long, text string")
    rules = (quality.Rule("symbols", "n_symbols", "n_words", most=9), quality.Rule("stops", "n_stop_words", "n_words", least=9))
    assert quality.judged(docs, rules).first().failed_rules == ["symbols"]


@pytest.mark.parametrize("schema", ["doc_id long, text string"])
def test_empty_table_and_plan(spark, schema):
    out = quality.judged(spark.createDataFrame([], schema))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
