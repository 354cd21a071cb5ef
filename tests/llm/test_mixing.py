import pytest

from tidewright.llm import mixing, queries


def test_whole_table_comes_near_its_targets(spark, sf_dir):
    rows = queries.op3_mix(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in queries.table(spark, sf_dir, "documents").collect()}
    assert len(rows) == len(docs)
    total, by = sum(r["size"] for r in rows), {}
    for r in rows:
        assert r.taken <= 3 * r["size"] and r["size"] == len(mixing_words(docs[r.doc_id].text))
        by.setdefault(docs[r.doc_id].source, []).append(r)
    assert sum(v[0].target for v in by.values()) == pytest.approx(total)
    for v in by.values():
        largest = max(r["size"] for r in v)
        assert abs(sum(r.taken for r in v) - v[0].target) <= largest
        assert v[0].target <= 3 * v[0].source_size


def mixing_words(text):
    from tests.llm.brute import WORD

    return WORD.findall(text or "")


def shares(sizes, weights=(5, 2, 1), ceiling=3):
    """Share out, hold what is above its ceiling, share the excess among the others, until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    held, total = {}, sum(sizes.values())
    while True:
        rest = {s for s in order if s not in held}
        left = total - sum(held.values())
        target = {s: w[s] * left / sum(w[x] for x in rest) for s in rest}
        over = {s: ceiling * sizes[s] for s in rest if target[s] > ceiling * sizes[s]}
        if not over:
            return target | held
        held |= over


@pytest.mark.parametrize(
    "sizes", [{"a": 10, "b": 1000, "c": 500}, {"a": 1, "b": 2, None: 900, "c": 0}, {"x": 5}, {None: 0}, {"a": 3, "b": 300, "c": 4000, "d": 2, "é": 70, "z": 9000}]
)
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(shares(sizes))


def test_nulls_ties_repeats_and_reruns(spark):
    rows = [(i % 7, "w " * (i % 5), "a" if i % 3 else None) for i in range(400)] + [(None, None, "b"), (1, "", ""), (1, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(map(tuple, mixing.mixed(docs.repartition(n)).collect()), key=repr) for n in (3, 8))
    assert one == two and len(one) == len(rows)
    taken = sum(r[1] * 0 + r[-2] for r in map(tuple, mixing.mixed(docs).select("doc_id", "size", "copies", "taken").collect()))
    assert mixing.mixture(docs).count() == taken
    assert mixing.mixture(docs).columns == docs.columns


def test_extra_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 5)], "doc_id long, text string, source string, size int")
    assert [r.taken for r in mixing.mixed(docs).collect()] == [2]
    assert mixing.mixture(docs).collect() == docs.collect()
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed(empty).count() == 0 and mixing.mixture(empty).count() == 0


def test_oracle(spark):
    from tests.oracle import compare

    assert not compare(spark, "/root/testdata/sf0.01", "op3_mix", queries.op3_mix, queries.OP3_SQL)[0]
