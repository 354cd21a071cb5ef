import random

import numpy as np
import pytest

from tests.llm import brute
from tidewright.llm import embedding_dedup, queries


def by_hand(rows, threshold=0.9):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    usable = []
    for i, v in rows:
        good = i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        usable.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if good else None)

    def linked(a, b):
        return usable[a] is not None and usable[b] is not None and usable[a] @ usable[b] >= threshold

    ids = [i if i is not None else 0 for i, _ in rows]
    groups = brute.groups(ids, linked)
    out = []
    for k, (i, _) in enumerate(rows):
        n = sum(linked(k, j) for j in range(len(rows)) if j != k)
        out.append((i, n, groups[k] if i is not None else None, i is not None and i == groups[k]))
    return out


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, sf_dir, "embeddings").collect()]
    got = sorted(map(tuple, queries.op2_embeddings(spark, sf_dir).collect()))
    assert got == sorted(by_hand(rows))


def planted(n, seed, width=64):
    """Random vectors, near copies at many cosines from 0.88 up, a crowd of near copies and equal vectors."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = list(base)
    for v in base[: n // 3]:
        other = rng.normal(size=width)
        other -= other @ v * v
        other /= np.linalg.norm(other)
        c = rng.uniform(0.88, 0.9999)
        rows.append(c * v + np.sqrt(1 - c * c) * other)
    rows += [base[0] + rng.normal(scale=0.01, size=width) for _ in range(150)] + [base[1]] * 40
    random.Random(seed).shuffle(rows)
    return [(i * 3, [float(x) for x in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("block", [64, 2048])
def test_recall_of_links(spark, block):
    rows = planted(900, 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block=block).collect()}
    want = by_hand(rows)
    assert all(got[i].n_links <= n for i, n, _, _ in want)
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(n for _, n, _, _ in want)
    single = [(i, n) for i, n, _, _ in want if n == 1]
    assert sum(got[i].n_links for i, _ in single) >= 0.93 * len(single)


@pytest.mark.parametrize("cosine", [0.95, 0.985])
def test_no_link_of_a_large_group_is_lost(spark, cosine):
    """A third of the vectors lie so near to one of them; their links are counted by all pairs."""
    rng = np.random.default_rng(11)
    unit = rng.normal(size=(10_200, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    group, centre = slice(1, 3401), unit[0]
    side = unit[group] - np.outer(unit[group] @ centre, centre)
    unit[group] = cosine * centre + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = np.concatenate([(unit[a : a + 600] @ unit.T >= 0.9).sum(axis=1) - 1 for a in range(0, len(unit), 600)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert [got[i].n_links for i in range(len(unit))] == want.tolist()
    assert {got[i].component_id for i in range(3401) if want[i]} == {0}


def test_odd_vectors_repeats_and_clashing_columns(spark):
    one = [1.0, 0.0, 2.0]
    rows = [(5, one), (2, [2.0, 0.0, 4.0]), (9, [1.0, -0.0, 2.0]), (9, one), (None, one), (1, None), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 1.0]),
            (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (8, [0.0, 1.0, 0.0]), (10, [1e300, 0.0, 2e300]), (11, [1e-300, 0.0, 2e-300])]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<double>, node int, rows int")
    scaled = [(i, None if v is None else [x and x / 1e300 if abs(x or 0) > 1e200 else x and x * 1e300 if abs(x or 1) < 1e-200 else x for x in v]) for i, v in rows]
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=repr)
    assert got == sorted(by_hand(scaled), key=repr)


def test_other_lengths_link_with_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0]), (4, [])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_each_length_is_compared_with_itself(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=3).tolist()) for k in range(20)] + [(30, [1.0, 2.0]), (31, [1.0, 2.0]), (32, [2.0, 4.1]), (33, [-1.0, 2.0]), (34, [5.0]), (35, [-5.0]), (36, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert {k: v for k, v in out.items() if k >= 30} == {30: (2, 30), 31: (2, 30), 32: (2, 30), 33: (0, 33), 34: (1, 34), 35: (0, 35), 36: (1, 34)}
    assert len(out) == len(rows)


def test_empty_table(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
