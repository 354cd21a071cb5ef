import math

import numpy as np
import pytest

from tidewright.llm import queries, whitening


@pytest.mark.parametrize("kind", ["spread", "equal values", "one value", "nearly equal", "low rank"])
def test_leading_pairs_are_those_of_the_covariance(kind):
    rng = np.random.default_rng(3)
    d, turn = 40, np.linalg.qr(rng.normal(size=(40, 40)))[0]
    values = {
        "spread": rng.uniform(0, 9, d),
        "equal values": np.repeat([9.0, 5, 5, 1], d // 4),
        "one value": np.full(d, 3.0),
        "nearly equal": 10 - np.arange(d) * 1e-12,
        "low rank": np.append(np.zeros(d - 7), rng.uniform(1, 2, 7)),
    }[kind]
    matrix = turn @ np.diag(values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, axes = whitening.leading(matrix)
    assert len(found) == (7 if kind == "low rank" else 16)
    assert np.allclose(found, np.sort(values)[::-1][: len(found)], atol=1e-12)
    assert np.abs(matrix @ axes - axes * found).max() < 1e-12 and np.abs(axes.T @ axes - np.eye(len(found))).max() < 1e-12


def test_counts_are_those_of_all_eigenvalues():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = rng.normal(size=(rng.integers(1, 12),) * 2)
        a = np.round(a + a.T) if rng.random() < 0.3 else a + a.T
        shift = rng.normal()
        assert whitening.eigenvalues_above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()


def plain(rows, components=16):
    """``{vec_id: (n, deviation, whitened)}`` with whole Python numbers and a dense solver."""
    kept = {i: [math.floor(64 * c) + 1000000 for c in v] for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted({tuple(x) for x in kept.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    out = {}
    for i, x in kept.items():
        off = [n * c - s for c, s in zip(x, sums)]
        out[i] = (n, sum(o * o for o in off), np.array([o / n for o in off]) @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n))
    return out


def test_rows_are_those_of_a_plain_version(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=20) * rng.uniform(0.1, 2, 20)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(150)]  # a third of all rows is one vector
    rows += [(900, None), (901, [None] + [1.0] * 19), (902, [math.nan] * 20), (903, [math.inf] * 20), (None, rows[1][1]), (904, [])]
    df = spark.createDataFrame([(i, v, 7, 8) for i, v in rows], "vec_id long, embedding array<double>, n int, whitened int")
    got = whitening.whitened(df, whitening.train(df)).collect()
    want = plain(rows)
    assert {r.vec_id for r in got} == set(want) and len(got) == 451
    axes = {}
    for r in got:
        n, deviation, white, explained = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-9
        assert np.allclose(np.abs(r.whitened), np.abs(white), atol=1e-8) and np.allclose(r.explained, explained, rtol=1e-9)
        for k, (a, b) in enumerate(zip(r.whitened, white)):
            if abs(b) > 1e-3:
                axes.setdefault(k, set()).add(a * b > 0)
    assert all(len(signs) == 1 for signs in axes.values())  # one sign of an axis for all rows


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = spark.createDataFrame(rows, schema)
        assert whitening.whitened(df, whitening.train(df)).collect() == []
    # Lengths are whitened by themselves; entries beyond the bound stand at it.
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 1.0]), (3, [5.0]), (4, [9.0]), (5, [1e30]), (6, [9.0])], schema)
    out = {r.vec_id: r for r in whitening.whitened(df, whitening.train(df)).collect()}
    assert (out[1].n, out[1].deviation, [abs(x) for x in out[1].whitened]) == (2, 192**2, [1.0])
    assert out[3].n == 3 and out[5].deviation is None and out[4].whitened == out[6].whitened


def test_query_covers_the_table(spark, sf_dir):
    vectors = queries.table(spark, sf_dir, "embeddings")
    out = queries.op11_whitening(spark, sf_dir).toPandas()
    assert len(out) == vectors.count() * 16 and set(out.component) == set(range(1, 17))
    assert (out.identity_error < 1e-4).all() and out.identity_error.nunique() == 1
    values = out.groupby("component").explained.first()
    assert (values.diff().dropna() <= 0).all() and 0 < values.sum() <= 1
