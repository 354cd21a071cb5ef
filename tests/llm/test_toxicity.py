import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewright.llm import queries, toxicity


def corpus(n, seed):
    """Four grades by how much of two word lists a text has."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        grade = rng.choice([0, 0, 0, 1, 2, 3])
        words = [f"plain{rng.randrange(300)}" for _ in range(rng.randrange(30, 120))]
        words += rng.choices(["vile", "nasty", "rotten"], k=3 * grade)
        rng.shuffle(words)
        rows.append((i, " ".join(words), grade))
    return rows


def test_held_out_grades_are_ordered(spark):
    rows = corpus(1500, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    graded = docs.filter("doc_id < 1000").selectExpr("doc_id", "truth AS grade")
    model = toxicity.train(docs, graded, 4)
    assert list(model.thresholds) == sorted(model.thresholds)
    out = toxicity.severities(docs.filter("doc_id >= 1000"), model).collect()
    means = [np.mean([r.severity for r in out if r.truth == g]) for g in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 1.5
    assert np.mean([abs(r.severity - r.truth) < 0.8 for r in out]) > 0.85


def test_gradient_raises_the_likelihood():
    rows = corpus(400, 2)
    row, feature, value = toxicity.features([t.encode() for _, t, _ in rows])
    grades = np.array([g for _, _, g in rows])

    def likelihood(model):
        scores = np.bincount(row, value * model.weights[feature], minlength=len(grades))
        full = np.concatenate([np.ones((len(grades), 1)), model.above(scores), np.zeros((len(grades), 1))], axis=1)
        at = np.arange(len(grades))
        return np.log(full[at, grades] - full[at, grades + 1]).mean()

    few, many = (likelihood(toxicity.fit(row, feature, value, grades, 4, steps=n)) for n in (2, 60))
    assert many > few + 0.3


def test_held_out_labels_of_the_table(spark):
    docs = queries.table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    labels = queries.table(spark, "/root/testdata/sf0.1", "labels")
    graded = labels.filter("doc_id % 4 != 1").select("doc_id", toxicity.severity_grade(labels.toxic, labels.quality).alias("grade"))
    model = toxicity.train(docs, graded, 3)
    held = labels.filter("doc_id % 4 = 1").join(docs, "doc_id")
    out = toxicity.severities(held, model).select("toxic", "rejected").collect()
    caught = sum(r.rejected and r.toxic for r in out)
    assert caught >= 0.85 * sum(r.toxic for r in out)
    assert caught >= 0.97 * sum(r.rejected for r in out)


def test_one_row_of_an_id_reaches_the_driver(spark, monkeypatch):
    rows = corpus(60, 4)
    docs = spark.createDataFrame([*rows, *[(7, f"{t} {i}", g) for i, t, g in corpus(300, 5)]], "doc_id long, text string, truth int")
    graded = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int")
    seen, whole = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: seen.append(whole(self)) or seen[-1])
    one = toxicity.train(docs, graded, 4)
    assert sum(t.num_rows for t in seen) == 60
    two = toxicity.train(docs.repartition(5, "text"), graded, 4)
    assert (one.weights == two.weights).all() and (one.thresholds == two.thresholds).all()


def test_nulls_repeats_and_clashing_columns(spark):
    rows = corpus(200, 3)
    docs = spark.createDataFrame([*rows, (None, None, None), (7, "", 0), (7, "", 0), (8, "x" * 100_000 + " vile" * 50_000, 1)], "doc_id long, text string, feature int")
    graded = docs.selectExpr("doc_id", "feature AS grade").union(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, grade int"))
    model = toxicity.train(docs.select("doc_id", "text"), graded, 4)
    out = toxicity.severities(docs, model)
    assert out.count() == 204 and out.filter("severity IS NULL").count() == 0
    assert out.columns == ["doc_id", "text", "feature", "severity", "grade", "rejected"]


@pytest.mark.parametrize("grades", ["doc_id long, grade int"])
def test_empty_tables(spark, grades):
    docs = spark.createDataFrame([(1, "vile words")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], grades), 3)
    assert [r.rejected for r in toxicity.severities(docs, model).collect()] == [False]
    assert toxicity.severities(docs.limit(0), model).count() == 0


def test_scores_equal_a_plain_scorer(spark):
    """Every row scored word by word in Python: counts, damping, thresholds and the most likely grade."""
    rng = np.random.default_rng(5)
    model = toxicity.Model(np.where(rng.random(toxicity.DIMENSIONS) < 0.5, rng.normal(0, 0.3, toxicity.DIMENSIONS), 0), np.array([-0.5, 0.4, 1.3]))
    hashes = {}

    def hashed(piece):
        if piece not in hashes:
            hashes[piece] = int(toxicity.Words([piece], toxicity._OUTSIDE).hashes[0])
        return hashes[piece]

    def by_hand(text):
        words = re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").lower().encode())
        pieces = [hashed(w) for w in words] + [(hashed(w[:n]) + n) % 2**64 for w in words for n in toxicity.BEGINNINGS if len(w) > n]
        counts = Counter(p % toxicity.DIMENSIONS for p in pieces)
        score = sum(math.log(1 + c) / max(len(words) / 100, 1) ** 0.25 * model.weights[f] for f, c in counts.items())
        above = [1.0, *(1 / (1 + math.exp(t - score)) for t in model.thresholds), 0.0]
        masses = [a - b for a, b in zip(above, above[1:])]
        return sum(above[1:-1]), masses.index(max(masses))

    texts = [t for _, t, _ in corpus(150, 9)] + [None, "", "...", "Ünï çödé wörds", "a", "one " * 3_000, "Mixed-CASE, words_and 12345 ciphers!" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = toxicity.severities(docs, model).collect()
    assert len(out) == len(texts)
    for r in out:
        severity, grade = by_hand(r.text)
        assert r.severity == pytest.approx(severity, abs=1e-8) and r.grade == grade and r.rejected == (r.severity >= toxicity.REJECT_AT)
    assert len({r.grade for r in out}) > 1
