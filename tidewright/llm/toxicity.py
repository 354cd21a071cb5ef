"""Severity grades of documents by cumulative-link ordinal regression on sparse text features.

One weight vector is shared by all grades; ordered thresholds cut its score into grades:
P(grade > k) = sigmoid(score - threshold_k). The expected severity is the sum of these.
Features are hashed words and word beginnings with damped counts, over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.text import Words, mapped, portions, small_batches, utf8

DIMENSIONS = 1 << 18
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes
TRAINING_ROWS = 6000  # bound of the labelled sample the model is fitted on
REJECT_AT = 0.4  # expected severity; held-out labels of two splits: precision 0.96 and 0.98, recall 0.92

# A word here is a run of ASCII letters, digits and bytes beyond ASCII.
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[128:] = False
_OUTSIDE[[*range(48, 58), *range(97, 123)]] = False


@dataclass
class Model:
    """Weights by hashed feature and ascending thresholds between grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for every score and threshold."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.clip(x, -60, 60) / 2))


def features(texts: list[bytes], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows as (row, feature, value): log(1 + count), damped by the fourth root of the words."""
    words = Words(texts, _OUTSIDE)
    hashes, owner = [words.hashes], [words.owner]
    for n in BEGINNINGS:
        longer = words.ends - words.starts > n
        starts = words.starts[longer]
        hashes.append(words.spans.of(starts, starts + n) + np.uint64(n))
        owner.append(words.owner[longer])
    key = np.concatenate(owner) * dimensions + (np.concatenate(hashes) % np.uint64(dimensions)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    row = key // dimensions
    return row, (key % dimensions).astype(np.int32), np.log1p(count) / np.maximum(words.counts[row] / 100, 1) ** 0.25


def _prepared(text: str | None) -> bytes:
    return utf8((text or "").lower())


def fit(row, feature, value, grades: np.ndarray, n_grades: int, penalty: float = 1.5e-3, steps: int = 80, rate: float = 0.5) -> Model:
    """Proportional-odds likelihood by AdaGrad steps over all rows, with an L1 proximal step on the weights."""
    n, dimensions = len(grades), DIMENSIONS
    weights, moment = np.zeros(dimensions), np.full(dimensions, 1e-8)
    share = [(grades > k).mean() for k in range(n_grades - 1)]
    first = np.array([np.log((1 - p + 1e-3) / (p + 1e-3)) for p in share])
    # Thresholds are a first one and steps of at least zero, so they stay in order.
    thresholds, t_moment = np.maximum.accumulate(first + 1e-3 * np.arange(len(first))), np.full(len(first), 1e-8)
    edges = np.arange(n_grades - 1)
    for _ in range(steps):
        scores = np.bincount(row, value * weights[feature], minlength=n)
        above = _sigmoid(scores[:, None] - thresholds[None, :])
        full = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        upper, lower = full[at, grades], full[at, grades + 1]
        mass = np.maximum(upper - lower, 1e-9)
        d_upper, d_lower = upper * (1 - upper) / mass, lower * (1 - lower) / mass
        pull = -(d_upper - d_lower) / n
        grad = np.bincount(feature, value * pull[row], minlength=dimensions)
        moment += grad * grad
        step = rate / np.sqrt(moment)
        weights -= step * grad
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * penalty, 0)
        t_grad = np.array([(d_upper[grades == k + 1].sum() - d_lower[grades == k].sum()) / n for k in edges])
        t_moment += t_grad * t_grad
        thresholds = np.maximum.accumulate(thresholds - rate * t_grad / np.sqrt(t_moment))
    return Model(weights, thresholds)


def severity_grade(toxic: Column, quality: Column) -> Column:
    """0 for clean, 1 for toxic, 2 for toxic and of low quality; null without a toxic label."""
    return F.when(toxic == 0, 0).when(toxic == 1, F.when(quality == 0, 2).otherwise(1))


def train(docs: DataFrame, grades: DataFrame, n_grades: int, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``rows`` graded documents, the ones whose ids hash lowest.

    ``grades`` has ``doc_id`` and ``grade``. The sample's ids are broadcast (``rows`` of them at most);
    features are made by the tasks and the bounded sample is fitted on the driver. Rows without an
    id or a grade are left out; with no graded row every document scores severity 0.
    """
    sample = grades.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "_of")
    chosen = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_of"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text", 1 << 19):
            row, feature, value = features([_prepared(r["text"]) for r in part])
            cuts = np.searchsorted(row, np.arange(len(part) + 1))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([r["doc_id"] for r in part], pa.int64()),
                    "grade": pa.array([r["grade"] for r in part], pa.int32()),
                    "feature": pa.array([feature[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    "value": pa.array([value[a:b].astype(np.float32).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                }
            )

    # Repeated rows of one id would pass the bound; the first by content stands for them.
    made = chosen.mapInArrow(mapped(run), "doc_id long, grade int, feature binary, value binary")
    made = made.groupBy("doc_id").agg(F.min(F.struct("feature", "value", "grade")).alias("first")).select("doc_id", "first.*").toArrow().sort_by("doc_id")
    if not made.num_rows:
        return Model(np.zeros(DIMENSIONS), np.full(n_grades - 1, 60.0))
    grades_of = made["grade"].to_numpy().astype(np.int64)
    feature = np.frombuffer(b"".join(made["feature"].to_pylist()), np.int32)
    value = np.frombuffer(b"".join(made["value"].to_pylist()), np.float32)
    row = np.repeat(np.arange(len(grades_of), dtype=np.int32), [len(b) // 4 for b in made["feature"].to_pylist()])
    del made
    return fit(row, feature, value, grades_of, n_grades)


def severities(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """``docs`` with ``severity`` (expected grade), ``grade`` (most likely) and ``rejected``.

    The model is a fixed-size table of hashed weights and travels with the tasks. A null or empty text
    has no features; it scores what the thresholds alone say, which is clean. Rows are judged one by
    one, so null ids, repeated rows and other columns do not matter; columns of the new names are replaced.
    """
    spark, docs = docs.sparkSession, small_batches(docs).drop("severity", "grade", "rejected")
    used = np.flatnonzero(model.weights)
    shared = spark.sparkContext.broadcast((used.astype(np.int32), model.weights[used], model.thresholds))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, values, thresholds = shared.value
        weights = np.zeros(DIMENSIONS)
        weights[used] = values
        known = Model(weights, thresholds)
        for batch in batches:
            scores = [np.zeros(0)]
            for part in portions([batch.select([text_col])], text_col, 1 << 19):
                row, feature, value = features([_prepared(r[text_col]) for r in part])
                scores.append(np.bincount(row, value * weights[feature], minlength=len(part)))
            above = known.above(np.concatenate(scores))
            ends = np.ones((len(above), 1))
            mass = -np.diff(np.concatenate([ends, above, 0 * ends], axis=1))
            severity = np.round(above.sum(axis=1), 9)
            columns = [pa.array(severity), pa.array(mass.argmax(axis=1).astype(np.int32)), pa.array(severity >= reject_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "severity", "grade", "rejected"])

    return docs.mapInArrow(mapped(run), f"{fields}, severity double, grade int, rejected boolean")
