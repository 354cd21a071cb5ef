"""Whitening of embeddings by spectrum slicing.

Vectors become whole numbers, and each different vector counts once. Sums and covariance are
reduced on Spark in three levels; only the covariance, whose size is that of a vector squared, reaches the driver. There,
inertia counts of the shifted covariance (pivoted LDL^T) isolate each leading eigenvalue, Rayleigh
quotient iteration finds its vector with cubic convergence, and two more counts certify its number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.text import grouped, mapped
from tidewright.session import scratch_path

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
LARGEST = float(2**50)  # entries beyond stand at this bound
RANK = 1e-12  # eigenvalues below this part of the trace are rounding

_EPS = np.finfo(float).eps
_ALPHA = (1 + 17**0.5) / 8


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above ``shift``: the positive part of the inertia of
    ``matrix - shift * I``, by LDL^T with Bunch-Kaufman pivots."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, above = len(a), 0, 0

    def swap(i, j):
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        below = np.abs(a[k + 1 :, k])
        largest = below.max(initial=0.0)
        size = 1
        if abs(a[k, k]) < _ALPHA * largest:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            beside = row.max()
            if abs(a[k, k]) * beside < _ALPHA * largest**2:
                size = 1 if abs(a[r, r]) >= _ALPHA * beside else 2
                swap(k + size - 1, r)
        if size == 1:
            pivot = a[k, k]
            above += pivot > 0
            if pivot:
                column = a[k + 1 :, k].copy()
                a[k + 1 :, k + 1 :] -= np.outer(column / pivot, column)
        else:
            above += 1  # an indefinite pair
            columns = a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= columns @ np.linalg.solve(a[k : k + 2, k : k + 2], columns.T)
        k += size
    return int(above)


class _Slices:
    """Inertia counts by shift, and the interval that they leave for each eigenvalue."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.norm = max(np.abs(matrix).sum(axis=1).max(initial=0.0), np.finfo(float).tiny)
        self.least = 8 * _EPS * self.norm
        bound = self.norm * (1 + 1e-9)
        self.counts = {-bound: len(matrix), bound: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = eigenvalues_above(self.matrix, shift)
        return self.counts[shift]

    def interval(self, number: int) -> tuple[float, float]:
        """The known bounds of the eigenvalue with this number, from 1 by falling size."""
        return max(s for s, n in self.counts.items() if n >= number), min(s for s, n in self.counts.items() if n < number)

    def halve(self, number: int) -> None:
        low, high = self.interval(number)
        self.above((low + high) / 2)


def _solved(matrix: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """``(matrix - shift * I)^-1 right``; a shift that is an eigenvalue is moved by a rounding error."""
    identity = np.eye(len(matrix))
    step = _EPS * max(abs(shift), np.abs(matrix).max())
    for k in range(8):
        try:
            found = np.linalg.solve(matrix - (shift + k * step) * identity, right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all():
            return found
    return right


def _apart(vectors: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Unit columns, orthogonal to the columns of ``found`` and to each other."""
    for _ in range(2):
        vectors = vectors - found @ (found.T @ vectors)
        vectors = np.linalg.qr(vectors)[0]
    return vectors


def _single(slices: _Slices, number: int, found: np.ndarray) -> np.ndarray | None:
    """Vector of an isolated eigenvalue; none if the interval shrinks to rounding first."""
    matrix = slices.matrix
    start = np.random.default_rng(number).normal(size=(len(matrix), 1))
    while True:
        low, high = slices.interval(number)
        if high - low <= slices.least:
            return None
        vector = _apart(_solved(matrix, (low + high) / 2, _apart(start, found)), found)
        value, error = np.inf, np.inf
        for _ in range(12):
            value = (vector.T @ matrix @ vector).item()
            if not low < value < high:
                break
            now = np.linalg.norm(matrix @ vector - value * vector)
            if now >= error / 2 or now == 0:
                break
            error, best = now, vector
            vector = _apart(_solved(matrix, value, vector), found)
        if error <= 64 * _EPS * slices.norm:
            value = (best.T @ matrix @ best).item()
            margin = slices.least + 2 * error
            if slices.above(value - margin) >= number > slices.above(value + margin):
                return best
        slices.halve(number)


def leading(matrix: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues of a covariance, by falling size, and their unit vectors as columns.

    Eigenvalues that are rounding errors of the trace are left out. Equal eigenvalues get any orthonormal vectors.
    """
    slices = _Slices(matrix)
    found = np.zeros((len(matrix), 0))
    wanted = min(components, len(matrix), slices.above(RANK * max(np.trace(matrix), 0)))
    while found.shape[1] < wanted:
        number = found.shape[1] + 1
        low, high = slices.interval(number)
        together = slices.above(low) - slices.above(high)
        if together > 1 and high - low > slices.least:
            slices.halve(number)
            continue
        vectors = _single(slices, number, found) if together == 1 else None
        if vectors is None:
            # Equal to rounding: a basis of the common space, in the order of its own values.
            low, high = slices.interval(number)
            together = max(1, slices.above(low) - number + 1)
            vectors = _apart(np.random.default_rng(number).normal(size=(len(matrix), together)), found)
            for _ in range(4):
                vectors = _apart(_solved(matrix, (low + high) / 2, vectors), found)
            values, turn = np.linalg.eigh(vectors.T @ matrix @ vectors)
            vectors = vectors @ turn[:, ::-1]
        found = np.concatenate([found, vectors], axis=1)
    found = found[:, :wanted]
    return np.einsum("ij,ij->j", found, matrix @ found), found


@dataclass(frozen=True)
class Model:
    """What the vectors of one length are whitened by. ``sums`` are exact; ``axes`` has a column per component."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n`` for whole ``x``: the whole part of the mean goes first, so nothing is rounded off."""
        return (x - self.whole()).astype(float) - np.array([(s % self.n) / self.n for s in self.sums])

    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of ``(n * x - sums)^2``, exact; none where it passes 64 bits."""
        off = x - self.whole()
        rest = np.array([s % self.n for s in self.sums], np.int64)
        largest = np.abs(off).max(axis=1, initial=0).astype(float) + 1
        small = (largest * self.n) ** 2 * max(1, x.shape[1]) < 2.0**62
        out = [None] * len(x)
        part = self.n * off[small] - rest
        for at, value in zip(np.flatnonzero(small).tolist(), (part * part).sum(axis=1).tolist()):
            out[at] = value
        for at in np.flatnonzero(~small).tolist():
            value = sum((self.n * o - r) ** 2 for o, r in zip(off[at].tolist(), rest.tolist()))
            out[at] = value if value < 2**63 else None
        return out


def whole_numbers(vector: Column) -> Column:
    """``floor(64 * c) + 1000000`` of each entry; null if the vector or an entry is null or an entry not finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    scaled = F.transform(
        vector, lambda c: F.floor(F.greatest(F.least(c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST)) * SCALE).cast("long") + OFFSET
    )
    return F.when(fine, scaled)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the vectors of each length, and these as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    sizes, flat = np.diff(offsets), column.values.to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, flat[(offsets[at][:, None] + np.arange(size)).ravel()].reshape(len(at), size)


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """``{length: (n, exact sums)}`` of the different vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for at, x in _by_length(batch["x"]):
                old = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], np.int64)])
                old[0] += len(at)
                old[1] += (x >> 32).sum(axis=0)
                old[2] += (x & 0xFFFFFFFF).sum(axis=0)
        for size, (n, high, low) in found.items():
            yield pa.RecordBatch.from_pydict(
                {"size": pa.array([size], pa.int32()), "n": pa.array([n], pa.int64()), "sums": [[{"high": h, "low": s} for h, s in zip(high.tolist(), low.tolist())]]},
                pa.schema([("size", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.struct([("high", pa.int64()), ("low", pa.int64())])))]),
            )

    partial = fit.mapInArrow(mapped(run), "size int, n long, sums array<struct<high: long, low: long>>")
    each = partial.select("size", "n", F.posexplode("sums").alias("at", "sum"))
    wide = [F.sum(F.col(f"sum.{c}").cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    found: dict[int, dict] = {}
    for row in each.groupBy("size", "at").agg(F.sum("n").alias("n"), *wide).collect():
        found.setdefault(row["size"], {})[row["at"]] = (row["n"], (int(row["high"]) << 32) + int(row["low"]))
    return {size: (by_at[0][0], [by_at[k][1] for k in range(size)]) for size, by_at in found.items()}


def _products(fit: DataFrame, centred: dict) -> dict[int, np.ndarray]:
    """``{length: sum of the outer products of centred(x)}``, added up in groups of tasks, then groups of groups.

    Blocks of 64 rows of a matrix are added by themselves, so that wide vectors do not fill a task.
    """
    shared = fit.sparkSession.sparkContext.broadcast(centred)
    schema = pa.schema([("size", pa.int32()), ("block", pa.int32()), ("slot", pa.int32()), ("part", pa.list_(pa.float64()))])
    fields = "size int, block int, slot int, part array<double>"

    def table(rows: list[tuple]) -> pa.Table:
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows), schema.types)], schema=schema) if rows else schema.empty_table()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_length(batch["x"]):
                if x.shape[1] in shared.value:
                    y = shared.value[x.shape[1]](x)
                    total[x.shape[1]] = total.get(x.shape[1], 0.0) + y.T @ y
        task = TaskContext.get().partitionId()
        for size, matrix in total.items():
            yield from table([(size, k, task, matrix[k : k + 64].ravel()) for k in range(0, len(matrix), 64)]).to_batches()

    def add(parts: pa.Table) -> pa.Table:
        total = sum(values for _, values in _by_length(parts["part"]))
        return table([(parts["size"][0].as_py(), parts["block"][0].as_py(), parts["slot"][0].as_py(), total.sum(axis=0))] if parts.num_rows else [])

    parts = fit.mapInArrow(mapped(run), fields)
    for slots in (4096, 64, 1):
        parts = parts.withColumn("slot", F.pmod("slot", F.lit(slots))).groupBy("size", "block", "slot").applyInArrow(grouped(add), fields)
    found: dict[int, list] = {}
    for row in sorted(parts.collect(), key=lambda r: (r["size"], r["block"])):
        found.setdefault(row["size"], []).append(np.array(row["part"]))
    return {size: np.concatenate(blocks).reshape(-1, round(sum(map(len, blocks)) ** 0.5)) for size, blocks in found.items()}


def train(vectors: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each vector length, fitted on all different vectors of that length.

    Null vectors and such with a null or non-finite entry are left out, as are lengths whose vectors
    are all equal and vectors without entries, which have no components. The different vectors are written to the shared folder, as three passes
    read them. An empty table gives no model.
    """
    spark = vectors.sparkSession
    path = scratch_path(spark, "whitening")
    vectors.select(whole_numbers(F.col(vec_col)).alias("x")).filter("size(x) > 0").distinct().write.parquet(path)
    fit = spark.read.parquet(path)
    blank = {
        size: Model(n, sums, np.eye(size, 0), np.zeros(0), 0.0) for size, (n, sums) in _sums(fit).items()
    }
    models = {}
    for size, products in _products(fit, {size: m.centred for size, m in blank.items()}).items():
        old, covariance = blank[size], (products + products.T) / 2 / blank[size].n
        values, axes = leading(covariance, components)
        if len(values):
            models[size] = Model(old.n, old.sums, axes, values, float(np.trace(covariance)))
    for size, products in _products(fit, {size: m.whitened for size, m in models.items()}).items():
        old = models[size]
        error = float(np.abs(products / old.n - np.eye(len(products))).max())
        models[size] = Model(old.n, old.sums, old.axes, old.values, old.trace, error)
    return models


def whitened(vectors: DataFrame, models: dict[int, Model], vec_col: str = "embedding") -> DataFrame:
    """``vectors`` with ``n``, ``deviation``, ``identity_error`` and the arrays ``whitened`` and ``explained``.

    Rows without a usable vector or without a model for its length are dropped; all others stay,
    repeated ones too. The arrays have one entry for each component. ``deviation`` is null where it
    passes 64 bits. Columns of the new names are replaced, other columns are kept.
    """
    names = ["n", "deviation", "identity_error", "whitened", "explained"]
    kept = vectors.drop(*names, "_x").withColumn("_x", whole_numbers(F.col(vec_col)))
    kept = kept.filter(F.size("_x").isin(list(models)) if models else F.lit(False))
    shared = vectors.sparkSession.sparkContext.broadcast(models)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_x")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {c: [None] * batch.num_rows for c in names}
            for at, x in _by_length(batch["_x"]):
                model = shared.value[x.shape[1]]
                columns = [[model.n] * len(at), model.deviations(x), [model.identity_error] * len(at), list(model.whitened(x)), [model.values / model.trace] * len(at)]
                for name, column in zip(names, columns):
                    for k, value in zip(at.tolist(), column):
                        found[name][k] = value
            types = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            own = [c for c in batch.schema.names if c != "_x"]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in own), *(pa.array(found[c], t) for c, t in zip(names, types))], [*own, *names]
            )

    added = "n long, deviation long, identity_error double, whitened array<double>, explained array<double>"
    return kept.mapInArrow(mapped(run), f"{fields}, {added}")
