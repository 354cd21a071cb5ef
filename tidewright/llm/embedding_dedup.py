"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are drawn from a bounded sample. A vector is described by its nearest pivots
in order; inverted lists hold, for each pivot, the vectors that have it. Two vectors of one list
that share enough pivots are candidates and are verified by their cosine in double precision. Lists longer
than a block are dealt into tiles of two blocks, so no list is cut and no task holds a whole long one.

Among many pivots that lie close together the order says nothing. There, some pivots are centres: a vector
of the crowd belongs to the cell of its nearest centre and meets in it all vectors that may link with it by
the triangle inequality on angles, so no link of a crowd's vector is missed.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.graph import components
from tidewright.llm.text import grouped, mapped
from tidewright.session import settled_rows

THRESHOLD = 0.9
NEAREST = 8  # pivots in a description
SHARED = 2  # of them that a candidate pair has in common
BLOCK = 2048  # vectors on either side of a tile
MOST_PIVOTS = 16_384  # bound of the broadcast pivot table


def pivot_count(vectors: int) -> int:
    """Twice the root of the number of vectors: lists and pivots then grow alike."""
    return min(MOST_PIVOTS, max(32, 2 * math.isqrt(vectors)))


def plain(vectors: DataFrame, vector_col: str) -> Column:
    """The vector with zeros of one sign, so that equal vectors have equal bytes."""
    zero = F.lit(0).cast(vectors.schema[vector_col].dataType.elementType)
    return F.transform(vector_col, lambda x: F.when(x == 0, zero).otherwise(x))


def classes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """One row for each different usable vector: smallest id, number of rows, unit vector.

    Usable is a vector with an id, of finite components that are not all zero.
    """
    v = plain(vectors, vector_col)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).filter(F.col("vec_id").isNotNull() & good)
    return usable.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("rows"))


def _unit(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    v = lists.combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, width)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _cosine(angles: float, threshold: float) -> float:
    """Cosine of so many times the angle of the threshold."""
    return math.cos(min(math.pi, angles * math.acos(threshold)))


def centres(pivots: np.ndarray, nearest: int, threshold: float) -> np.ndarray:
    """Places of pivots that stand for the crowded ones: each of these is within the threshold of a centre.

    A pivot is crowded if more pivots than a description has lie within one and a half times the threshold's angle.
    """
    degree = np.concatenate([[0], *[(pivots[a : a + 512] @ pivots.T >= _cosine(1.5, threshold)).sum(axis=1) for a in range(0, len(pivots), 512)]])[1:]
    left = np.flatnonzero(degree > nearest)
    left = left[np.argsort(-degree[left], kind="stable")]
    out = []
    while len(left):
        out.append(left[0])
        left = left[1:][pivots[left[1:]] @ pivots[left[0]] < threshold]
    return np.array(out, np.int64)


def _described(pivots, nearest: int, threshold: float):
    """Rows (node, rows, vector, description, home, angle): the crowd's cell, -1 outside crowds, and the angle to its centre."""

    def run(batches):
        known, chosen = pivots.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            unit = _unit(table["vector"], known.shape[1])
            k = min(nearest, len(known))
            close = unit @ known.T
            order = np.argsort(-close, axis=1, kind="stable")[:, :k].astype(np.int32)
            described = pa.ListArray.from_arrays(pa.array(np.arange(0, len(unit) * k + 1, k), pa.int32()), pa.array(order.ravel()))
            home, angle = np.full(len(unit), -1, np.int32), np.zeros(len(unit))
            if len(chosen):
                home = close[:, chosen].argmax(axis=1).astype(np.int32)
                best = close[np.arange(len(unit)), chosen[home]]
                home[best < _cosine(2, threshold)] = -1
                angle = np.arccos(np.clip(best, -1, 1))
            yield pa.RecordBatch.from_arrays(
                [*[table[c].combine_chunks() for c in ("node", "rows", "vector")], described, pa.array(home), pa.array(angle)],
                ["node", "rows", "vector", "described", "home", "angle"],
            )

    return run


def _listed(pivots, radii: dict[int, float], threshold: float):
    """Rows of the inverted lists, and of the cells: numbered after the pivots, with all that may link with a vector of the cell."""

    def run(batches):
        known, chosen = pivots.value
        cells = np.array(sorted(radii), np.int64)
        reach = np.array([radii[c] for c in cells]) + math.acos(threshold) + 1e-6
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            described = table["described"].combine_chunks()
            order = described.flatten().to_numpy().reshape(table.num_rows, -1)
            outside = np.flatnonzero(table["home"].to_numpy() < 0)
            at, pivot = np.repeat(outside, order.shape[1]), order[outside].ravel()
            if len(cells):
                unit = _unit(table["vector"], known.shape[1])
                who, cell = np.nonzero(np.arccos(np.clip(unit @ known[chosen[cells]].T, -1, 1)) <= reach)
                at, pivot = np.concatenate([at, who]), np.concatenate([pivot, len(known) + cells[cell]])
            # A vector may be in many cells; a batch carries a bounded number of rows.
            for a in range(0, len(at), 8192):
                taken = pa.array(at[a : a + 8192])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pivot[a : a + 8192].astype(np.int32)), *[table[c].combine_chunks().take(taken) for c in ("node", "rows", "vector")], described.take(taken), table["home"].combine_chunks().take(taken)],
                    ["pivot", "node", "rows", "vector", "described", "home"],
                )

    return run


def _tile(threshold: float, shared: int, n_pivots: int):
    """Verified links of one tile: how many rows each node meets, and links that join what meets."""

    def run(table: pa.Table) -> pa.Table:
        out = {"node": [], "met": [], "other": []}
        width = len(table["vector"][0])
        pivot = table["pivot"][0].as_py()
        left = np.flatnonzero(table["left"].to_numpy(zero_copy_only=False))
        right = np.flatnonzero(table["right"].to_numpy(zero_copy_only=False))
        diagonal = table["i"][0].as_py() == table["j"][0].as_py()
        node, rows = table["node"].to_numpy(), table["rows"].to_numpy()
        unit = _unit(table["vector"], width)
        if pivot < n_pivots:
            described = table["described"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            # Pivots are renumbered in their order, so a description is a few words of bits.
            names, local = np.unique(described, return_inverse=True)
            local, here = local.reshape(described.shape), int(np.searchsorted(names, pivot))
            bits = np.zeros((len(node), len(names) // 64 + 1), np.uint64)
            for k in range(described.shape[1]):
                bits[np.arange(len(node)), local[:, k] >> 6] |= np.uint64(1) << (local[:, k] & 63).astype(np.uint64)
            # A pair belongs to the list of the smallest pivot it shares.
            below = bits[:, : (here >> 6) + 1].copy()
            below[:, here >> 6] &= (np.uint64(1) << np.uint64(here & 63)) - np.uint64(1)

            def candidates(rows_of, right):
                common = np.zeros((len(rows_of), len(right)), np.int8)
                earlier = np.zeros((len(rows_of), len(right)), bool)
                for w in range(bits.shape[1]):
                    common += np.bitwise_count(bits[rows_of, w][:, None] & bits[right, w][None, :]).astype(np.int8)
                for w in range(below.shape[1]):
                    earlier |= (below[rows_of, w][:, None] & below[right, w][None, :]) != 0
                return (common >= shared) & ~earlier

        else:
            home = table["home"].to_numpy().astype(np.int64)
            home[home < 0] = np.iinfo(np.int64).max

            def candidates(rows_of, right):
                # A pair belongs to the first cell that is home to one of the two.
                return np.minimum(home[rows_of][:, None], home[right][None, :]) == pivot - n_pivots

        met = np.zeros(len(node), np.int64)
        label = np.arange(len(node))
        for a in range(0, len(left), 256):
            rows_of = left[a : a + 256]
            found = candidates(rows_of, right)
            if diagonal:
                found &= rows_of[:, None] < right[None, :]
            found &= unit[rows_of] @ unit[right].T >= threshold
            met[rows_of] += found @ rows[right]
            met[right] += rows[rows_of] @ found
            for x in np.flatnonzero(found.any(axis=1)):
                p, near = rows_of[x], right[found[x]]
                for other in np.unique(label[near]):
                    if other != label[p]:
                        q = near[label[near] == other][0]
                        out["node"].append(int(node[p]))
                        out["met"].append(0)
                        out["other"].append(int(node[q]))
                        label[label == other] = label[p]
        for p in np.flatnonzero(met):
            out["node"].append(int(node[p]))
            out["met"].append(int(met[p]))
            out["other"].append(None)
        return pa.table({"node": pa.array(out["node"], pa.int64()), "met": pa.array(out["met"], pa.int64()), "other": pa.array(out["other"], pa.int64())})

    return run


def _linked(found: DataFrame, width: int, threshold: float, nearest: int, shared: int, block: int) -> DataFrame:
    """``(vector, rows, met, component)`` of the different vectors of one length, linked by pivots of their own."""
    spark = found.sparkSession
    total = found.count()
    n_pivots = pivot_count(total)
    sample = found.orderBy(F.xxhash64("node"), "node").limit(n_pivots).select("vector").toArrow()
    pivots = _unit(sample["vector"], width) if sample.num_rows else np.zeros((0, 1))
    chosen = centres(pivots, nearest, threshold)
    known = spark.sparkContext.broadcast((pivots, chosen))
    fields = f"node long, rows long, vector {found.schema['vector'].dataType.simpleString()}, described array<int>, home int"
    described = found.select("node", "rows", "vector").mapInArrow(mapped(_described(known, nearest, threshold)), f"{fields}, angle double")
    radii = {}
    if len(chosen):
        described = settled_rows(described)
        radii = {r.home: r.radius for r in described.filter("home >= 0").groupBy("home").agg(F.max("angle").alias("radius")).collect()}
    lists = described.mapInArrow(mapped(_listed(known, radii, threshold)), f"pivot int, {fields}")
    sizes = lists.groupBy("pivot").agg(F.count("*").alias("n"))
    dealt = lists.join(sizes, "pivot").withColumn("p", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("p")).cast("int")
    other = F.sequence(F.lit(0), F.col("p") - 1)
    tiles = F.transform(
        other, lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"), (own <= k).alias("left"), (own >= k).alias("right"))
    )
    tiled = dealt.select("pivot", "node", "rows", "vector", "described", "home", F.inline(tiles))
    # On the diagonal a vector stands on both sides.
    met = settled_rows(tiled.groupBy("pivot", "i", "j").applyInArrow(grouped(_tile(threshold, shared, len(pivots))), "node long, met long, other long"))
    counts = met.groupBy("node").agg(F.sum("met").alias("met"))
    groups = components(met.filter("other IS NOT NULL").select(F.col("node").alias("u"), F.col("other").alias("v")))
    return (
        found.join(counts, "node", "left")
        .join(groups, "node", "left")
        .select("vector", "rows", F.coalesce("met", F.lit(0)).alias("met"), F.coalesce("component", "node").alias("component"))
    )


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    nearest: int = NEAREST,
    shared: int = SHARED,
    block: int = BLOCK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row.

    Vectors link at a cosine of ``threshold`` or more. Rows with equal vectors are one class, linked with each
    other and counted by number. Null or zero vectors, vectors with null or non-finite components and
    rows with a null id link with nothing and are their own component; ``kept`` is false for a null id.
    Vectors of different length do not link; each length is compared by itself. Repeated rows are rows of their own with one id.
    """
    found = settled_rows(classes(vectors, id_col, vector_col))
    widths = [r.w for r in found.groupBy(F.size("vector").alias("w")).count().orderBy("w").collect()]
    parts = [_linked(found.filter(F.size("vector") == w), w, threshold, nearest, shared, block) for w in widths]
    nothing = found.select("vector", "rows", F.lit(0).cast("long").alias("met"), F.col("node").alias("component")).limit(0)
    named = reduce(lambda a, b: a.unionByName(b), parts, nothing)
    asked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), plain(vectors, vector_col).alias("asked"))
    out = asked.join(named, (F.col("asked") == F.col("vector")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.col("rows") - 1 + F.col("met"), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
