"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import settled_rows

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CEILING = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """``(source, source_size, weight, target)`` from the total size of each source.

    Sources take the weights in turn, in code point order with null last, and share the whole size by
    weight. A target stops at ``ceiling`` times its source's size and the excess goes to the others by
    weight until none is above: taken in order of size per weight, a source is held exactly
    when its share of what the sources before it left is above its ceiling. One row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn).cast("long"))
    rank = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    earlier = rank.rowsBetween(Window.unboundedPreceding, -1)
    later = rank.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    shared = weighted.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("source_size").over(earlier) * ceiling, F.lit(0))).alias("left"),
        F.sum("weight").over(later).alias("heavy"),
    )
    # Held: weight * left / heavy > ceiling * size, in whole numbers.
    held = F.col("weight") * F.col("left") > F.col("source_size") * ceiling * F.col("heavy")
    placed = shared.withColumn("at", F.row_number().over(rank))
    placed = placed.withColumn("start", F.min(F.when(~held, F.col("at"))).over(everything))
    at_start = F.max(F.when(F.col("at") == F.col("start"), F.struct("left", "heavy"))).over(everything)
    share = placed.withColumn("open", at_start)
    free = (F.col("weight") * F.col("open.left")).cast("double") / F.col("open.heavy").cast("double")
    target = F.when(F.col("at") < F.col("start"), (F.col("source_size") * ceiling).cast("double")).otherwise(free)
    return share.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def _offset(source: Column, seed: int) -> Column:
    """One random offset in [0, 1) for each source, a multiple of 1/65536, the same on every run."""
    key = F.concat(F.lit(str(seed)), F.coalesce(F.concat(F.lit(":"), source), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("double") / 65536


def _ranked(rows: DataFrame) -> DataFrame:
    """``rank`` of each row of (doc_id, source, size) within its source, by size and id.

    A range shuffle deals the sorted rows out evenly, whatever a source holds; a row's place is its
    place in the partition plus the rows of the partitions before. The sorted rows are written
    down once, so places and partition counts come from the same shuffle.
    """
    dealt = rows.repartitionByRange("source", "size", "doc_id").sortWithinPartitions("source", "size", "doc_id")
    place = F.monotonically_increasing_id()
    dealt = dealt.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    dealt = settled_rows(dealt)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    first = dealt.groupBy("source", "part").agg(F.min("place").alias("place")).join(parts, "part")
    first = first.groupBy("source").agg(F.min(F.col("base") + F.col("place")).alias("first")).withColumnRenamed("source", "of")
    placed = dealt.join(parts, "part").join(first, F.col("source").eqNullSafe(F.col("of")))
    return placed.select("doc_id", "source", "size", *[c for c in rows.columns if c not in ("doc_id", "source", "size")],
                         (F.col("base") + F.col("place") - F.col("first") + 1).alias("rank"))


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    ceiling: int = CEILING,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Column | None = None,
) -> DataFrame:
    """Every row with its ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` words.

    A document's expected copies are target / source_size, at most ``ceiling``. Within the source, sorted by
    size and id, they are summed up, one random offset is added, and a copy is taken for each
    whole number passed. Sorting by size keeps the taken words within about one large document of the
    target. A null source is a source of its own, null and empty texts have size 0, a source of
    size 0 has target 0 and gives no copy. Repeated rows are ranked as rows of their own. The result
    depends only on the rows, the weights and the seed.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       word_count(F.col(text_col)).alias("size"), *([carry.alias("carried")] if carry is not None else []))
    slim = settled_rows(slim)
    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, ceiling)
    targets = targets.withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = _offset(F.col("source"), seed)
    passed = F.floor(F.col("rank") * F.col("rate") + offset) - F.floor((F.col("rank") - 1) * F.col("rate") + offset)
    out = _ranked(slim).join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate)
    out = out.withColumn("copies", F.least(passed, F.lit(ceiling)).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("of", "rate", "rank", "weight")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` themselves, each as often as the mix takes it.

    Decisions are made on narrow rows and brought back to the texts by id and row hash; rows that
    are equal in every column share their copies.
    """
    row = F.xxhash64(*docs.columns)
    taken = mixed(docs, carry=row, **options).groupBy(F.col("doc_id").alias("_id"), F.col("carried").alias("_row"))
    taken = taken.agg(F.sum("copies").alias("_copies")).filter("_copies > 0")
    id_col = options.get("id_col", "doc_id")
    once = docs.withColumn("_hash", row).dropDuplicates([id_col, "_hash"])
    back = once.join(taken, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_row")))
    return back.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")
