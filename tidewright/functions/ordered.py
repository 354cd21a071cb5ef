"""Ordered computations that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. The helpers here cut
every key into *segments*: a segment is any whole number that follows the order and bounds how many
rows share it (a log file's number, a day, ``id div width``). Work happens inside (key, segment). One
summary row per segment carries the result over the cuts, and those rows are themselves gathered
in groups of ``GROUP`` segments, so neither a hot key's rows nor its segments meet in one task. NULL is
a key and a segment like others; it comes first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows per segment where the segment is cut from a dense numeric position.
SEGMENT_ROWS = 65_536

# Segments gathered under one summary row.
GROUP = 1024


def _same(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """A join on columns where NULL equals NULL; the left side's columns stay."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in columns else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in columns]
    joined = left.join(renamed, reduce(lambda a, b: a & b, same), how)
    return joined.drop(*[f"_r_{c}" for c in columns])


def _grouped(segments: DataFrame) -> DataFrame:
    return segments.withColumn("_group", F.floor(F.col("_segment") / GROUP))


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], segment: Column
) -> DataFrame:
    """``lag`` of several columns: ``values`` maps a new column to its source column.

    Each key is windowed per segment, and the first row of a segment reads the last row of the
    segment before it, if need be of the group of segments before.
    """
    image = F.struct(*[F.col(src).alias(new) for new, src in values.items()])
    cut = df.withColumn("_segment", segment.cast("long"))
    inside = Window.partitionBy(*keys, "_segment").orderBy(*order)
    place = F.struct("_segment", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    last = _grouped(
        cut.groupBy(*keys, "_segment").agg(F.max_by(image, place).alias("_last"))
    )
    near = last.withColumn("_near", F.lag("_last").over(Window.partitionBy(*keys, "_group").orderBy("_segment")))
    far = last.groupBy(*keys, "_group").agg(F.max_by("_last", F.struct("_segment")).alias("_top"))
    far = far.withColumn("_far", F.lag("_top").over(Window.partitionBy(*keys).orderBy("_group"))).drop("_top")
    carried = _same(near, far, [*keys, "_group"]).select(
        *keys, "_segment", F.coalesce("_near", "_far").alias("_carry")
    )
    first = F.row_number().over(inside) == 1
    seen = cut.withColumn("_before", F.lag(image).over(inside)).withColumn("_first", first)
    joined = _same(seen, carried, [*keys, "_segment"])
    before = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_before"))
    return joined.withColumns({new: before[new] for new in values}).drop("_before", "_first", "_carry", "_segment")


def with_last(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], segment: Column, descending: bool = False
) -> DataFrame:
    """The last value that is not NULL at or before each row: ``values`` maps a new column to what it carries.

    With ``descending`` it is the next one at or after the row. Values are carried inside a segment; the last one of each
    segment reaches the rows of later segments that have none of their own, over groups of segments as above.
    """

    def ordered(columns: list[str]) -> list[Column]:
        return [F.col(c).desc() if descending else F.col(c).asc() for c in columns]

    def carried(column: str, window, end: int) -> Column:
        return F.last(column, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, end))

    def top(column: str, place: Column) -> Column:
        # Rows without a value have no place, so they are passed over.
        return (F.min_by if descending else F.max_by)(column, F.when(F.col(column).isNotNull(), place))

    names = list(values)
    cut = df.withColumns({**values, "_segment": segment.cast("long")})
    inside = Window.partitionBy(*keys, "_segment").orderBy(*ordered(order))
    place = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    last = _grouped(cut.groupBy(*keys, "_segment").agg(*[top(c, place).alias(c) for c in names]))
    within = Window.partitionBy(*keys, "_group").orderBy(*ordered(["_segment"]))
    near = last.select(*keys, "_segment", "_group", *[carried(c, within, -1).alias(f"_near_{c}") for c in names])
    far = last.groupBy(*keys, "_group").agg(*[top(c, F.struct("_segment")).alias(c) for c in names])
    over = Window.partitionBy(*keys).orderBy(*ordered(["_group"]))
    far = far.select(*keys, "_group", *[carried(c, over, -1).alias(f"_far_{c}") for c in names])
    before = _same(near, far, [*keys, "_group"])
    before = before.select(*keys, "_segment", *[F.coalesce(f"_near_{c}", f"_far_{c}").alias(f"_before_{c}") for c in names])
    seen = cut.withColumns({c: carried(c, inside, 0) for c in names})
    joined = _same(seen, before, [*keys, "_segment"])
    return joined.withColumns({c: F.coalesce(c, f"_before_{c}") for c in names}).drop("_segment", *[f"_before_{c}" for c in names])


def numbered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    segment: Column,
    name: str,
    descending: bool = False,
    total: str | None = None,
) -> DataFrame:
    """``row_number`` per key (or over everything with no keys) without one-task keys.

    Rows are numbered inside their segment; running sums over the counts of segments within
    their group, and over those of groups, give each segment its offset. ``total`` names an
    optional row count of the key.
    """

    def direction(col: str) -> Column:
        return F.col(col).desc() if descending else F.col(col).asc()

    def before(per: list[str], by: str):
        window = Window.partitionBy(*per).orderBy(direction(by))
        return window.rowsBetween(Window.unboundedPreceding, -1)

    cut = df.withColumn("_segment", segment.cast("long"))
    counts = _grouped(cut.groupBy(*keys, "_segment").agg(F.count("*").alias("_rows")))
    near = counts.withColumn("_near", F.coalesce(F.sum("_rows").over(before([*keys, "_group"], "_segment")), F.lit(0)))
    far = counts.groupBy(*keys, "_group").agg(F.sum("_rows").alias("_rows"))
    far = far.withColumn("_far", F.coalesce(F.sum("_rows").over(before(keys, "_group")), F.lit(0)))
    if total:
        far = far.withColumn(total, F.sum("_rows").over(Window.partitionBy(*keys)))
    offsets = _same(near.drop("_rows"), far.drop("_rows"), [*keys, "_group"])
    offsets = offsets.withColumn("_offset", F.col("_near") + F.col("_far")).drop("_near", "_far", "_group")
    inside = Window.partitionBy(*keys, "_segment").orderBy(*[direction(c) for c in order])
    placed = _same(cut.withColumn("_inside", F.row_number().over(inside)), offsets, [*keys, "_segment"])
    return placed.withColumn(name, F.col("_inside") + F.col("_offset")).drop("_inside", "_offset", "_segment")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key; the order must be total.

    ``max_by`` combines on the map side, so a hot key shuffles one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(top.alias("_top")).select(*keys, "_top.*")
