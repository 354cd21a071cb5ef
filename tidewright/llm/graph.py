"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import settled_rows


def _to_smallest(pairs: DataFrame) -> DataFrame:
    """Each row ``(u, v)`` with the smallest of u and all its v as ``m``.

    The minimum combines before the shuffle and the join's other side has one row per u, so
    a node with very many links is a skewed join that adaptive execution splits.
    """
    smallest = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(smallest, "u").withColumn("m", F.least("u", "m"))


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``links`` (columns ``u``, ``v``); component is its smallest node.

    Alternates the large-star and the small-star step until the links no longer change, which
    takes about log(n) rounds whatever the shape. Each round's links are written to the shared
    checkpoint folder, so a lost executor costs one round at most. Loops, repeated links, either
    direction and an empty table are fine; a link with a null end is ignored.
    """
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = settled_rows(links.filter("u != v").distinct())

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    before = mark(links)
    while before[0]:
        both = links.union(links.select("v", "u"))
        large = _to_smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _to_smallest(large.distinct())
        small = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", "m")
        )
        links = settled_rows(small.distinct())
        after = mark(links)
        if after == before:
            break
        before = after
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(links.select("v", "v").distinct())
