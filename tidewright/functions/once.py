"""Keeping costly row expressions from being evaluated several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters read instead of recomputing.

    The optimizer moves a filter below the projection it reads by copying the expressions
    into it. Text parsing would then run once per mention. A generator of exactly one row
    is a place filters stop at.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)
