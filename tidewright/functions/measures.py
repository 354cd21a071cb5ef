"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1024 * 1024


def half_even(value: Column) -> Column:
    """Round half to even to a whole number, as C's ``%.0f`` does."""
    return F.bround(value, 0).cast("bigint")


def ratio_percent(current: Column, maximum: Column) -> Column:
    """``current / maximum`` in whole percent; NULL when the maximum is 0."""
    return half_even(F.try_divide(current.cast("double"), maximum.cast("double")) * 100)


def pages_to_gib(pages: Column) -> Column:
    """16 KiB buffer pages in whole GiB."""
    return half_even(pages * F.lit(16) / 1024 / 1024)


def allocated_mib(blocks: Column) -> Column:
    """8 KiB blocks in MiB."""
    return blocks * F.lit(8192) / F.lit(float(MIB))


def used_mib(rows: Column, row_bytes: Column) -> Column:
    return rows * row_bytes / F.lit(float(MIB))


def rounded(value: Column, digits: int) -> Column:
    """Half-up rounding on a decimal, so the last binary digit cannot tip it."""
    return F.round(value.cast("decimal(28,9)"), digits)


def percent_label(ratio: Column) -> Column:
    """A ratio as ``30.5%``, rounded to a tenth of a percent, without trailing zeros."""
    tenths = (F.round(ratio.cast("decimal(28,9)"), 3) * 1000).cast("bigint")
    whole, tenth = F.floor(tenths / 10), tenths % 10
    text = F.when(tenth == 0, whole.cast("string")).otherwise(
        F.concat(whole.cast("string"), F.lit("."), tenth.cast("string"))
    )
    return F.concat(text, F.lit("%"))


def seeded_fraction(seed: int, *parts: Column) -> Column:
    """A repeatable uniform number in [0, 1) from a seed and row values."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)
