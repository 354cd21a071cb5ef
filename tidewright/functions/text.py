"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def pieces(text: Column, delimiter: str) -> Column:
    """Split on a literal delimiter; empty pieces are NULL, NULL text is one NULL piece."""
    cut = F.split(text, "\\Q" + delimiter + "\\E", -1)
    blank_as_null = F.transform(cut, lambda x: F.nullif(x, F.lit("")))
    return F.when(text.isNull(), F.array(F.lit(None).cast("string"))).otherwise(blank_as_null)


def host_part(address: Column) -> Column:
    """``host`` of ``host:port``; empty without a colon."""
    return F.when(address.contains(":"), F.substring_index(address, ":", 1)).otherwise(F.lit(""))


def port_part(address: Column) -> Column:
    """Everything after the first colon; the whole text without one."""
    after = F.substr(address, F.instr(address, ":") + F.lit(1))
    return F.when(address.contains(":"), after).otherwise(address)


def version_prefix(version: Column) -> Column:
    """``8.0`` of ``8.0.36``."""
    return F.substring_index(version, ".", 2)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds of a zone-less timestamp, whatever the session zone is."""
    return F.timestamp_diff("SECOND", F.expr(EPOCH), ts)


def clock_in_zone(epoch: Column, zone: str) -> Column:
    """Epoch seconds as ``yyyy-MM-dd HH:mm:ss`` in a named zone."""
    utc = F.timestamp_add("SECOND", epoch, F.expr(EPOCH))
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc), "yyyy-MM-dd HH:mm:ss")


# Fixed value: the longest time a TIME value holds, 838:59:59.
LONGEST_CLOCK = 838 * 3600 + 59 * 60 + 59


def clock_text(seconds: Column) -> Column:
    """Seconds as ``HH:MM:SS``, held to the range of a TIME value."""
    held = F.least(F.abs(seconds), F.lit(LONGEST_CLOCK))
    hours = F.floor(held / 3600)
    minutes = F.floor((held - hours * 3600) / 60)
    text = F.format_string("%02d:%02d:%02d", hours, minutes, held - hours * 3600 - minutes * 60)
    return F.when(seconds < 0, F.concat(F.lit("-"), text)).when(seconds >= 0, text)


def log_number(log_file: str) -> Column:
    """The number a log file's name ends in; names count up in it, whatever their width."""
    return F.coalesce(F.regexp_extract(log_file, r"(\d+)$", 1).try_cast("bigint"), F.lit(0))


# The numeric column types, whose values stand bare in SQL text; all others are quoted.
BARE_TYPES = [
    "tinyint", "smallint", "mediumint", "int", "integer", "bigint", "decimal", "dec", "numeric", "fixed",
    "float", "double", "real", "year", "bool", "boolean",
]

