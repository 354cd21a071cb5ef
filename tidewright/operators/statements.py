"""INSERT … SELECT statements taken apart with expressions over their text, all inside the statement's row.

Read are a target with an optional partition and column list, the arms of a set operation (in parentheses or not), select
items, and FROM/JOIN sources with aliases. A dictionary of columns by table, joined to the sources, spells out ``*``
and finds the source of a column that has no qualifier. Statements and items that are not understood carry a reason.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.once import bound, settled

# Stand-in for a quoted string, and for the characters that text is cut at where they stand in
# parentheses or quotes: ``( ) ,`` and blanks.
QUOTE = "\u0002"
CUTTING, SHIELDS = "(), \n\t", "\u0003\u0004\u0005\u0006\u0007\u000e"
GROUP = "\u0001"  # between the groups of one match

# How a statement is taken apart: a name, one select item (qualifier, column, alias), an
# INSERT (target, partition, column list, rest), the item list against FROM, one source with its alias.
NAME = r"[\p{L}_$][\p{L}\p{N}_$\-]*"
ITEM = (
    rf"(?i)^(?:({NAME}(?:\.{NAME})*)\.)?([\p{{L}}_$][\p{{L}}\p{{N}}_$]*|\*)"
    r"(?:\s+(?:as\s+)?([\p{L}\p{N}_$]+))?$"
)
INSERT = (
    r"(?i)^insert\s+(?:into|overwrite)\s+(?:table\s+)?([^\s(),;]+)\s*(?:partition\s*\(([^()]*)\)\s*)?"
    r"(?:\((?!\s*(?:\(|select\b))([^()]*)\)\s*)?((?:\(\s*)*\bselect\s+.*)$"
)
LIST_AND_FROM = r"(?i)^select\s+(?:distinct\s+|all\s+)?(.*?)\s+from\s+(.*)$"
SET_OPERATION = rf"(?i)\s*\b(?:union|intersect|except)(?:\s+(?:all|distinct))?(?:\s+(?=select\s)|\s*(?={SHIELDS[0]}))"
IN_PARENTHESES = rf"(?i)^{SHIELDS[0]}([^{SHIELDS[1]}]*(?:{SHIELDS[1]}(?!$)[^{SHIELDS[1]}]*)*){SHIELDS[1]}$"
NESTED = rf"(?i){SHIELDS[0]}[{SHIELDS[3:]} ]*select\b"
# The name a computed item is given: after AS, or after its closing parenthesis.
COMPUTED = rf"(?is)^(.+?)(?:\s+as\s+|(?<={SHIELDS[1]})\s*(?=[\p{{L}}_$]))([\p{{L}}_$][\p{{L}}\p{{N}}_$]*)$"
# A column in a computed item: a name that is no function and no part of another name.
WORD = r"[\p{L}_$][\p{L}\p{N}_$]*+"
COLUMN = rf"(?<![\p{{L}}\p{{N}}_$.\u0002])((?:{WORD}\.)*+{WORD})(?!\s*\()"
AFTER_SOURCES = r"(?i)\s(?:where|group\s+by|order\s+by|having|limit|window)\b.*$"
SOURCE = (
    r"(?i)(?:\bfrom\s+|\bjoin\s+|,\s*)([^\s,()]+)"
    r"(?:\s+(?:as\s+)?(?!(?:on|left|right|inner|outer|full|cross|join|natural|using|lateral)\b)([^\s,()]+))?"
)

# Bare words that are values, not columns.
VALUE_WORDS = [
    "null", "true", "false", "current_date", "current_time", "current_timestamp",
    "localtime", "localtimestamp", "sysdate",
]

# Words that no column is called without quotes.
RESERVED_WORDS = [
    "case", "when", "then", "else", "end", "and", "or", "xor", "not", "in", "is", "like", "rlike", "regexp", "between",
    "exists", "distinct", "all", "as", "div", "mod", "over", "partition", "by", "order", "asc", "desc", "from", "for",
    "using", "where", "group", "binary",
]

# What else is no column, by its place: types, units, frames and modifiers. A column may be
# called ``date`` or ``first``, so none of these goes by its name alone.
UNIT = r"(?:microsecond|second|minute|hour|day|week|month|quarter|year)(?:_[a-z]+)?"
FRAME_END = r"(?:unbounded|current|[^\s]+)\s+(?:preceding|following|row)"
PLACED = [
    # cast(x as decimal(9, 2)), x::date, convert(x, char), convert(x using utf8)
    (r"\bas\s+[\p{L}_]\w*(?:\s+(?:precision|varying|unsigned|signed|integer))*\s*(?:\([\d,\s]*\))?\s*\)", ")"),
    (r"::\s*[\p{L}_]\w*(?:\s*\([\d,\s]*\))?", " "),
    (r"(\bconvert\s*\(.*),\s*(?:signed|unsigned|char|date|datetime|time|decimal|binary|json)(?:\s+integer)?\s*(?:\([\d,\s]*\))?\s*\)", "$1)"),
    (r"\busing\s+[\p{L}_]\w*\s*\)", ")"),
    # interval n day, interval '1' day, extract(year from x), trim(both 'x' from y), timestampdiff(day, x, y)
    (rf"\binterval\s+({QUOTE}|[\w.]+|\([^()]*\))\s+{UNIT}\b", " $1 "),
    (rf"\bextract\s*\(\s*{UNIT}\s+from\s", "extract( "),
    (r"(\btrim\s*\(\s*)(?:leading|trailing|both)\b", "$1"),
    (rf"(\b(?:timestampdiff|timestampadd)\s*\(\s*){UNIT}\s*,", "$1"),
    # date '2024-01-01'
    (rf"\b(?:date|time|timestamp|datetime|interval)\s*{QUOTE}", " "),
    # rows between unbounded preceding and current row, nulls first, ignore nulls
    (rf"\b(?:rows|range|groups)\s+between\s+{FRAME_END}\s+and\s+{FRAME_END}", " "),
    (rf"\b(?:rows|range|groups)\s+{FRAME_END}", " "),
    (r"\b(?:nulls\s+(?:first|last)|(?:ignore|respect)\s+nulls)\b", " "),
    # within group (…), filter (where …), separator '…', escape '…', collate x, at time zone
    (r"\bwithin\s+group\b|\bfilter\s*(?=\(\s*where\b)|\bat\s+time\s+zone\b|\bcollate\s+[\p{L}_]\w*", " "),
    (rf"\b(?:separator|escape)\s*{QUOTE}", " "),
]


# A word that one of these places has; without any, nothing is taken out.
SUSPECT = (
    r"(?i)::|\b(?:as|using|convert|interval|extract|trim|timestampdiff|timestampadd|date|time|timestamp|datetime|rows|range|groups|"
    r"nulls|within|filter|collate|zone|separator|escape)\b"
)


@dataclass
class Dictionary:
    """Columns by table: ``place, column_name, position``; ``place`` makes that key of a table's name in a statement."""

    columns: DataFrame
    place: Callable[[Column], Column]


def shielded(text: Column) -> Column:
    """Text whose cutting characters stand in where they are inside parentheses, at any depth.

    What is then cut at commas, blanks and words is cut at the top level. The text is split at
    parentheses, depths are counted along the pieces, and the pieces joined once; unbalanced text keeps a ``(``.
    """
    pieces = F.split(text, "(?=[()])")

    def with_depths(cut: Column) -> Column:
        change = F.transform(cut, lambda p: F.when(F.startswith(p, F.lit("(")), 1).when(F.startswith(p, F.lit(")")), -1).otherwise(0))
        depths = F.aggregate(change, F.array(F.lit(0)), lambda seen, by: F.array_append(seen, F.element_at(seen, -1) + by))
        return F.struct(cut.alias("pieces"), depths.alias("depths"))

    def piece(p: Column, depth: Column) -> Column:
        opens, closes = F.startswith(p, F.lit("(")), F.startswith(p, F.lit(")"))
        mark = F.when(opens, SHIELDS[0]).when(closes, SHIELDS[1]).otherwise("")
        rest = F.when(opens | closes, F.substring(p, 2, 2**31 - 1)).otherwise(p)
        return F.concat(mark, F.when(depth > 0, F.translate(rest, CUTTING, SHIELDS)).otherwise(rest))

    def whole(parts: Column) -> Column:
        """Pieces beside the depth after each; the array has the depth before the first one in front."""
        d = parts["depths"]
        joined = F.array_join(F.zip_with(parts["pieces"], F.slice(d, 2, F.size(d)), lambda p, n: piece(p, n)), "")
        return F.concat(joined, F.when((F.array_min(d) < 0) | (F.element_at(d, -1) != 0), "(").otherwise(""))

    # Bound once, or the text would be made and the depths counted again for each mention.
    return bound(bound(pieces, with_depths), whole)


def plain(text: Column) -> Column:
    return F.translate(text, SHIELDS, CUTTING)


def trimmed_items(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: F.trim(x))


def columns_in(expression: Column) -> Column:
    """``(q, c)`` of the columns that a computed item reads: names that are no function, value, type, unit or keyword."""
    cleared = expression
    for pattern, instead in PLACED:
        cleared = F.regexp_replace(cleared, f"(?i){pattern}", instead)
    # Most items have none of these words and keep their text.
    expression = F.when(expression.rlike(SUSPECT), cleared).otherwise(expression)
    found = F.array_distinct(F.regexp_extract_all(expression, F.lit(COLUMN), F.lit(1)))
    named = F.filter(found, lambda c: ~F.lower(c).isin([*RESERVED_WORDS, *VALUE_WORDS]))
    return F.transform(
        named,
        lambda c: F.struct(
            F.lower(F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)).alias("q"), F.substring_index(c, ".", -1).alias("c")
        ),
    )


def _labels(body: Column) -> Column:
    """Only the names that select items give their columns, and which are stars."""
    return _items(body, False)


def _items(body: Column, with_columns: bool = True) -> Column:
    """Select items: the name each gives its column (``label``), whether it is a star, its qualifier, and its columns (``refs``)."""

    def facts(item: Column) -> Column:
        def of(match: Column) -> Column:
            bare, made = match["bare"], match["made"]
            is_bare, star = F.size(bare) == 3, (F.size(bare) == 3) & (F.get(bare, 1) == "*")
            label = F.when(is_bare, F.when(bare[2] != "", bare[2]).otherwise(bare[1])).when(F.size(made) == 2, made[1])
            if not with_columns:
                return F.struct(label.alias("label"), star.alias("star"))
            value = star | ((F.get(bare, 0) == "") & F.lower(F.get(bare, 1)).isin(VALUE_WORDS))
            none = F.array().cast("array<struct<q:string,c:string>>")
            own = F.array(F.struct(F.lower(F.get(bare, 0)).alias("q"), F.get(bare, 1).alias("c")))
            refs = F.when(is_bare, F.when(value, none).otherwise(own)).otherwise(columns_in(plain(made[0])))
            return F.struct(label.alias("label"), star.alias("star"), F.when(star, F.lower(bare[0])).alias("q"), refs.alias("refs"))

        groups = F.struct(
            F.split(F.regexp_replace(item, ITEM, f"$1{GROUP}$2{GROUP}$3"), GROUP).alias("bare"),
            F.split(F.regexp_replace(item, COMPUTED, f"$1{GROUP}$2"), GROUP).alias("made"),
        )
        return bound(groups, of)

    return F.transform(trimmed_items(F.regexp_extract(body, LIST_AND_FROM, 1)), facts)


def _arms(statements: DataFrame, sql_col: str) -> DataFrame:
    """One row per arm: ``target``, ``_targets`` (column list), ``_dynamic`` (partition columns without a value),
    ``_body``, ``_sources`` and the first arm's body."""
    literal = r"'(?:[^']|'')*'"
    clear = F.translate(F.col(sql_col), GROUP + QUOTE + SHIELDS, "        ")
    no_comments = F.regexp_replace(clear, f"({literal})|--[^\\n]*", "$1")
    flat = F.regexp_replace(F.regexp_replace(no_comments, literal, QUOTE), r"[`\s]+", " ")
    # A backtick next to a dot or bracket leaves a blank that belongs to no name.
    tight = F.regexp_replace(F.regexp_replace(flat, r"\s*\.\s*", "."), r"[\s;]+$", "")
    rows = settled(statements.withColumn("_sql", F.trim(tight)), {"_sql": F.col("_sql")})
    parts = F.split(F.regexp_replace("_sql", INSERT, f"$1{GROUP}$2{GROUP}$3{GROUP}$4"), GROUP)
    rows = settled(rows, {"_parts": parts})

    def part(k: int) -> Column:
        return F.when(F.size("_parts") == 4, F.trim(F.get("_parts", k))).otherwise("")

    def opened(arm: Column) -> Column:
        """An arm without parentheses around all of it; the cuts inside are made anew."""
        inside = F.regexp_extract(arm, IN_PARENTHESES, 1)
        return bound(inside, lambda i: F.when(i != "", shielded(F.trim(plain(i)))).otherwise(arm))

    arms = F.transform(F.split(shielded(part(3)), SET_OPERATION), lambda a: bound(bound(F.trim(a), opened), opened))
    dynamic = F.filter(trimmed_items(part(1)), lambda x: (x != "") & ~x.contains("="))
    rows = settled(
        rows, {"target": part(0), "_targets": F.when(part(2) != "", trimmed_items(part(2))), "_dynamic": dynamic, "_all": arms}
    )
    rows = rows.select("*", F.posexplode("_all").alias("_arm", "_body")).withColumn("_head", F.col("_all")[0])
    source = F.concat(F.lit("from "), F.regexp_replace(F.regexp_extract("_body", LIST_AND_FROM, 2), AFTER_SOURCES, ""))
    rows = settled(rows.drop("_parts", "_all"), {"_from": source})
    sources = F.zip_with(
        F.regexp_extract_all("_from", F.lit(SOURCE), F.lit(1)), F.regexp_extract_all("_from", F.lit(SOURCE), F.lit(2)),
        lambda t, a: F.struct(t.alias("t"), F.lower(a).alias("a"), F.lower(t).alias("full"), F.substring_index(F.lower(t), ".", -1).alias("last")),
    )
    return settled(rows, {"_sources": sources})


def _with_known(arms: DataFrame, dictionary: Dictionary | None) -> DataFrame:
    """``_known``: the column names of each source by position in the table, NULL for a source that the dictionary lacks.

    Each distinct list of sources is looked up once. A table's columns are gathered in a row, which they bound.
    """
    if dictionary is None:
        return arms.withColumn("_known", F.transform("_sources", lambda s: F.lit(None).cast("array<string>")))
    arms = arms.withColumn("_places", F.transform("_sources", lambda s: dictionary.place(s["t"])))
    tables = dictionary.columns.filter("place IS NOT NULL AND column_name IS NOT NULL").groupBy("place").agg(
        F.array_sort(F.collect_set(F.struct("position", "column_name"))).alias("_columns")
    )
    asked = arms.select("_places").distinct().select("_places", F.posexplode("_places").alias("_at", "place"))
    found = asked.join(tables, "place").groupBy("_places").agg(
        F.map_from_entries(F.collect_list(F.struct("_at", F.col("_columns.column_name")))).alias("_of")
    )
    known = F.transform("_sources", lambda s, i: F.try_element_at(F.col("_of"), i))
    return arms.join(found, "_places", "left").withColumn("_known", known).drop("_places", "_of")


def _cells(items: Column) -> Column:
    """Columns of the select list: ``label``, ``star`` (an unknown number of columns), and ``refs`` of the index of the source
    (``src``), its column and, where no source is found, why."""
    at = F.transform("_sources", lambda s, i: i)
    unknown = F.filter(at, lambda i: F.get(F.col("_known"), i).isNull())

    def named(q: Column) -> Column:
        return F.filter(at, lambda i: bound(F.get(F.col("_sources"), i), lambda s: (s["a"] == q) | (s["full"] == q) | (s["last"] == q)))

    def placed(ref: Column) -> Column:
        def of(found: Column) -> Column:
            n, holders, blind = found["named"], found["holders"], F.size(unknown)
            src = (
                F.when(ref["q"] != "", F.get(n, 0)).when(F.size("_sources") == 1, 0).when(F.size(holders) == 1, holders[0])
                .when((F.size(holders) == 0) & (blind == 1), F.get(unknown, 0))
            )
            why = (
                F.when(ref["q"] != "", "unknown qualifier").when(F.size(holders) > 1, "ambiguous column")
                .when(blind == 0, "unknown column").otherwise("unqualified column")
            )
            return F.struct(src.alias("src"), ref["c"].alias("c"), F.when(src.isNull(), why).alias("why"))

        holders = F.filter(at, lambda i: F.exists(F.get(F.col("_known"), i), lambda c: F.lower(c) == F.lower(ref["c"])))
        return bound(F.struct(named(ref["q"]).alias("named"), holders.alias("holders")), of)

    def cell(label: Column, star: bool, refs: Column) -> Column:
        return F.struct(label.alias("label"), F.lit(star).alias("star"), refs.alias("refs"))

    def ref(src: Column, c: Column, why: Column) -> Column:
        return F.array(F.struct(src.alias("src"), c.alias("c"), why.alias("why")))

    def spelled(i: Column) -> Column:
        """The columns of a source, or one cell for all of them."""
        no_reason, star = F.lit(None).cast("string"), F.lit("*")
        columns = F.transform(F.get(F.col("_known"), i), lambda c: cell(c, False, ref(i, c, no_reason)))
        return F.coalesce(columns, F.array(cell(star, True, ref(i, star, no_reason))))

    def of(item: Column) -> Column:
        which = F.when(item["q"] != "", F.slice(named(item["q"]), 1, 1)).otherwise(at)
        lost = F.array(cell(F.lit("*"), True, ref(F.lit(None).cast("int"), F.lit("*"), F.lit("unknown qualifier"))))
        stars = bound(which, lambda w: F.when(F.size(w) == 0, lost).otherwise(F.flatten(F.transform(w, spelled))))
        return F.when(item["star"], stars).otherwise(F.array(cell(item["label"], False, F.transform(item["refs"], placed))))

    return F.flatten(F.transform(items, of))


def parse_insert_select(statements: DataFrame, sql_col: str, dictionary: Dictionary | None = None) -> DataFrame:
    """One row per arm of each statement, with ``target``, ``pairs`` (source table, source column,
    target column), ``reason`` and ``lost`` (item and reason).

    ``reason`` is NULL for arms that were read. A computed item gives a pair for each column in it. Targets are named by the
    column list and then the partition columns without a value, else by the item; items behind the only star of unknown width
    are counted from the end. Later arms of a set operation name their targets by position, as the first arm does. A column without a qualifier
    is that of the only source, of the only one that the dictionary gives it, or of the only one the dictionary lacks
    if no other has it. Each column that finds no source or no target is in ``lost`` with its reason.
    """
    arms = _with_known(_arms(statements, sql_col), dictionary)
    # Only later arms take their names from the first one.
    first = F.when(F.col("_arm") > 0, _labels(F.col("_head")))
    rows = settled(arms, {"_items": _items(F.col("_body")), "_first": first})
    rows = settled(rows, {"_cells": _cells(F.col("_items"))})
    n, stars = F.size("_cells"), F.filter(F.transform("_cells", lambda c, i: F.when(c["star"], i)), lambda i: i.isNotNull())
    rows = settled(
        rows,
        {
            "_stars": stars,
            "_listed": F.when(F.col("_targets").isNotNull(), F.concat("_targets", "_dynamic")),
            "_names": F.when((F.col("_arm") > 0) & ~F.exists("_first", lambda i: i["star"]), F.col("_first.label")),
        },
    )
    columns_before = F.size("_dynamic") - n

    def target(c: Column, i: Column) -> Column:
        listed, first = F.col("_listed"), F.get(F.col("_stars"), 0)
        by_list = F.when(first.isNull() | (i < first), F.get(listed, i)).when(F.size("_stars") == 1, F.get(listed, F.size(listed) - n + i))
        by_item = F.coalesce(F.when(i + columns_before >= 0, F.get(F.col("_dynamic"), i + columns_before)), F.get(F.col("_names"), i), c["label"])
        return F.when(c["star"], "*").when(listed.isNotNull(), by_list).otherwise(by_item)

    def each(c: Column, i: Column) -> Column:
        to = target(c, i)
        return F.transform(
            c["refs"],
            lambda r: F.struct(
                F.get(F.col("_sources"), r["src"])["t"].alias("from_table"), r["c"].alias("from_col"),
                F.when(r["c"] == "*", "*").otherwise(to).alias("to_col"),
                F.coalesce(r["why"], F.when(to.isNull(), "no target name")).alias("why"),
            ),
        )

    width = F.size("_listed")
    reason = (
        F.when(F.col("_body").rlike(NESTED) | ((F.col("target") == "") & F.col("_sql").rlike(r"(?i)\(\s*select\b")), "subquery")
        .when(F.col("_sql").rlike(r"(?i)^with\b|\swith\s.*\bselect\b"), "common table expression")
        .when(F.col("target") == "", "not insert select")
        .when(F.col("_body").rlike(SET_OPERATION), "nested set operation")
        .when(F.col("_body").contains("("), "unbalanced")
        .when(F.col("_from") == "from ", "no source")
        .when(F.when(F.size("_stars") == 0, width != n).otherwise(width < n - F.size("_stars")), "column count differs")
    )
    rows = settled(rows, {"_reason": reason, "_found": F.flatten(F.transform("_cells", each))})
    fine = F.col("_reason").isNull()
    pairs = F.filter("_found", lambda p: p["why"].isNull() & p["from_table"].isNotNull())
    pairs = F.transform(pairs, lambda p: F.struct(p["from_table"].alias("from_table"), p["from_col"].alias("from_col"), p["to_col"].alias("to_col")))
    missed = F.filter("_found", lambda p: p["why"].isNotNull())
    missed = F.array_distinct(F.transform(missed, lambda p: F.struct(p["from_col"].alias("item"), p["why"].alias("reason"))))
    read = settled(rows, {"pairs": F.when(fine, pairs).otherwise(F.array()), "lost": F.when(fine, missed).otherwise(F.array())})
    nothing = F.when(F.size("pairs") == 0, "no source column")
    # The reasons for items never hide that nothing was read.
    read = read.withColumn("reason", F.coalesce("_reason", nothing))
    return read.drop(*[c for c in read.columns if c in _OWN])


_OWN = {
    "_sql", "_targets", "_dynamic", "_head", "_arm", "_body", "_from", "_sources", "_known", "_items", "_first", "_cells", "_stars", "_listed", "_names",
    "_reason", "_found",
}
