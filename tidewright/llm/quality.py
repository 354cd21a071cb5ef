"""Quality rules: a table of thresholds compiled into one Spark projection.

Everything is an expression inside the row: no shuffle, no user function. Ratios are compared as whole
numbers (100 * part against percent * whole), so no rounding decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.once import settled

WORD = r"[^\x20\x09-\x0D]+"
SPAN = 5  # words in a repeat window

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in that is for with as on be it are this by from at or an was not have a "
    "der die das und ist zu den von mit ein eine im dem des auf für nicht sich als auch "
    "le la les de des et un une du en que est pour dans par sur au pas ne "
    "el los las y del se por con para su al una lo como más no"
)


@dataclass(frozen=True)
class Rule:
    """``least`` <= 100 * part / whole <= ``most``; either bound may be missing."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None

    def passed(self) -> Column:
        part, whole = F.col(self.part) * 100, F.col(self.whole)
        tests = [part >= whole * self.least] if self.least is not None else []
        tests += [part <= whole * self.most] if self.most is not None else []
        return tests[0] if len(tests) == 1 else tests[0] & tests[1]


RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", most=30),
    Rule("stop_words", "n_stop_words", "n_words", least=4),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=40),
    Rule("word_lines", "n_lines", "n_all_lines", least=20),
)


def measured(docs: DataFrame, text_col: str = "text", stop_words: str = STOP_WORDS) -> DataFrame:
    """``docs`` with the counts that the rules read, over the whole text; a null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)
    read = settled(
        docs,
        {
            "_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
            "_lines": F.filter(lines, lambda line: line.rlike(WORD)),
            "n_all_lines": F.size(lines).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        },
    )
    words, n = F.col("_words"), F.size("_words")
    hashed = settled(
        read,
        {
            "n_words": n.cast("long"),
            "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(sorted(set(stop_words.split()))))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": F.transform(words, lambda w: F.xxhash64(w)),
        },
    ).drop("_words", "_lines")
    places = F.when(F.col("n_words") >= SPAN, F.sequence(F.lit(0), F.col("n_words").cast("int") - SPAN)).otherwise(F.array().cast("array<int>"))
    windows = settled(
        hashed,
        {"_windows": F.transform(places, lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(SPAN)]))},
    ).drop("_hashes")
    # Only a text with some window twice is sorted; equal windows then stand side by side.
    pairs = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = settled(windows, {"_sorted": F.when(repeats, F.array_sort(pairs))}).drop("_windows")

    def twice(s: Column, k: Column) -> Column:
        beside = [F.coalesce(F.get("_sorted", k + d)["h"] == s["h"], F.lit(False)) for d in (-1, 1)]
        return F.when(beside[0] | beside[1], s["i"])

    found = settled(ordered, {"_places": F.array_sort(F.array_compact(F.transform("_sorted", twice)))}).drop("_sorted")
    covered = F.transform("_places", lambda p, k: F.least(F.lit(SPAN), F.coalesce(F.get("_places", k + 1) - p, F.lit(SPAN))))
    total = F.aggregate(covered, F.lit(0), lambda a, b: a + b)
    return settled(found, {"n_repeat_words": F.coalesce(total, F.lit(0)).cast("long")}).drop("_places")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with their counts, ``base_failed``, ``kept`` and ``failed_rules`` (names, by table order).

    A text fails the base with fewer than 10 words, or with more than a fifth of its words in 5-word
    windows it has twice. ``kept`` is whether base and all rules pass; an empty text fails the base. Equal
    windows are found by a 64-bit hash. Rows are judged one by one: null ids, repeated rows and
    other columns make no difference, and an empty table gives an empty one.
    """
    base_failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    failed = F.array_compact(F.array(*[F.when(~r.passed(), F.lit(r.name)) for r in rules]))
    out = measured(docs, text_col).withColumn("base_failed", base_failed).withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
