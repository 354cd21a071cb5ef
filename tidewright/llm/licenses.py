"""Licence notices in documents: Dice coefficient over word bigrams against licence templates.

Compared are each line of a text, the whole text and passages inside it: word windows as long as a
template, placed where the text has one of its anchors. The size of a unit must let it reach the
threshold: with a and b distinct bigrams, Dice = 2 * common / (a + b) is at most 2 * min(a, b) / (a + b).
The anchors of a template are so many of its bigrams that no unit reaches the threshold without one
of them, so text without any anchor is settled by one look. All of it is expressions inside the row.
"""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.once import settled
from tidewright.llm.license_texts import BODIES

THRESHOLD_PERCENT = 80

# Common short licence notices, by SPDX identifier.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)

TEMPLATES = NOTICES + BODIES

# Anchors are found by hash in this many lists, so a place of the text looks at a handful of them.
_LISTS = 512

_OUTPUT = ("license", "template", "dice", "place", "n_notices")


def words_of(text: str) -> list[str]:
    """Words of a template: lower-cased runs of ASCII letters, digits and all beyond ASCII."""
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())


def bigrams(text: str) -> list[str]:
    """Distinct bigrams of the words of a template."""
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def _bounds(size: int, percent: int) -> tuple[int, int]:
    """Sizes that can reach the threshold with ``size``: 2 * min >= percent/100 * (a + b)."""
    fit = [n for n in range(1, 2 * size * 100 // percent + 1) if 200 * min(n, size) >= percent * (n + size)]
    return min(fit), max(fit)


def anchors(text: str, percent: int = THRESHOLD_PERCENT) -> list[tuple[str, int]]:
    """Bigrams of a template, the longest first, with the word each starts at.

    A unit of b bigrams at the threshold has at least percent * (a + b) / 200 of the a bigrams; with the smallest
    b that is a number c, and any a - c + 1 bigrams of the template hold one that the unit has.
    """
    grams, words = bigrams(text), words_of(text)
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    shared = -(-percent * (len(grams) + _bounds(len(grams), percent)[0]) // 200)
    rare = sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - shared + 1]
    return [(g, pairs.index(g)) for g in rare]


def scanned(docs: DataFrame, templates=TEMPLATES, percent: int = THRESHOLD_PERCENT, text_col: str = "text") -> DataFrame:
    """``docs`` with ``license`` (null if none), ``template`` (its place in the table), ``dice``, ``place`` and ``n_notices``.

    The best match of any line, the whole text or a passage counts, the first template of those as good.
    A passage is the window of as many words as a template has in which an anchor stands where it stands in the template, cut
    off at the ends of the text; ``place`` is the word (from 0) at which the first such passage of the best match starts, null
    where only a line or the whole text matches as well. ``n_notices`` is the number of distinct normalised lines (the
    whole text is one more) that match some template. A null or empty text has none. The whole text is read, however long; rows
    are judged one by one, so null ids, repeated rows and other columns make no difference; columns of the five names are replaced.
    """
    known = [(k, bigrams(text), text) for k, (_, text) in enumerate(templates) if len(words_of(text)) > 1]
    sizes = [_bounds(len(grams), percent) for _, grams, _ in known]
    least, most = min(lo for lo, _ in sizes), max(hi for _, hi in sizes)
    entries = [
        {"rank": -k, "lo": lo, "hi": hi, "words": len(words_of(text)), "grams": grams} for (k, grams, text), (lo, hi) in zip(known, sizes)
    ]
    table = F.from_json(F.lit(json.dumps(entries)), "array<struct<rank int, lo int, hi int, words int, grams array<string>>>")
    placed = [(g, at, i) for i, (_, _, text) in enumerate(known) for g, at in anchors(text, percent)]
    rare = sorted({g for g, _, _ in placed})
    index = _anchor_lists(placed)
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))

    def words(unit: Column) -> Column:
        return F.regexp_extract_all(unit, F.lit(r"[a-z0-9\x{80}-\x{10FFFF}]+"), F.lit(0))

    def pairs(w: Column) -> Column:
        return F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))

    def sizable(w: Column) -> Column:
        """A unit of n words, d of them distinct, has d - 1 to n - 1 distinct bigrams."""
        return (F.size(w) > least) & ((F.size(w) <= most + 1) | (F.size(F.array_distinct(w)) <= most + 1))

    cut = settled(docs, {"_lines": F.transform(F.split(text, "\n", -1), words)})
    cut = settled(cut, {"_words": F.flatten("_lines")})
    several = F.size("_words") > 1
    cut = settled(cut, {"_pairs": F.when(several, pairs(F.col("_words"))).otherwise(F.array().cast("array<string>"))})
    hits = F.array_compact(F.transform("_pairs", lambda g, i: F.when(g.isin(rare), i)))
    cut = settled(cut, {"_hits": hits})

    # A line without an anchor of the text's is no match either, so most texts end here.
    none = F.array().cast("array<array<string>>")
    units = F.filter(F.array_append(F.col("_lines"), F.col("_words")), sizable)
    cut = settled(cut, {"_units": F.when(F.size("_hits") > 0, units).otherwise(none)}).drop("_lines", "_words")
    sized = F.filter(F.transform("_units", lambda w: F.array_distinct(pairs(w))), lambda g: F.size(g).between(least, most))
    cut = settled(cut, {"_grams": F.array_distinct(sized)}).drop("_units")

    def dice(t: Column, g: Column) -> Column:
        return 2.0 * F.size(F.array_intersect(t["grams"], g)) / (F.size(t["grams"]) + F.size(g))

    def matches(g: Column) -> Column:
        near = F.filter(table, lambda t: F.size(g).between(t["lo"], t["hi"]))
        scored = F.transform(near, lambda t: F.struct(dice(t, g).alias("dice"), t["rank"].alias("rank")))
        return F.array_max(F.filter(scored, lambda s: s["dice"] * 100 >= percent))

    def windows(i: Column) -> Column:
        """Place in the table and first word of the windows that the anchor at word i stands for."""
        gram = F.element_at("_pairs", i + 1)
        meant = F.filter(F.element_at(index, _list_of(gram)), lambda a: a["gram"] == gram)
        return F.transform(meant, lambda a: F.struct(a["entry"].alias("entry"), (i - a["at"]).alias("start")))

    def passage(w: Column) -> Column:
        t = F.element_at(table, w["entry"] + 1)
        start = F.greatest(w["start"], F.lit(0))
        g = F.array_distinct(F.slice(F.col("_pairs"), start + 1, w["start"] + t["words"] - 1 - start))
        return F.struct(dice(t, g).alias("dice"), t["rank"].alias("rank"), (-start).alias("place"))

    starts = F.array_distinct(F.flatten(F.transform("_hits", windows)))
    found = settled(cut, {"_found": F.array_compact(F.transform("_grams", matches)), "_windows": starts})
    within = F.filter(F.transform("_windows", passage), lambda s: s["dice"] * 100 >= percent)
    found = settled(found.drop("_grams", "_hits"), {"_within": F.array_max(within)}).drop("_windows", "_pairs")
    unit, inner = F.array_max("_found"), F.col("_within")
    lines = F.when(unit.isNotNull(), F.struct(unit["dice"].alias("dice"), unit["rank"].alias("rank"), F.lit(None).cast("int").alias("place")))
    # Null is the smallest place, so of equal matches a passage counts before a line.
    found = settled(found, {"_best": F.greatest(lines, inner)})
    names = F.array(*[F.lit(name) for name, _ in templates])
    return found.select(
        *[c for c in docs.columns if c not in _OUTPUT],
        F.when(F.col("_best").isNotNull(), F.element_at(names, 1 - F.coalesce("_best.rank", F.lit(0)))).alias("license"),
        (-F.col("_best.rank")).alias("template"),
        F.col("_best.dice").alias("dice"),
        (-F.col("_best.place")).alias("place"),
        F.size("_found").cast("long").alias("n_notices"),
    )


def _list_of(gram: Column) -> Column:
    return (F.pmod(F.crc32(gram.cast("binary")), F.lit(_LISTS)) + 1).cast("int")


def _anchor_lists(placed: list[tuple[str, int, int]]) -> Column:
    """The anchors by list, as one constant: ``gram``, the word ``at`` which it stands and the table ``entry`` of its template."""
    lists = [[] for _ in range(_LISTS)]
    for gram, at, entry in placed:
        lists[zlib.crc32(gram.encode()) % _LISTS].append({"gram": gram, "at": at, "entry": entry})
    return F.from_json(F.lit(json.dumps(lists)), "array<array<struct<gram string, at int, entry int>>>")
