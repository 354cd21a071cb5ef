"""Phrases that stand together more often than their parts would, from sorted streams of counts.

Counting goes by length. A unit is some MB of the texts of one language, whose tasks count its
phrases and send them, sorted, as one packed stream per bucket. A bucket merges the streams of all units, keeps
the phrases that are frequent enough, numbers them in order, and tells each unit the numbers.
A phrase of k + 1 words is the pair of the numbers of its first k and its last k words, so only pairs of frequent
phrases are counted, phrases are compared exactly, and no text is sent beyond single words. Numbers
ascend with the streams, so a stream stays in prefix order from length to length.

What is left is one table per length of (number, number of the first words, number of the last words, count). It is
read in prefix order and in suffix order, and sorted merge joins carry counts of the left parts, the right
parts and the extensions along; no hash table is built.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.text import cogrouped, grouped, mapped, mix, small_batches, utf8
from tidewright.session import forget, scratch_path, settled_rows

LEAST = 100  # occurrences of a candidate
LONGEST = 5  # words of a candidate
PER_LANGUAGE = 2000
UNIT = 8 << 20  # characters counted together
BUCKET_CHARS = 64 << 20  # characters of the corpus per bucket of words
BUCKET_PAIRS = 4 << 20  # places per bucket of longer phrases
LEAST_BUCKETS = 64
SALTS = 64

_CUT = ord("\n")
_PREPARED = bytearray(range(256))
_PREPARED[ord("\t")] = ord(" ")
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _PREPARED[_c] = _CUT
for _c in range(ord("A"), ord("Z") + 1):
    _PREPARED[_c] = _c + 32
_PREPARED = bytes(_PREPARED)

# A row is a stream to a bucket, or what a unit keeps (a bucket of -1).
_ROUND = "bucket int, unit long, lang string, n long, data binary"
_ROUND_ARROW = pa.schema([("bucket", pa.int32()), ("unit", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("data", pa.binary())])
_GRAM = [("id", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("f", pa.int64()), ("word", pa.string()), ("lang", pa.string())]
_MET = "bucket int, unit long, data binary, grams array<struct<id: long, first: long, last: long, f: long, word: string, lang: string>>"
_MET_ARROW = pa.schema([("bucket", pa.int32()), ("unit", pa.int64()), ("data", pa.binary()), ("grams", pa.list_(pa.struct(_GRAM)))])


def _press(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in byte planes, compressed."""
    head = np.array([len(arrays), *map(len, arrays)], np.int64).tobytes()
    planes = [a.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def _unpress(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    arrays, at = [], 8 * (n + 1)
    for size in np.frombuffer(data, np.int64, n, 8).tolist():
        planes = np.frombuffer(data, np.uint8, 8 * size, at).reshape(8, size)
        arrays.append(np.ascontiguousarray(planes.T).view("<i8").ravel())
        at += 8 * size
    return arrays


def _zip(words: list[bytes], counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.int64(len(words)).tobytes() + counts.astype("<i8").tobytes() + b" ".join(words))


def _unzip(data: bytes) -> tuple[list[bytes], list[int]]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return data[8 + 8 * n :].split(b" "), np.frombuffer(data, np.int64, n, 8).tolist()


def _codes(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words of the texts as numbers from 2, 0 where a piece ends, and the words in the order of these numbers."""
    data = b"\n".join([*texts, b""]).translate(_PREPARED)
    known: dict[bytes, int] = defaultdict(count().__next__)
    known[b"\n"], known[b""]
    parts, at = [np.zeros(0, np.int64)], 0
    while at < len(data):
        end = at + (1 << 20)
        if end < len(data):
            # Slices end between words; a longer word makes a slice of its own.
            ends = [data.rfind(b" ", at + 1, end), data.rfind(b"\n", at + 1, end)]
            later = [e for e in (data.find(b" ", end), data.find(b"\n", end)) if e >= 0]
            end = max(ends) if max(ends) > 0 else min(later, default=len(data))
        words = data[at:end].replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        parts.append(found[found != 1].astype(np.int32))
        at = end
    return np.concatenate(parts), list(known)[2:]


def _unit(texts: list[bytes], lang: str, number: int, buckets: int) -> Iterator[tuple]:
    """What a unit keeps and sends first: its words by number, and its words with their counts by bucket."""
    codes, words = _codes(texts)
    if not words:
        return
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    order = np.array(sorted(range(len(words)), key=lambda k: (bucket[k], words[k])), np.int64)
    place = np.zeros(len(words) + 2, np.int64)
    place[order + 2] = np.arange(1, len(words) + 1)
    codes = place[codes]
    counts = np.bincount(codes, minlength=len(words) + 1)[1:]
    yield -1, number, lang, int(counts.sum()), _press(codes)
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[b], cuts[b + 1])
        yield b, number, lang, part.stop - part.start, _zip([words[k] for k in order[part].tolist()], counts[part])


class _Pairs:
    """The phrases one word longer than those at ``at``: where they end up in the streams to the buckets.

    ``place`` are ascending places in the unit, ``code`` the phrase that starts there, ``ids`` the number of each code.
    """

    def __init__(self, place: np.ndarray, code: np.ndarray, ids: np.ndarray, buckets: int):
        both = np.flatnonzero(np.diff(place) == 1)
        self.place = place[both]
        pair, self.code, counts = np.unique(code[both] << 32 | code[both + 1], return_inverse=True, return_counts=True)
        first, last = ids[pair >> 32], ids[pair & 0xFFFFFFFF]
        turned = mix(first.view(np.uint64)) * np.uint64(3) + last.view(np.uint64)
        bucket = (mix(turned) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place_of = np.empty(len(order), np.int64)
        place_of[order] = np.arange(len(order))
        self.code = place_of[self.code]
        self.first, self.last, self.counts = first[order], last[order], counts[order]
        self.cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))

    def sent(self, lang: str, number: int) -> Iterator[tuple]:
        for b in np.flatnonzero(np.diff(self.cuts)).tolist():
            part = slice(self.cuts[b], self.cuts[b + 1])
            steps = np.diff(self.first[part], prepend=0)
            yield b, number, lang, part.stop - part.start, _press(steps, self.last[part], self.counts[part])


def _kept(place: np.ndarray, code: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places whose phrase got a number, their new codes, and the numbers."""
    fine = told > 0
    stay = fine[code]
    return place[stay], (np.cumsum(fine) - 1)[code[stay]], told[fine]


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > 4 << 20:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _first_round(buckets: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        task, numbers, held, size = TaskContext.get().partitionId(), count(), defaultdict(list), 0

        def out():
            for lang in sorted(held):
                yield from _unit(held[lang], lang, task << 32 | next(numbers), buckets)
            held.clear()

        for batch in batches:
            for lang, text in zip(*(batch[c].to_pylist() for c in ("lang", "text"))):
                held[lang].append(utf8(text))
                size += len(text)
                if size > UNIT:
                    yield from out()
                    size = 0
        yield from out()

    return mapped(lambda batches: _batches(rows(batches), _ROUND_ARROW))


def _next_round(length: int, had: int, buckets: int):
    """From what a unit keeps of phrases of ``length - 1`` words (words by number for 1) and what the buckets told
    it of the longer ones, to the same one word further."""

    def rows(kept: pa.Table, told: pa.Table) -> Iterator[tuple]:
        for unit, lang, data in zip(*(kept[c].to_pylist() for c in ("unit", "lang", "data"))):
            answers = sorted(zip(told["bucket"].to_pylist(), told["data"].to_pylist()))
            found = [np.zeros(0, np.int64)]
            for _, answer in answers:
                n, at, ids = _unpress(answer)
                found.append(np.zeros(int(n[0]), np.int64))
                found[-1][at] = ids
            numbers = np.concatenate(found)
            if length == 1:
                (codes,) = _unpress(data)
                place = np.flatnonzero(codes)
                place, code, ids = _kept(place, codes[place] - 1, numbers)
            else:
                pairs = _Pairs(*_unpress(data), had)
                place, code, ids = _kept(pairs.place, pairs.code, numbers)
            if len(place):
                yield -1, unit, lang, len(place), _press(place, code, ids)
                yield from _Pairs(place, code, ids, buckets).sent(lang, unit)

    def run(kept: pa.Table, told: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_batches(rows(kept, told), _ROUND_ARROW)), _ROUND_ARROW)

    return cogrouped(run)


def _meet(length: int, least: int):
    """One bucket: the streams of all units merged, frequent phrases numbered in order, each unit told its numbers."""

    def words(table: pa.Table, base: int):
        total: dict[str, Counter] = defaultdict(Counter)
        streams = []
        for unit, lang, data in zip(*(table[c].to_pylist() for c in ("unit", "lang", "data"))):
            found, counts = _unzip(data)
            mine = total[lang]
            for word, n in zip(found, counts):
                mine[word] += n
            streams.append((unit, lang, data))
        number, grams, of = count(base + 1), [], {}
        for lang in sorted(total):
            kept = sorted(w for w, n in total[lang].items() if n >= least)
            of[lang] = dict(zip(kept, number))
            grams += [dict(id=i, first=0, last=0, f=total[lang][w], word=w.decode("utf-8", "surrogatepass"), lang=lang) for w, i in of[lang].items()]
        for unit, lang, data in streams:
            yield unit, np.fromiter((of[lang].get(w, 0) for w in _unzip(data)[0]), np.int64)
        yield None, grams

    def pairs(table: pa.Table, base: int):
        parts = [_unpress(d) for d in table["data"].to_pylist()]
        first = np.concatenate([np.cumsum(p[0]) for p in parts])
        last, counts = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        ends = np.cumsum([len(p[0]) for p in parts])
        del parts
        order = np.lexsort((last, first))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(first[order]) != 0) | (np.diff(last[order]) != 0)
        starts = np.flatnonzero(new)
        f = np.add.reduceat(counts[order], starts)
        fine = f >= least
        number = np.where(fine, base + np.cumsum(fine), 0)
        told = np.empty(len(order), np.int64)
        told[order] = number[np.cumsum(new) - 1]
        for unit, part in zip(table["unit"].to_pylist(), np.split(told, ends[:-1])):
            yield unit, part
        at = order[starts[fine]]
        columns = (number[fine], first[at], last[at], f[fine])
        yield None, [dict(id=i, first=a, last=b, f=n, word=None, lang=None) for i, a, b, n in zip(*(c.tolist() for c in columns))]

    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _MET_ARROW.empty_table()
        bucket, rows = table["bucket"][0].as_py(), []
        for unit, found in (words if length == 1 else pairs)(table, bucket << 32):
            if unit is None:
                rows.append((bucket, None, None, found))
            else:
                at = np.flatnonzero(found)
                rows.append((bucket, unit, _press(np.array([len(found)]), at, found[at]), None))
        return pa.Table.from_batches(list(_batches(rows, _MET_ARROW)), _MET_ARROW)

    return grouped(run)


def counted(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, list[DataFrame]]:
    """``(lang, n)``, all words of each language, and for each length the phrases that occur ``least`` times:
    ``(id, first, last, f)``, for single words also ``(word, lang)``.

    Each round is written to the shared folder; the streams of a round go when the next one stands.
    """
    spark = small_batches(docs).sparkSession
    slim = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chars = slim.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-chars // BUCKET_CHARS))
    path = scratch_path(spark, "phrases")
    spark_round = slim.mapInArrow(_first_round(buckets), _ROUND)
    tables, total = [], None
    for length in range(1, longest + 1):
        sent, met = f"{path}/sent{length}", f"{path}/met{length}"
        spark_round.write.parquet(sent)
        if length > 1:
            forget(spark, f"{path}/sent{length - 1}")
        streams = spark.read.schema(_ROUND).parquet(sent)
        if length == 1:
            # Counted before the streams go.
            total = spark.createDataFrame(streams.filter("bucket = -1").groupBy("lang").agg(F.sum("n").alias("n")).collect(), "lang string, n long")
        streams.filter("bucket >= 0").groupBy("bucket").applyInArrow(_meet(length, least), _MET).write.parquet(met)
        answers = spark.read.schema(_MET).parquet(met)
        grams = answers.select(F.inline("grams"))
        tables.append(grams.drop("word", "lang") if length > 1 else grams)
        places = grams.agg(F.sum("f")).first()[0] or 0
        had, buckets = buckets, max(LEAST_BUCKETS, -(-places // BUCKET_PAIRS))
        told = answers.filter("unit IS NOT NULL").select("unit", "bucket", "data").groupBy("unit")
        spark_round = streams.filter("bucket = -1").groupBy("unit").cogroup(told).applyInArrow(_next_round(length, had, buckets), _ROUND)
    return total, tables


def mined(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, per_language: int = PER_LANGUAGE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``per_language`` best phrases of each language.

    A phrase has 2 to ``longest`` words without one of ``.,;:!?`` or a line break between them, compared with A-Z in lower
    case, and occurs ``a >= least`` times, overlaps included. ``n`` are all words of the language, ``l`` and ``r`` the occurrences of
    the two parts at the cut with the lowest ``score = floor(1000 * a * n / (l * r))``, the first of
    equal ones. A phrase goes if a longer one that occurs as often holds it. Best are the highest score,
    the most occurrences, the first by bytes. A null language is ``und``, a null text empty; repeated rows
    count, ids and other columns do not matter, an empty table gives an empty one. Exact for counts below 10^15.
    """
    total, tables = counted(docs, least, longest, text_col, lang_col)
    level = tables[0].select("id", "lang", F.array("word").alias("words"), F.array("f").alias("firsts"), F.array("f").alias("lasts"), "f")
    found = None
    for k, grams in enumerate(tables[1:], 2):
        left = level.select(F.col("id").alias("first"), "lang", "words", "firsts").hint("merge")
        right = level.select(F.col("id").alias("last"), F.element_at("words", -1).alias("word"), "lasts").hint("merge")
        joined = grams.join(left, "first").join(right, "last").select(
            "id", "lang", F.concat("words", F.array("word")).alias("words"), F.concat("firsts", F.array("f")).alias("firsts"),
            F.concat("lasts", F.array("f")).alias("lasts"), "f",
        )
        # Read twice by the next length and once for its own phrases.
        level = settled_rows(joined)
        whole = level
        if k < len(tables):
            # The most frequent extension to the right stands with the prefix, to the left with the suffix.
            for side in ("first", "last"):
                longer = tables[k].groupBy(F.col(side).alias("id")).agg(F.max("f").alias(f"by_{side}"))
                whole = whole.join(longer.hint("merge"), "id", "left")
            whole = whole.filter("greatest(coalesce(by_first, 0), coalesce(by_last, 0)) < f").drop("by_first", "by_last")
        found = whole if found is None else found.unionByName(whole)
    cut = """array_min(transform(sequence(1, size(words) - 1), k -> struct(
        cast(1000 * f AS decimal(19, 0)) * cast(n AS decimal(18, 0))
            div (cast(firsts[k - 1] AS decimal(18, 0)) * cast(lasts[size(words) - k - 1] AS decimal(18, 0))) AS score,
        k, firsts[k - 1] AS l, lasts[size(words) - k - 1] AS r)))"""
    scored = found.join(total, "lang").withColumn("cut", F.expr(cut))
    scored = scored.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    # The best of each part of a language, then of these.
    best = Window.orderBy(F.desc("score"), F.desc("a"), "phrase")
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(best.partitionBy("lang", "salt"))).filter(F.col("rank") <= per_language)
    ranked = some.withColumn("rank", F.row_number().over(best.partitionBy("lang"))).filter(F.col("rank") <= per_language)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
