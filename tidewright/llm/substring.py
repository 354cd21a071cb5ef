"""Removing word sequences that repeat an earlier document, by fixed-block anchors.

Every document is a reference: its non-overlapping blocks of ``block`` words are the index. Every
rolling window of ``block`` words of every document probes it. A repeated sequence of ``window`` =
2 * block - 1 words or more holds a whole block of the reference document, so it is hit. Hits are
then extended: all windows of ``window`` words around a hit are compared by a longer hash, and a run
of equal ones is a maximal exact repeat. Words in a window that also starts in a document with a
smaller id are removed.

Both rounds are the same exchange. A task hashes a portion of documents, settles what the portion
decides by itself, and sends the rest packed by hash bucket, about five bytes a window: a
sequence that a third of all documents share sends a few entries per portion, never one per document.
Answers go back packed by group of documents, and the texts are dealt out by the same groups once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.text import Words, cogrouped, grouped, mapped, portions, small_batches, utf8

WINDOW = 13
PORTION = 1 << 20  # characters hashed together
BUCKET_BYTES = 12 << 20  # bytes of text per hash bucket
GROUP_BYTES = 1 << 20  # bytes of text per group of documents

_NONE = np.iinfo(np.int64).max
# Bytes of hash besides the bucket. A false hit of the first round costs a few windows in the second.
_PROBE, _EXACT, _CHECK = 4, 5, 4
_SENT = "bucket int, part int, packed binary"


def _bits(width: int) -> np.uint64:
    return np.uint64((1 << 8 * width) - 1)


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    """The group of each id, as Spark's ``pmod(xxhash64(id), parts)`` of a long."""
    one, two, four, five, three = (np.uint64(x) for x in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0x165667B19E3779F9))

    def turned(x, n):
        return x << np.uint64(n) | x >> np.uint64(64 - n)

    h = np.full(len(ids), np.uint64(42) + five + np.uint64(8))
    h = turned(h ^ turned(ids.astype(np.int64).view(np.uint64) * two, 31) * one, 27) * one + four
    h = (h ^ h >> np.uint64(33)) * two
    h = (h ^ h >> np.uint64(29)) * three
    return (h ^ h >> np.uint64(32)).view(np.int64) % parts


def _pack(docs: np.ndarray, low: np.ndarray, check: np.ndarray | None, doc: np.ndarray, flag: np.ndarray, reply: np.ndarray) -> bytes:
    """Entries of one bucket: bytes of hash, of check in the second round, a place in ``docs``, two bits.

    ``docs`` ascends and goes as differences, which the shuffle's compression takes in.
    """

    def bytes_of(numbers, width):
        return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8)[:, :width])

    parts = [np.array([len(docs), len(low), check is not None], np.int64), np.diff(docs, prepend=0)]
    parts += [bytes_of(low, _PROBE)] if check is None else [bytes_of(low, _EXACT), bytes_of(check, _CHECK)]
    return b"".join(p.tobytes() for p in [*parts, doc.astype(np.uint16), np.packbits(flag), np.packbits(reply)])


def _unpack(packed: bytes):
    n_docs, n, checked = np.frombuffer(packed, np.int64, 3)
    at = 24 + 8 * n_docs
    docs = np.cumsum(np.frombuffer(packed, np.int64, n_docs, 24))

    def number(width):
        nonlocal at
        out = np.zeros((n, 8), np.uint8)
        out[:, :width] = np.frombuffer(packed, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        return out.view(np.uint64).ravel()

    low = number(_EXACT if checked else _PROBE)
    check = number(_CHECK) if checked else np.zeros(n, np.uint64)
    doc = docs[np.frombuffer(packed, np.uint16, n, at)]
    at += 2 * n
    bits = (n + 7) // 8
    flag = np.unpackbits(np.frombuffer(packed, np.uint8, bits, at), count=n).astype(bool)
    reply = np.unpackbits(np.frombuffer(packed, np.uint8, bits, at + bits), count=n).astype(bool)
    return low, check, doc, flag, reply


def _answer(low: np.ndarray, check: np.ndarray) -> np.ndarray:
    """What a document is told: 40 bits of the hash, 24 of the check."""
    return low << np.uint64(24) | check & np.uint64(0xFFFFFF)


def _settle(low, check, doc, flag, both):
    """Per entry, whether it is answered among these: an indexed entry of a smaller document has its hash, or,
    if ``both`` sides are told, it is indexed itself and a larger document has the hash. Also which entries
    speak for a hash elsewhere.

    ``low`` and ``check`` identify the hash; the entries come sorted by them.
    """
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (check[1:] != check[:-1])
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    smallest = np.minimum.reduceat(np.where(flag, doc, _NONE), starts)[group]
    largest = np.maximum.reduceat(doc, starts)[group]
    speaks = (flag & (doc == smallest)) | (both & (doc == largest))
    return (smallest < doc) | (both & flag & (largest > doc)), speaks


def _replies(doc: np.ndarray, answers: np.ndarray, bucket: int, parts: int) -> Iterator[tuple]:
    """Answers as one row for each group of documents: their ids, how many answers each has, and these."""
    order = np.lexsort((doc, part_of(doc, parts)))
    doc, answers = doc[order], answers[order]
    firsts = np.flatnonzero(np.diff(doc, prepend=doc[:1] - 1)) if len(doc) else np.zeros(0, np.int64)
    ids, counts = doc[firsts], np.diff(np.append(firsts, len(doc)))
    part = part_of(ids, parts)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(ids)]]) if len(ids) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        end = firsts[b] if b < len(ids) else len(doc)
        yield bucket, int(part[a]), b"".join([np.int64(b - a).tobytes(), ids[a:b].tobytes(), counts[a:b].tobytes(), answers[firsts[a] : end].tobytes()])


def _told(packed: list[bytes]) -> dict[int, np.ndarray]:
    """The answers to each document of a group."""
    found: dict[int, list] = {}
    for row in packed:
        n = int(np.frombuffer(row, np.int64, 1)[0])
        ids, counts = np.frombuffer(row, np.int64, n, 8), np.frombuffer(row, np.int64, n, 8 + 8 * n)
        answers, ends = np.frombuffer(row, np.uint64, offset=8 + 16 * n), np.cumsum(counts)
        for doc, a, b in zip(ids.tolist(), (ends - counts).tolist(), ends.tolist()):
            found.setdefault(doc, []).append(answers[a:b])
    return {doc: np.concatenate(lists) for doc, lists in found.items()}


def _send(ids: np.ndarray, owner, h, check, flag, buckets: int, parts: int) -> Iterator[tuple]:
    """Rows of one portion: replies it can give itself, then one packed row per bucket.

    A row for a bucket has no group; a reply has a bucket beyond the last, which spreads it.
    """
    docs, rank = np.unique(ids, return_inverse=True)
    bits = _bits(_PROBE if check is None else _EXACT)
    bucket = (h >> np.uint64(40)) % np.uint64(buckets)
    key, doc = bucket << np.uint64(40) | h & bits, rank[owner]
    order = np.argsort(doc, kind="stable")
    order = order[np.argsort(key[order], kind="stable")] if check is None else order[np.lexsort((check[order], key[order]))]
    key, doc, flag = key[order], doc[order], flag[order]
    check = None if check is None else check[order]
    checks = np.zeros(len(key), np.uint64) if check is None else check
    if not len(key):
        return
    # A hash that a document has several times is one entry, indexed if any of them is.
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (checks[1:] != checks[:-1])
    starts = np.flatnonzero(first)
    flag = np.logical_or.reduceat(flag, starts)
    key, doc, checks = key[starts], doc[starts], checks[starts]
    settled, speaks = _settle(key, checks, doc, flag, check is None)
    for _, part, packed in _replies(docs[doc[settled]], _answer(key[settled] & bits, checks[settled]), 0, parts):
        yield buckets + part % buckets, part, packed
    kept = ~settled | speaks
    key, doc, flag, checks, settled = key[kept], doc[kept], flag[kept], checks[kept], settled[kept]
    bucket = (key >> np.uint64(40)).astype(np.int64)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        part = slice(cuts[b], cuts[b + 1])
        order = np.argsort(doc[part], kind="stable")
        used, place = np.unique(doc[part][order], return_inverse=True)
        yield int(b), None, _pack(docs[used], (key[part] & bits)[order], None if check is None else checks[part][order],
                                  place, flag[part][order], ~settled[part][order])


def _arrow(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    names, held, size = ["bucket", "part", "packed"], [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.int32(), pa.int32(), pa.binary()))], names)

    for row in rows:
        held.append(row)
        size += len(row[2]) + 64
        if size > 4 << 20:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _block_hashes(buckets: int, parts: int, window: int):
    """First round: every rolling window of ``block`` words, indexed where it is a block of its document."""
    block = (window + 1) // 2

    def rows(batches):
        for portion in portions(batches, "text", PORTION):
            portion = [r for r in portion if r["text"]]
            for some in (portion[k : k + 60_000] for k in range(0, len(portion), 60_000)):
                words = Words([utf8(r["text"]) for r in some])
                h, whole = words.windows(block, 1)
                indexed = words.places()[: len(h)] % block == 0
                ids = np.array([r["id"] for r in some], np.int64)
                yield from _send(ids, words.owner[: len(h)][whole], h[whole], None, indexed[whole], buckets, parts)

    return mapped(lambda batches: _arrow(rows(batches)))


def _meet(table: pa.Table, buckets: int, parts: int, both: bool) -> Iterator[tuple]:
    """What one bucket tells the documents; replies pass through."""
    if not table.num_rows:
        return
    bucket = table["bucket"][0].as_py()
    if bucket >= buckets:
        yield from zip(*(table[c].to_pylist() for c in ("bucket", "part", "packed")))
        return
    low, check, doc, flag, reply = (np.concatenate(x) for x in zip(*map(_unpack, table["packed"].to_pylist())))
    told = np.zeros(len(low), bool)
    # An eighth of the hashes at a time, so that sorting needs little memory besides the entries.
    for k in range(8):
        part = np.flatnonzero((low & np.uint64(7)) == np.uint64(k))
        if len(part):
            part = part[np.argsort(low[part], kind="stable") if both else np.lexsort((check[part], low[part]))]
            told[part] = _settle(low[part], check[part], doc[part], flag[part], both)[0] & reply[part]
    yield from _replies(doc[told], _answer(low[told], check[told]), bucket, parts)


def _exchanged(sent: DataFrame, buckets: int, parts: int, both: bool) -> DataFrame:
    """``(_told, packed)``: what the whole corpus decides, for each group of documents."""

    def meet(table: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("packed", pa.binary())])
        return pa.Table.from_batches(list(_arrow(_meet(table, buckets, parts, both))), schema).select(["part", "packed"]).rename_columns(["_told", "packed"])

    return sent.groupBy("bucket").applyInArrow(grouped(meet), "_told int, packed binary")


def _window_hashes(words: Words, window: int):
    h, whole = words.windows(window, 2)
    check = words.windows(window, 3)[0] & _bits(_CHECK)
    return h, check, whole


def _rows(table: pa.Table, *names: str) -> Iterator[dict]:
    for at in range(0, table.num_rows, 256):
        yield from table.select(list(names)).slice(at, 256).to_pylist()


def _extended(buckets: int, parts: int, window: int, id_col: str, text_col: str):
    """Second round: every window around a hit, all of them indexed."""
    block = (window + 1) // 2

    def rows(docs: pa.Table, replies: pa.Table):
        told = _told(replies["packed"].to_pylist())
        some = [r for r in _rows(docs, id_col, text_col) if r[id_col] in told]
        for part in (some[k : k + 60_000] for k in range(0, len(some), 60_000)):
            words = Words([utf8(r[text_col]) for r in part])
            small, whole = words.windows(block, 1)
            answers = _answer(small & _bits(_PROBE), np.zeros(1, np.uint64))
            hit = np.zeros(len(words.owner) + 1, np.int64)
            for k, row in enumerate(part):
                at = slice(words.first[k], min(words.first[k + 1], len(small)))
                hit[at] = np.isin(answers[at], told[row[id_col]]) & whole[at]
            hits = np.concatenate([[0], np.cumsum(hit)])
            h, check, whole = _window_hashes(words, window)
            at = np.arange(len(h))
            whole &= hits[at + block] > hits[at]
            ids = np.array([r[id_col] for r in part], np.int64)
            yield from _send(ids, words.owner[: len(h)][whole], h[whole], check[whole], np.ones(whole.sum(), bool), buckets, parts)

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("packed", pa.binary())])
        return pa.Table.from_batches(list(_arrow(rows(docs, replies))), schema)

    return cogrouped(run)


def _cut(window: int, id_col: str, text_col: str):
    """Last pass: the words outside removed windows, joined by one space."""

    def kept(data: bytes, told: np.ndarray | None) -> tuple[bytes, int, int]:
        words = data.split()
        if told is None:
            return b" ".join(words), len(words), 0
        h, check, _ = _window_hashes(Words([data]), window)
        covered = np.zeros(len(words) + 1, np.int64)
        gone = np.flatnonzero(np.isin(_answer(h & _bits(_EXACT), check), told))
        np.add.at(covered, gone, 1)
        np.add.at(covered, gone + window, -1)
        keep = np.flatnonzero(np.cumsum(covered)[:-1] == 0)
        return b" ".join([words[i] for i in keep.tolist()]), len(words), len(words) - len(keep)

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        told = _told(replies["packed"].to_pylist()) if replies.num_rows else {}
        out = [kept(utf8(r[text_col]), told.get(r[id_col])) for r in _rows(docs, id_col, text_col)]
        made = docs.select([c for c in docs.column_names if c not in ("_part", text_col)])
        made = made.append_column(text_col, pa.array([o[0].decode("utf-8", "surrogatepass") for o in out], pa.string()))
        made = made.append_column("n_words", pa.array([o[1] for o in out], pa.int64()))
        return made.append_column("n_removed", pa.array([o[2] for o in out], pa.int64()))

    return cogrouped(run)


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated words cut from the text, and the columns ``n_words`` and ``n_removed``.

    A word goes if a window of ``window`` consecutive words of its document covers it whose words also
    start in a document with a smaller id; windows are judged on the input. The text that is left
    is its words joined by one space; a null text becomes empty. A row with a null id neither
    loses words nor makes others lose any; rows of one id are one document to others and do
    not cut each other. ``window`` is odd. An empty table gives an empty one. Columns of the new names
    are replaced, other columns are kept.
    """
    if window % 2 == 0:
        raise ValueError("an odd window holds a block of half its words at any offset")
    docs = small_batches(docs).drop("n_words", "n_removed", "_part").withColumn(id_col, F.col(id_col).cast("long"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets, parts = max(8, -(-total // BUCKET_BYTES)), max(64, -(-total // GROUP_BYTES))
    named = docs.filter(F.col(id_col).isNotNull())
    dealt = named.withColumn("_part", F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int")).groupBy("_part")
    probes = named.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hits = _exchanged(probes.mapInArrow(_block_hashes(buckets, parts, window), _SENT), buckets, parts, both=True)
    # The texts are dealt out by group once: both cogroups read the same exchange.
    near = dealt.cogroup(hits.groupBy("_told")).applyInArrow(_extended(buckets, parts, window, id_col, text_col), _SENT)
    repeats = _exchanged(near, buckets, parts, both=False)
    names = [c for c in docs.columns if c != text_col]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names]
    schema = ", ".join([*fields, f"`{text_col}` string", "n_words long", "n_removed long"])
    cut = dealt.cogroup(repeats.groupBy("_told")).applyInArrow(_cut(window, id_col, text_col), schema)
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rest = docs.filter(F.col(id_col).isNull()).withColumn("n_words", F.size(words).cast("long"))
    rest = rest.withColumns({text_col: F.array_join(words, " "), "n_removed": F.lit(0).cast("long")})
    return cut.unionByName(rest).select(*docs.columns, "n_words", "n_removed")
