"""Byte-level BPE over a corpus: each distinct word is encoded once, wherever it stands.

A portion of documents is cut into pre-tokens; its distinct words and the word numbers at every
position are one packed row. The distinct words of all portions are shuffled by word, the merges run
once for each of them, their ids go back to the portions that hold the word, and each document is put
together by position. Decoding looks ids up in the token-byte table, which has as many rows as
the vocabulary and travels with the task.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.text import grouped, mapped, portions, small_batches
from tidewright.session import settled_rows

PORTION = 4 << 20  # characters whose words are shuffled together
REMEMBERED = 1 << 16  # pieces of text kept with their words
BUCKET = 16 << 20  # characters of the corpus per bucket of words


@functools.lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    """A rank file: one token in base64 and its id on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@functools.lru_cache(4)
def splitters(pattern: str) -> tuple[re.Pattern, regex.Pattern]:
    """``pattern`` with the blanks, letters and numbers that the encoding library knows, not those of another
    Unicode version: for texts within the basic plane, whose sets are table lookups, and for all others."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    small = large = pattern
    for name in (r"\s", r"\p{L}", r"\p{N}"):
        probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=single, special_tokens={})
        codes = np.array([ord(c) for c in bytes(probe.encode_ordinary(every)).decode()])
        small, large = _spelled(small, name, codes[codes < 0x10000]), _spelled(large, name, codes)
    return re.compile(small), regex.compile(large)


def _spelled(pattern: str, name: str, codes: np.ndarray) -> str:
    """``pattern`` with a class spelled out as ranges: inside a set as they are, elsewhere as a set."""
    cuts = np.flatnonzero(np.diff(codes) != 1)
    firsts, lasts = codes[np.concatenate([[0], cuts + 1])], codes[np.concatenate([cuts, [-1]])]
    inside = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(firsts, lasts))
    pattern = re.sub(r"(\[[^\]]*)" + re.escape(name), lambda m: m[1] + inside, pattern)
    pattern = pattern.replace(name, f"[{inside}]")
    return pattern.replace(r"\S", f"[^{inside}]") if name == r"\s" else pattern


_BLANK_THEN_SPACE = re.compile(r"\s ")
_BEYOND_BASIC = re.compile("[\U00010000-\U0010ffff]")


def pre_tokens(text: str, known: dict[str, tuple]) -> Iterable[int]:
    """Numbers of the pre-tokens of ``text`` by ``known``, which maps pieces of text to such numbers.

    No match goes on from a non-blank to a space, so pieces that start at such a space can be cut
    alone and remembered. A text with a space after another blank is cut as a whole.
    """
    if _BLANK_THEN_SPACE.search(text):
        return known[text]
    first, *rest = text.split(" ")
    return chain.from_iterable(map(known.__getitem__, [first, *[f" {piece}" for piece in rest]]))


class _Pieces(dict):
    """Pieces of text and the numbers of their words, in order of first appearance."""

    def __init__(self, pattern: str):
        self.small, self.large = splitters(pattern)
        self.words = defaultdict(count().__next__)

    def __missing__(self, piece: str) -> tuple:
        cut = self.small if piece.isascii() or not _BEYOND_BASIC.search(piece) else self.large
        found = tuple(map(self.words.__getitem__, cut.findall(piece)))
        if len(piece) < 64:
            self[piece] = found
        return found


def _press(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 in byte planes, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpress(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _zip(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), "<u4", len(words))
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(words)).tobytes() + sizes.tobytes() + b"".join(words))


def _unzip(data: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = (np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


_PORTION = pa.schema(
    [
        ("portion", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("sizes", pa.binary()),
        ("places", pa.binary()),
        ("words", pa.list_(pa.struct([("bucket", pa.int32()), ("numbers", pa.binary()), ("words", pa.binary())]))),
    ]
)
_PORTION_SQL = "portion long, ids array<long>, sizes binary, places binary, words array<struct<bucket int, numbers binary, words binary>>"


def _portion(rows: list[dict], number: int, pattern: str, buckets: int) -> dict:
    """Ids and sizes of some documents, the word number at every position, and the words by bucket."""
    pieces, places = _Pieces(pattern), []
    for row in rows:
        places.append(np.fromiter(pre_tokens(row["text"] or "", pieces), np.uint32))
        if len(pieces) > REMEMBERED:
            pieces.clear()
    at = np.concatenate(places)
    # Frequent words get small numbers, which pack well.
    order = np.argsort(-np.bincount(at, minlength=len(pieces.words)), kind="stable")
    renumbered = np.empty(len(order), np.uint32)
    renumbered[order] = np.arange(len(order), dtype=np.uint32)
    words = np.empty(len(order), object)
    words[:] = [w.encode() for w in pieces.words]
    pieces.clear()
    words = words[order]
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    by_bucket = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
    lists = []
    for b in np.flatnonzero(np.diff(cuts)):
        own = by_bucket[cuts[b] : cuts[b + 1]]
        lists.append({"bucket": b, "numbers": _press(np.diff(own, prepend=0)), "words": _zip(words[own].tolist())})
    return {
        "portion": number,
        "ids": [r["doc_id"] for r in rows],
        "sizes": _press(np.fromiter(map(len, places), np.uint32, len(places))),
        "places": _press(renumbered[at] if len(at) else at),
        "words": lists,
    }


def _cut(pattern: str, buckets: int):
    """One row per portion of the documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, rows in enumerate(portions(batches, "text", PORTION)):
            yield pa.RecordBatch.from_pylist([_portion(rows, task << 32 | number, pattern, buckets)], _PORTION)

    return run


def _words_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).select(["portion", "words"]).to_pylist()[0]
            lists = row["words"]
            yield pa.RecordBatch.from_pydict(
                {
                    "portion": pa.array([row["portion"]] * len(lists), pa.int64()),
                    "bucket": pa.array([w["bucket"] for w in lists], pa.int32()),
                    "numbers": pa.array([w["numbers"] for w in lists], pa.binary()),
                    "words": pa.array([w["words"] for w in lists], pa.binary()),
                }
            )


def _encode_bucket(path: str, table_of, pattern: str):
    """The ids of the words of one bucket; a word that many portions sent is encoded once."""

    def run(table: pa.Table) -> pa.Table:
        encoder = _encoder(path, table_of, pattern)
        known, rows = {}, []
        for portion, numbers, words in zip(*(table[c].to_pylist() for c in ("portion", "numbers", "words"))):
            found = []
            for word in _unzip(words):
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = encoder._encode_single_piece(word)
                found.append(ids)
            sizes = np.fromiter(map(len, found), np.uint32, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
            rows.append({"portion": portion, "numbers": numbers, "sizes": _press(sizes), "ids": _press(flat)})
        schema = pa.schema([("portion", pa.int64()), ("numbers", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())])
        return pa.Table.from_pylist(rows, schema)

    return run


_encoders: dict = {}


def _encoder(path: str, table_of, pattern: str) -> tiktoken.Encoding:
    """Built once in a Python worker; a file is known by its path."""
    key = (path, pattern)
    if key not in _encoders:
        _encoders[key] = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table_of.value, special_tokens={})
    return _encoders[key]


def _joined(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + size]`` one after the other."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def _assembled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).select(["ids", "sizes", "places", "encoded"]).to_pylist()[0]
            numbers, sizes, ids = [], [], []
            for part in row["encoded"] or ():
                numbers.append(np.cumsum(_unpress(part["numbers"]), dtype=np.int64))
                sizes.append(_unpress(part["sizes"]).astype(np.int64))
                ids.append(_unpress(part["ids"]))
            places = _unpress(row["places"])
            counts = _unpress(row["sizes"]).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            if numbers:
                numbers, sizes, flat = map(np.concatenate, (numbers, sizes, ids))
                size_of, start_of = np.empty(len(numbers), np.int64), np.empty(len(numbers), np.int64)
                size_of[numbers], start_of[numbers] = sizes, np.cumsum(sizes) - sizes
            step = 512  # documents in one batch
            for a in range(0, len(counts), step):
                b = min(a + step, len(counts))
                at = places[bounds[a] : bounds[b]]
                if len(at):
                    tokens = _joined(flat, start_of[at], size_of[at])
                    ends = np.concatenate([[0], np.cumsum(size_of[at])])[bounds[a : b + 1] - bounds[a]]
                else:
                    tokens, ends = np.zeros(0, np.uint32), np.zeros(b - a + 1, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"][a:b], pa.int64()), lists], ["doc_id", "ids"])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of every row: the ids of the whole text, without special tokens.

    Each match of ``pattern`` is encoded by itself with the ranks of the file ``path``, which the driver
    reads; the table has as many rows as the vocabulary. A null text is empty and gives no ids.
    Repeated rows and rows with a null id are encoded like others; an empty table gives an empty one.
    The portions are dealt out once, by an exchange that both later steps read; so that a lost
    task makes the same portions again, a table that is not read from storage is written down first.
    """
    spark = small_batches(docs).sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if "Exchange" in slim._jdf.queryExecution().executedPlan().toString():
        slim = settled_rows(slim)
    total = slim.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET))
    table = spark.sparkContext.broadcast(ranks(path))
    portioned = slim.mapInArrow(mapped(_cut(pattern, buckets)), _PORTION_SQL).repartition("portion")
    words = portioned.mapInArrow(mapped(_words_of), "portion long, bucket int, numbers binary, words binary")
    encoded = words.groupBy("bucket").applyInArrow(
        grouped(_encode_bucket(path, table, pattern)), "portion long, numbers binary, sizes binary, ids binary"
    )
    back = encoded.groupBy(F.col("portion").alias("of")).agg(F.collect_list(F.struct("numbers", "sizes", "ids")).alias("encoded"))
    # Both readers take all columns, which lets Spark use one exchange for them.
    whole = portioned.join(back, F.col("portion") == F.col("of"), "left")
    return whole.mapInArrow(mapped(_assembled), "doc_id long, ids array<int>")


class TokenBytes:
    """The token-byte table: the bytes of every id, end to end."""

    def __init__(self, table: dict[bytes, int]):
        by_id = [b""] * (max(table.values(), default=-1) + 1)
        for token, rank in table.items():
            by_id[rank] = token
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)
        self.sizes = np.fromiter(map(len, by_id), np.int64, len(by_id))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray) -> bytes:
        return _joined(self.flat, self.starts[ids], self.sizes[ids]).tobytes()


_tables: dict = {}


def _token_bytes(path: str, table_of) -> TokenBytes:
    if path not in _tables:
        _tables[path] = TokenBytes(table_of.value)
    return _tables[path]


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield values[a:b]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the column ``decoded``: the bytes that its ids stand for; null ids give none."""
    table = encoded.sparkSession.sparkContext.broadcast(ranks(path))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_token_bytes(path, table).decode(ids) for ids in _lists(batch["ids"])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(mapped(run), f"{fields}, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, ids)``; ids are hashed as little-endian 32-bit numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in _lists(batch["ids"])]
            names = ["doc_id", "ids", "decoded", "ids_sha256"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names[:3]), pa.array(hashes, pa.string())], names)

    hashed = decoded.select("doc_id", "ids", "decoded").mapInArrow(mapped(run), "doc_id long, ids array<int>, decoded binary, ids_sha256 string")
    return hashed.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "ids"
    )
