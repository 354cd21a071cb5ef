"""Words and hashes of UTF-8 texts as numpy arrays, a batch of documents at a time.

A word is ``[^\\x20\\x09-\\x0D]+``. Texts of a batch are laid end to end with a line feed
between them, so that one vector operation serves many documents and no word crosses two.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_ROWS = 512

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

_BLOCK = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(7).integers(1, 2**64, 256, dtype=np.uint64)
_powers = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each; a table for a very long word is not kept."""
    if n <= _powers.get("size", 0):
        return _powers["up"], _powers["down"]
    size = 1 << max(n, 2 * _BLOCK).bit_length()
    tables = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        tables.append(np.cumprod(steps))
    if size <= 8 * _BLOCK:
        _powers.update(up=tables[0], down=tables[1], size=size)
    return tables[0], tables[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(buffer: np.ndarray, outside: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ``outside``."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = ~outside[buffer]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


class Hashes:
    """Hashes of spans that start at or within words of one buffer, from prefix sums of a polynomial.

    The polynomial begins anew at the first of ``starts`` in each block of bytes, so short tables of powers
    serve a buffer of any length. A span must not go beyond the word it starts in.
    """

    def __init__(self, buffer: np.ndarray, starts: np.ndarray):
        firsts = starts[np.flatnonzero(np.diff(starts // _BLOCK, prepend=-1))]
        self.bases = np.unique(np.concatenate([[0], firsts]))
        ends = np.append(self.bases[1:], len(buffer))
        up, self.down = _power_table(int((ends - self.bases).max(initial=0)) + 1)
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        for a, b in zip(self.bases.tolist(), ends.tolist()):
            self.sums[a + 1 : b + 1] = _BYTES[buffer[a:b]] * up[: b - a]
        np.cumsum(self.sums, out=self.sums)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        within = starts - self.bases[np.searchsorted(self.bases, starts, "right") - 1]
        return mix((self.sums[ends] - self.sums[starts]) * self.down[within])


def rolling(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of the ``width`` words from each place on; the last ``width - 1`` places have none."""
    n = max(0, len(words) - width + 1)
    total = np.zeros(n, np.uint64)
    for k, factor in enumerate(np.random.default_rng(seed).integers(1, 2**64, width, dtype=np.uint64) | np.uint64(1)):
        total += words[k : k + n] * factor
    return mix(total)


class Words:
    """The words of a list of texts: ``hashes``, the text each is in (``owner``), and its place there."""

    def __init__(self, texts: list[bytes], outside: np.ndarray = BLANK):
        self.buffer = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.starts, self.ends = spans(self.buffer, outside)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(texts)), self.counts)
        self.spans = Hashes(self.buffer, self.starts)
        self.hashes = self.spans.of(self.starts, self.ends)

    def places(self) -> np.ndarray:
        return np.arange(len(self.owner)) - self.first[self.owner]

    def windows(self, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Rolling hashes, and which of them lie within one text."""
        h = rolling(self.hashes, width, seed)
        return h, self.owner[: len(h)] == self.owner[width - 1 : width - 1 + len(h)]


def small_batches(docs: DataFrame) -> DataFrame:
    """Have texts handed to Python some hundred at a time, so that a batch is a few MB on either side.

    The setting holds for the session, as frames are run later; a smaller one stays.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return docs


def utf8(text: str | None) -> bytes:
    """A text's bytes; a null is an empty text."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def portions(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[list[dict]]:
    """Rows in lists of about ``limit`` characters; a longer text makes a list of its own."""
    rows, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for row in batch.slice(at, 256).to_pylist():
                n = len(row[text] or "")
                if rows and size + n > limit:
                    yield rows
                    rows, size = [], 0
                rows.append(row)
                size += n
    if rows:
        yield rows


def give_back() -> None:
    """Hand what a task has freed back to the system, as the Python worker goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(run: Callable) -> Callable:
    """A function of Arrow batches that gives freed memory back at its end."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def grouped(run: Callable) -> Callable:
    """A function of the Arrow table of a group that gives freed memory back at its end."""

    def whole(table: pa.Table) -> pa.Table:
        out = run(table)
        del table
        give_back()
        return out

    return whole


def cogrouped(run: Callable) -> Callable:
    """A function of the Arrow tables of a group on two sides that gives freed memory back at its end."""

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        del left, right
        give_back()
        return out

    return whole
