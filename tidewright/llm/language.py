"""Language of a text by a bidirectional gated recurrent network over its bytes.

A text is read in stretches of ``STRETCH`` bytes, all of them, some thousand stretches side by side. In each stretch
one network reads forwards and one backwards; both states at a byte give that byte's language
probabilities, and a document's are the mean over all its bytes. Every byte counts, and what a
task holds is bounded however long a text is. Weights are trained with numpy by
backpropagation through time, on a bounded sample of labelled stretches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.text import mapped, small_batches, utf8

STRETCH = 128  # bytes read without a break
SIDE_BY_SIDE = 2048  # stretches read together
STATE = 8  # numbers a network remembers
TRAINING_ROWS = 4096  # labelled documents the network learns from, shared by the languages
MOST_LANGUAGES = 256  # the most frequent ones are learned
STEPS, BATCH, RATE = 300, 64, 0.02
UNKNOWN = "und"

_PAD = 256  # a byte beyond the end, at which the state stands still
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """``into`` (direction, byte, gate, state) and ``back`` (direction, gate, state, state) are the gates
    keep, reset and new; ``out`` (direction, state, language) and ``bias`` label a byte."""

    languages: list[str]
    into: np.ndarray
    back: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def states(self, symbols: np.ndarray, keep: list | None = None) -> np.ndarray:
        """``(direction, byte, stretch, state)`` of ``(stretch, byte)`` symbols, each direction in its own reading order."""
        n, length = symbols.shape
        both = np.ascontiguousarray(np.stack([symbols.T, symbols.T[::-1] + _PAD + 1], axis=1))
        gates = [np.ascontiguousarray(self.into[:, :, g]).reshape(-1, STATE) for g in range(3)]
        states = np.empty((2, length, n, STATE), np.float32)
        state = np.zeros((2, n, STATE), np.float32)
        switches, new, old = np.empty((2, 2, n, STATE), np.float32), np.empty_like(state), np.empty_like(state)
        for t in range(length):
            at = both[t].ravel()
            for g in range(2):
                np.matmul(state, self.back[:, g], out=switches[g])
                switches[g] += np.take(gates[g], at, axis=0).reshape(state.shape)
            np.negative(switches, out=switches)
            np.exp(switches, out=switches)
            switches += 1
            np.reciprocal(switches, out=switches)
            np.matmul(state, self.back[:, 2], out=old)
            np.multiply(switches[1], old, out=new)
            new += np.take(gates[2], at, axis=0).reshape(state.shape)
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((at, state, switches.copy(), old.copy(), new.copy()))
                state = new + switches[0] * (state - new)
            else:
                state -= new
                state *= switches[0]
                state += new
            states[:, t] = state
        return states

    def labels(self, states: np.ndarray) -> np.ndarray:
        """``(byte, stretch, language)`` probabilities of every byte."""
        scores = states[0] @ self.out[0]
        scores += (states[1] @ self.out[1])[::-1]
        scores += self.bias
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=2, keepdims=True)
        return scores


def _stretches(texts: list[bytes], length: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all stretches of the texts, and the text each is of."""
    counts = np.array([-(-len(t) // length) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    symbols = np.full(int(counts.sum()) * length, _PAD, np.int32)
    for text, start in zip(texts, (np.cumsum(counts) - counts).tolist()):
        symbols[start * length : start * length + len(text)] = np.frombuffer(text, np.uint8)
    return symbols.reshape(-1, length), owner


def _fresh(languages: list[str], rng: np.random.Generator) -> Model:
    into = rng.normal(0, 0.3, (2, _PAD + 1, 3, STATE)).astype(np.float32)
    into[:, _PAD] = 0
    into[:, _PAD, 0] = 60  # keep everything
    back = rng.normal(0, 0.3, (2, 3, STATE, STATE)).astype(np.float32)
    return Model(languages, into, back, rng.normal(0, 0.3, (2, STATE, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))


def gradients(model: Model, symbols: np.ndarray, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all bytes, and its derivatives, by backpropagation through time."""
    kept: list[tuple] = []
    states = model.states(symbols, kept)
    n, length = symbols.shape
    share = model.labels(states)
    real = (symbols.T != _PAD)[:, :, None]
    total = real.sum()
    at = np.arange(n)
    loss = -np.log(np.maximum(share[:, at, truth], 1e-30))[:, :, None][real].sum() / total
    pull = share
    pull[:, at, truth] -= 1
    pull = (pull * real / total).astype(np.float32)
    pulls = np.stack([pull, pull[::-1]])
    d_out = np.einsum("dtns,dtnk->dsk", states, pulls)
    into_states = pulls @ model.out.transpose(0, 2, 1)[:, None]
    d_into = np.zeros((2 * (_PAD + 1), 3, STATE), np.float32)
    d_back = np.zeros_like(model.back)
    carry = np.zeros((2, n, STATE), np.float32)
    turned = model.back.transpose(0, 1, 3, 2)
    d_gates = np.empty((length, 2, n, 3, STATE), np.float32)
    for t in range(length - 1, -1, -1):
        _, before, (stay, reset), old, new = kept[t]
        carry = carry + into_states[:, t]
        d_new = carry * (1 - stay) * (1 - new * new)
        d_stay = carry * (before - new) * stay * (1 - stay)
        d_old = d_new * reset
        d_reset = d_new * old * reset * (1 - reset)
        for g, d in enumerate((d_stay, d_reset, d_new)):
            d_gates[t, :, :, g] = d
        for g, d in enumerate((d_stay, d_reset, d_old)):
            d_back[:, g] += before.transpose(0, 2, 1) @ d
        carry = carry * stay + d_stay @ turned[:, 0] + d_reset @ turned[:, 1] + d_old @ turned[:, 2]
    seen = np.concatenate([k[0] for k in kept])
    order = np.argsort(seen, kind="stable")
    firsts = np.flatnonzero(np.diff(seen[order], prepend=-1))
    d_into[seen[order][firsts]] = np.add.reduceat(d_gates.reshape(-1, 3, STATE)[order], firsts, axis=0)
    d_into = d_into.reshape(model.into.shape)
    d_into[:, _PAD] = 0
    return float(loss), {"into": d_into, "back": d_back, "out": d_out, "bias": pull.sum(axis=(0, 1))}


def fit(symbols: np.ndarray, truth: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 1) -> Model:
    """Adam over batches of stretches, in an order that only ``seed`` decides."""
    rng = np.random.default_rng(seed)
    model = _fresh(languages, rng)
    if len(languages) < 2:
        return model
    first = {c: np.zeros_like(getattr(model, c)) for c in ("into", "back", "out", "bias")}
    second = {c: np.zeros_like(v) for c, v in first.items()}
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < min(BATCH, len(truth)):
            order = rng.permutation(len(truth))
        batch, order = order[:BATCH], order[BATCH:]
        _, found = gradients(model, symbols[batch], truth[batch])
        size = np.sqrt(sum(float((g * g).sum()) for g in found.values()))
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for name, g in found.items():
            g = g / max(1.0, size)
            first[name] += 0.1 * (g - first[name])
            second[name] += 0.01 * (g * g - second[name])
            move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
            getattr(model, name)[...] -= rate * move
    return model


def train(labelled: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most ``rows`` labelled documents, as many of each language, the ones whose ids hash lowest.

    Languages are counted over all rows; the ``MOST_LANGUAGES`` most frequent are learned. A document gives two
    stretches at places that its id decides. Rows without an id, a language or a letter in the text are left out, repeated rows
    of an id are one. Only the bounded sample reaches the driver. Without labelled rows no language is known.
    """
    known = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    ids = known.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    counted = ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in counted)
    if not languages:
        return _fresh([], np.random.default_rng(1))
    each = max(1, rows // len(languages))
    place = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1 << 40))
    # About twice the documents wanted of each language; the lowest of these are the sample.
    limit = F.element_at(F.create_map(*[F.lit(x) for r in counted for x in (r["lang"], min(1.0, 2 * (each + 16) / r["count"]) * 2.0**40)]), F.col("lang"))
    near = ids.filter(F.col("lang").isin(languages)).withColumn("place", place).filter(F.col("place") < limit)
    numbered = near.selectExpr("doc_id AS _of", "lang", "row_number() OVER (PARTITION BY lang ORDER BY place, doc_id) AS k")
    sample = numbered.filter(F.col("k") <= each).select("_of", F.col("lang").alias("_lang"))
    chosen = small_batches(known).join(F.broadcast(sample), (F.col("doc_id") == F.col("_of")) & (F.col("lang") == F.col("_lang")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.select(["doc_id", "text", "lang"]).to_pylist():
                data, parts = utf8(row["text"]), []
                rng = np.random.default_rng(zlib.crc32(str(row["doc_id"]).encode()))
                for _ in range(2):
                    at = int(rng.integers(0, max(1, len(data) - STRETCH + 1)))
                    parts.append(data[at : at + STRETCH])
                found.append((row["doc_id"], row["lang"], *parts))
            types = [batch.schema.field("doc_id").type, pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), types)], ["doc_id", "lang", "one", "two"])

    kind = known.schema["doc_id"].dataType.simpleString()
    cut = chosen.select("doc_id", "text", "lang").mapInArrow(mapped(run), f"doc_id {kind}, lang string, one binary, two binary")
    made = cut.groupBy("doc_id").agg(F.min(F.struct("lang", "one", "two")).alias("first")).select("doc_id", "first.*").toArrow().sort_by("doc_id")
    stretches = [s for pair in zip(made["one"].to_pylist(), made["two"].to_pylist()) for s in pair]
    truth = np.repeat([languages.index(x) for x in made["lang"].to_pylist()], 2)
    return fit(_stretches(stretches)[0], truth, languages)


def pooled(model: Model, texts: list[bytes]) -> np.ndarray:
    """``(text, language)``: mean probabilities over the bytes of each text; zeros for an empty one."""
    total = np.zeros((len(texts), len(model.languages)))
    sizes = np.array([max(1, len(t)) for t in texts], np.float64)
    symbols, owner = _stretches(texts)
    for k in range(0, len(owner), SIDE_BY_SIDE):
        some = symbols[k : k + SIDE_BY_SIDE]
        share = model.labels(model.states(some))
        share *= (some.T != _PAD)[:, :, None]
        np.add.at(total, owner[k : k + SIDE_BY_SIDE], share.sum(axis=0, dtype=np.float64))
    return total / sizes[:, None]


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the mean probability of that language over all bytes.

    A null text or one without a letter is ``und`` with score 0, as is every text if no language is known; of
    equally likely languages the first by code point is taken. Rows are judged one by one by their text alone, so null ids, repeated rows and other
    columns do not matter; columns of the new names are replaced.
    """
    docs = small_batches(docs).drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def pieces(texts: Iterable[tuple[int, bytes]]) -> Iterator[list[tuple[int, bytes]]]:
        """Texts in lists of a few MB; a longer text goes on in the next list, at the start of a stretch."""
        held, size, most = [], 0, 8 * SIDE_BY_SIDE * STRETCH
        for k, text in texts:
            for at in range(0, len(text), most):
                part = text[at : at + most]
                if size + len(part) > most and held:
                    yield held
                    held, size = [], 0
                held.append((k, part))
                size += len(part)
        if held:
            yield held

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch[text_col].to_pylist()
            read = [(k, utf8(t)) for k, t in enumerate(texts) if known.languages and t and _LETTER.search(t)]
            total = np.zeros((len(texts), max(1, len(known.languages))))
            for some in pieces(read):
                sizes = np.array([len(t) for _, t in some])[:, None]
                np.add.at(total, [k for k, _ in some], pooled(known, [t for _, t in some]) * sizes)
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for k, text in read:
                best = int(total[k].argmax())
                names[k], scores[k] = known.languages[best], min(1.0, round(total[k, best] / len(text), 9))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(mapped(run), f"{fields}, lang_pred string, score double")
