import numpy as np

from tidewright.llm import text


def test_hashes_depend_on_the_bytes_alone():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in rng.integers(1, 30, 30_000)] + [b"x" * 300_000, b"y" * 70_000, b"end"]
    once = {w: h for w, h in zip(words, text.Words([b" ".join(words)]).hashes)}
    assert len(set(once.values())) == len(set(words))
    some = [words[k] for k in rng.integers(0, len(words), 50)]
    for w, h in zip(some, text.Words([b"\t".join(some[:20]), b" ".join(some[20:])]).hashes):
        assert once[w] == h
    assert text._powers["size"] <= 8 * text._BLOCK
    assert len(text.Words([b"", b" \n "]).hashes) == 0


def test_spans_within_words():
    buffer = np.frombuffer(b"abc abd " * 20_000, np.uint8)
    words = text.Words([buffer.tobytes()])
    heads = words.spans.of(words.starts, words.starts + 2)
    assert len(set(heads.tolist())) == 1 and len(set(words.hashes.tolist())) == 2
