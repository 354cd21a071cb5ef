"""Plain versions of the operators, one document or one pair at a time."""

import hashlib
import re

import public_tokenizers
import tiktoken
import xxhash

from tidewright.llm import bpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def fingerprint(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, linked):
    """Smallest id of each group; ``linked(i, j)`` on positions."""
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                label[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(x, least.get(root(i), x))
    return [least[root(i)] for i in range(len(ids))]


def cut(docs, window=13):
    """``{doc_id: (n_words, n_removed, kept text)}`` of ``{doc_id: text}``."""
    words = {i: WORD.findall(t or "") for i, t in docs.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = {k + o for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for o in range(window)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def encoder(path):
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})


def sha(data):
    return hashlib.sha256(data).hexdigest()
