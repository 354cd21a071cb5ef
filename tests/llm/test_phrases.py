import random
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.brute import lower
from tidewright.llm import phrases


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_BUCKETS", 3)


def plain(rows, least, longest=5, best=2000):
    total, counts = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {w: n for w, n in f.items() if n >= least}
        inside = defaultdict(int)
        for w, n in often.items():
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    inside[w[i : i + k]] = max(inside[w[i : i + k]], n)
        found = []
        for w, a in often.items():
            if len(w) > 1 and inside[w] < a:
                score, k = min((1000 * a * total[lang] // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
                found.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["Éa", "ßz", "\U0001f600x", "a\x00b"]
    fixed = ["red green blue", "one two three four five six", "Tick tick tick tick"]
    rows = []
    for _ in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(0, 40))
        for _ in range(rng.randrange(3)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(fixed))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for w in words)
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    return rows


@pytest.mark.parametrize("least, longest", [(2, 5), (5, 5), (5, 3), (1, 4)])
def test_equal_to_a_plain_version(spark, least, longest):
    rows = corpus(least * 10 + longest)
    docs = spark.createDataFrame([(lang, text, 0, 0) for lang, text in rows], "lang string, text string, n int, rank int").repartition(5)
    got = phrases.mined(docs, least, longest, per_language=50)
    assert sorted(map(tuple, got.collect())) == plain(rows, least, longest, 50)


def test_repeats_within_long_texts(spark):
    rows = corpus(3, 40) + [("en", "red green blue " * 200_000), ("en", "x" * 1_500_000 + " red green"), ("de", None), ("de", "")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.mined(docs, 5).collect())) == plain(rows, 5)


def test_a_phrase_that_holds_a_third_of_all_words(spark):
    rows = [("en", "hot hot hot hot. hot hot")] * 300 + [("en", f"cold{k} hot") for k in range(300)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(16)
    assert sorted(map(tuple, phrases.mined(docs, 100).collect())) == plain(rows, 100)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.mined(docs).collect() == []
    assert phrases.mined(spark.createDataFrame([(None, None), ("en", "a b")], "lang string, text string")).collect() == []


def test_large_products_stay_exact(spark):
    """Parts that occur once beside ones that occur often, at counts whose products are large."""
    rows = [("en", "a b " * 30_000), ("en", "c d")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.mined(docs, 1).collect())) == plain(rows, 1)
