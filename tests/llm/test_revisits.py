import random

import pytest

from tests.oracle import compare
from tidewright.llm import queries, revisits

SCHEMA = "record_id long, kind string, url string, captured long, headers map<string,string>, digest string, part int"


def by_hand(rows, keys):
    out = []
    for i, kind, url, at, headers, digest, _ in rows:
        if kind != "revisit":
            continue
        headers = headers or {}
        full = [r for r in rows if r[1] == "response" and keys[url] is not None and keys[r[2]] == keys[url] and at is not None and r[3] is not None and r[3] < at]
        best = max(full, key=lambda r: (r[3], r[0]), default=None)
        if best is None:
            out.append((i, None, "no_original", headers, None))
            continue
        stored = best[4] or {}

        def tag(h):
            return h["etag"].removeprefix("W/") if "etag" in h else None

        if tag(stored) and tag(headers):
            good = tag(stored) == tag(headers)
        elif "last-modified" in stored and "last-modified" in headers:
            good = stored["last-modified"] == headers["last-modified"]
        else:
            good = None
        outcome = {True: "resolved", False: "validator_mismatch", None: "no_validator"}[good]
        if good:
            renewed = {k: v for k, v in headers.items() if k not in revisits.KEPT_FIELDS}
            out.append((i, best[0], outcome, stored | renewed, best[5]))
        else:
            out.append((i, best[0], outcome, headers, None))
    return sorted(out, key=repr)


def canonical(spark, urls):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(u,) for u in urls], "url string")
    return {r.url: r.key for r in df.select("url", revisits.canonical_url(F.col("url")).alias("key")).collect()}


@pytest.mark.parametrize("segment", [1, 7, 4096])
def test_random_archives(spark, segment):
    rng = random.Random(segment)
    urls = ["http://A.com/x", "https://a.com:443/x/?utm_source=q", "http://a.com/y?b=2&a=1", "http://a.com/y?a=1&b=2#f", None, "nothing", "http://hot.com/"]
    rows = []
    for i in range(600):
        headers = {}
        if rng.random() < 0.7:
            headers["etag"] = rng.choice(["", "W/"]) + rng.choice('"1" "2"'.split())
        if rng.random() < 0.5:
            headers["last-modified"] = rng.choice("de")
        headers |= {"content-length": str(i), "date": str(i), "x": "y"} if rng.random() < 0.8 else {}
        kind = rng.choice(["response", "revisit"])
        url = "http://hot.com/" if rng.random() < 0.4 else rng.choice(urls)
        rows.append((i, kind, url, None if rng.random() < 0.02 else rng.randrange(120), headers if rng.random() < 0.95 else None, f"d{i}" if kind == "response" else None, 3))
    rows += [rows[5], rows[6]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.record_id, r.original_id, r.outcome, r.headers, r.digest) for r in revisits.resolved(df, segment).collect()), key=repr)
    norm = lambda out: sorted(repr((a, b, c, sorted(d.items()), e)) for a, b, c, d, e in out)
    assert norm(got) == norm(by_hand(rows, canonical(spark, set(urls))))


def test_canonical_urls(spark):
    want = {"HTTP://WWW.A.com:80/p/?b=1&utm_medium=x&a=2#frag": "www.a.com/p?a=2&b=1", "https://a.com": "a.com", "https://a.com/": "a.com",
            "http://a.com:8080/": "a.com:8080", "a.com/x": None, None: None, "x://h?utm_source=f": "h"}
    assert canonical(spark, list(want)) == want


def test_oracle(spark):
    for sf_dir in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        assert not compare(spark, sf_dir, "op8_revisits", queries.op8_revisits, queries.OP8_SQL)[0]


def test_hot_groups(spark):
    """A third of the rows at one moment of one URL and a third without URL: every segment is short, every visit resolved."""
    from pyspark.sql import functions as F

    n = 30_000
    at = F.when(F.col("id") % 3 == 0, 50).otherwise(F.col("id") % 1_000)
    df = spark.range(n).select(
        F.col("id").alias("record_id"), F.when(F.col("id") % 2 == 0, "response").otherwise("revisit").alias("kind"),
        F.when(F.col("id") % 3 == 0, "http://hot.com/").when(F.col("id") % 3 == 1, "http://hot.com/x").alias("url"), at.cast("long").alias("captured"),
        F.create_map(F.lit("etag"), F.lit("1")).alias("headers"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("digest"),
    )
    keyed = df.withColumn("url_key", revisits.canonical_url(F.col("url"))).filter("url_key IS NOT NULL")
    times = revisits.capture_times(keyed).groupBy("url_key", F.floor(F.col("captured") / 100)).count()
    assert times.agg(F.max("count")).first()[0] <= 2 * 100
    got = revisits.resolved(df, 100)
    assert got.count() == n // 2
    outcomes = {(r.url_key, r.outcome): r["count"] for r in got.groupBy("url_key", "outcome").count().collect()}
    assert outcomes[(None, "no_original")] == n // 6
    assert outcomes[("hot.com", "no_original")] == n // 6
    rows = [(r.record_id, r.captured, r.kind) for r in keyed.filter("url_key = 'hot.com/x'").collect()]
    newest = {}
    for i, t, kind in rows:
        if kind == "response":
            newest[t] = max(i, newest.get(t, -1))
    for r in got.filter("url_key = 'hot.com/x'").sample(0.05, 3).collect():
        earlier = [t for t in newest if t < r.captured]
        assert r.original_id == (newest[max(earlier)] if earlier else None)


def test_odd_rows(spark):
    """Null ids and times, an unknown kind and a repeated response."""
    rows = [(None, "response", "http://a/", 1, {"etag": "1"}, "d", 0), (2, "revisit", "http://a/", 5, {"etag": "1"}, None, 0), (3, "metadata", "http://a/", 4, {}, "x", 0),
            (4, "revisit", "http://a/", None, {"etag": "1"}, None, 0), (5, "response", "http://b/", -7, {"etag": "2"}, "e", 0), (5, "response", "http://b/", -7, {"etag": "2"}, "e", 0),
            (6, "revisit", "http://b/", -7, {"etag": "2"}, None, 0), (7, "revisit", "http://b/", -6, {"etag": "2"}, None, 0)]
    got = {r.record_id: (r.original_id, r.outcome, r.digest) for r in revisits.resolved(spark.createDataFrame(rows, SCHEMA), 3).collect()}
    assert got == {2: (None, "resolved", "d"), 4: (None, "no_original", None), 6: (None, "no_original", None), 7: (5, "resolved", "e")}


def test_empty_table(spark):
    assert revisits.resolved(spark.createDataFrame([], SCHEMA)).count() == 0
