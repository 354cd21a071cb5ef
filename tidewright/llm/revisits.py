"""Web archive records: resolving not-modified revisits to the full response they stand for.

A revisit record holds the headers of a 304 answer and no body. It stands for the latest earlier
full response of the same canonical URL, if its validators agree, with the headers that a 304
answer may renew. The as-of join works in time segments of a URL, so a URL that holds a third of
all captures is many tasks; one row per segment carries the latest response over the cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.ordered import with_last

SEGMENT = 4096  # units of capture time in one segment

# Header fields that a not-modified answer does not renew (HTTP semantics and caching RFCs).
KEPT_FIELDS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Host in lower case without default port, path without its last slash, sorted query without
    ``utm_`` parameters; no scheme, no fragment. Null without ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?.*$"
    host = F.regexp_replace(F.translate(F.regexp_extract(url, shape, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, shape, 2), "/$", "")
    fields = F.filter(F.split(F.regexp_extract(url, shape, 3), "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("utm_")))
    query = F.array_join(F.array_sort(fields), "&")
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _tag(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(etag, "^W/", "")


def _outcome(original: Column) -> Column:
    """Entity tags decide where both sides have one, else modification times; with neither nothing is proved."""
    tags = [_tag(F.col("headers")["etag"]), _tag(original["headers"]["etag"])]
    times = [F.col("headers")["last-modified"], original["headers"]["last-modified"]]
    return (
        F.when(original.isNull(), "no_original")
        .when(tags[0].isNotNull() & tags[1].isNotNull(), F.when(tags[0] == tags[1], "resolved").otherwise("validator_mismatch"))
        .when(times[0].isNotNull() & times[1].isNotNull(), F.when(times[0] == times[1], "resolved").otherwise("validator_mismatch"))
        .otherwise("no_validator")
    )


def merged_headers(stored: Column, renewed: Column) -> Column:
    """The stored fields, renewed by those of the 304 answer that may renew them."""
    permitted = F.map_filter(renewed, lambda k, _: ~k.isin(list(KEPT_FIELDS)))
    kept = F.map_filter(stored, lambda k, _: ~F.map_contains_key(permitted, k))
    return F.map_concat(kept, permitted)


def capture_times(records: DataFrame) -> DataFrame:
    """One row for each ``url_key``, ``captured`` and kind (``full`` for responses), with the largest ``top`` id of its rows."""
    full = (F.col("kind") == "response").alias("full")
    return records.filter("kind IN ('response', 'revisit')").groupBy("url_key", "captured", full).agg(F.max("record_id").alias("top"))


def latest_responses(records: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``found`` (``captured`` and ``record_id`` of the latest earlier response, null if none) for each capture time of revisits."""
    response = F.when(F.col("full"), F.struct("captured", F.col("top").alias("record_id")))
    # At equal times the revisit comes before the response, which is not earlier.
    cut = F.floor(F.col("captured") / segment)
    carried = with_last(capture_times(records), ["url_key"], ["captured", "full"], {"found": response}, cut)
    return carried.filter("NOT full").select("url_key", "captured", "found")


def resolved(records: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per revisit: ``record_id``, ``url_key``, ``captured``, ``original_id``, ``outcome``, ``headers``, ``digest``.

    ``records`` has ``record_id`` long, ``kind`` (response or revisit), ``url``, ``captured`` long, ``headers`` (a
    map with lower-case field names) and ``digest`` (of the body; responses only). The original is the
    response with the latest earlier capture time, of several at that time the one with the largest id;
    it stands in the result whatever the outcome, headers are merged and the digest taken over only
    when it is ``resolved``. A revisit without a canonical URL or capture time has no
    original, null headers are empty. Repeated rows are resolved each; other columns are not read.
    """
    slim = records.select(
        "record_id", "kind", canonical_url(F.col("url")).alias("url_key"), "captured",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "digest",
    )
    timed = F.col("url_key").isNotNull() & F.col("captured").isNotNull()
    visits = slim.filter("kind = 'revisit'").drop("kind", "digest")
    found = visits.filter(timed).join(latest_responses(slim.filter(timed), segment), ["url_key", "captured"], "left")
    # Repeated rows of a response are one; rows of one id and time that differ give the largest.
    stored = (
        slim.filter(timed & (F.col("kind") == "response"))
        .groupBy(F.col("url_key").alias("_key"), F.col("captured").alias("_at"), F.col("record_id").alias("_id"))
        .agg(F.max(F.struct(F.to_json("headers").alias("headers"), "digest")).alias("stored"))
    )
    same = (F.col("url_key") == F.col("_key")) & (F.col("found.captured") == F.col("_at")) & F.col("found.record_id").eqNullSafe(F.col("_id"))
    found = found.join(stored, same, "left").drop("_key", "_at", "_id")
    found = found.unionByName(visits.filter(~timed), allowMissingColumns=True)
    original = F.when(
        F.col("found").isNotNull(),
        F.struct(
            F.col("found.record_id").alias("record_id"),
            F.from_json("stored.headers", "map<string,string>").alias("headers"),
            F.col("stored.digest").alias("digest"),
        ),
    )
    out = found.withColumn("original", original).withColumn("outcome", _outcome(F.col("original")))
    done = F.col("outcome") == "resolved"
    return out.select(
        "record_id",
        "url_key",
        "captured",
        F.col("original.record_id").alias("original_id"),
        "outcome",
        F.when(done, merged_headers(F.col("original.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(done, F.col("original.digest")).alias("digest"),
    )


def header_text(headers: Column) -> Column:
    """Fields in order, one ``name: value`` a line."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return F.array_join(F.array_sort(lines), "\n")


def recrawled(pages: DataFrame) -> DataFrame:
    """Archive records of a page table: each page captured in full, and asked for again later.

    Page n is captured at time n with the MD5 of its body as entity tag; the second visit, as many
    time units later as the body has characters, sends that tag and is answered with 304. Pages of
    one canonical URL captured in between make a visit's latest original another one, with another tag.
    """
    html = F.coalesce("html", F.lit(""))
    tag = F.concat(F.lit('"'), F.md5(html.cast("binary")), F.lit('"'))

    def fields(**values) -> Column:
        pairs = [x for k, v in values.items() for x in (F.lit(k.replace("_", "-")), v)]
        return F.create_map(*pairs)

    def text(number: Column) -> Column:
        return number.cast("string")

    page = F.col("page_id").cast("long")
    later = page + F.length(html)
    first = F.struct(
        (page * 2).alias("record_id"),
        F.lit("response").alias("kind"),
        page.alias("captured"),
        fields(content_length=text(F.octet_length(html)), content_type=F.lit("text/html"), date=text(page), etag=tag).alias("headers"),
        F.md5(html.cast("binary")).alias("digest"),
    )
    second = F.struct(
        (page * 2 + 1).alias("record_id"),
        F.lit("revisit").alias("kind"),
        later.alias("captured"),
        fields(content_length=F.lit("0"), date=text(later), etag=F.concat(F.lit("W/"), tag), expires=text(later + 60)).alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return pages.select("url", F.inline(F.array(first, second)))
