"""The registered queries of the subpackage and their check SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, embedding_dedup, language, licenses, mixing, phrases, quality, revisits, simhash, substring, toxicity, url_filter, whitening

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page URL; trees learn from the URLs that the rules decide."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    known = url_filter.train(url_filter.rule_labels(pages))
    return url_filter.judged(pages, known).select("page_id", "host", "path", "rule", "verdict")


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source with weights 5, 2, 1, copies bounded by three."""
    mix = mixing.mixed(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
    SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::BIGINT AS weight FROM sources
), ordered AS (
    SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS pos FROM weighted
), shared AS (
    SELECT *, (SELECT sum(source_size) FROM weighted)::BIGINT
              - 3 * coalesce(sum(source_size) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS remaining,
           sum(weight) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS heavy
    FROM ordered
), opened AS (
    SELECT min(pos) AS pos FROM shared WHERE NOT weight * remaining > 3 * source_size * heavy
), targets AS (
    SELECT s.source, s.source_size,
           CASE WHEN s.pos < o.pos THEN (3 * s.source_size)::DOUBLE
                ELSE (s.weight * f.remaining)::DOUBLE / f.heavy::DOUBLE END AS target
    FROM shared s, opened o, shared f WHERE f.pos = o.pos
), ranked AS (
    SELECT d.doc_id, d.size, t.source_size, t.target,
           row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS rank,
           CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
           ('0x' || md5('20' || coalesce(':' || d.source, ''))[1:4])::BIGINT::DOUBLE / 65536 AS shift
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (least(floor(rank * rate + shift) - floor((rank - 1) * rate + shift), 3)::BIGINT * size)::BIGINT AS taken
FROM ranked
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all whole documents and the groups within three bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality rules on all whole documents."""
    judged = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP5_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), read AS (
    SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split(text, chr(10)) AS all_lines FROM docs
), counts AS (
    SELECT *, list_filter(all_lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
           len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
           len(list_filter(w, lambda x: list_contains({stops}, lower(x)))) AS n_stop_words
    FROM read
), places AS (
    SELECT rid, w, unnest(range(1, n_words - 3)) AS i FROM counts WHERE n_words >= 5
), windows AS (
    SELECT rid, i, w[i : i + 4] AS win FROM places
), twice AS (
    SELECT rid, win FROM windows GROUP BY ALL HAVING count(*) > 1
), covered AS (
    SELECT v.rid, count(DISTINCT x.j) AS n FROM windows v JOIN twice t ON v.rid = t.rid AND v.win = t.win, unnest(range(v.i, v.i + 5)) x(j) GROUP BY v.rid
), measured AS (
    SELECT c.*, len(ls) AS n_lines, len(all_lines) AS n_all_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words
    FROM counts c LEFT JOIN covered v ON c.rid = v.rid
), judged AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1500 * n_words AND 100 * n_symbols <= 30 * n_words
       AND 100 * n_stop_words >= 4 * n_words AND 100 * n_dup_lines <= 40 * n_lines AND 100 * n_lines >= 20 * n_all_lines AS kept
FROM judged
""".replace("{stops}", "[" + ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS.split()))) + "]")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 13-word windows that an earlier document has."""
    cut = substring.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH words AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), places AS (
    SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words
), windows AS (
    SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS win FROM places WHERE i + 12 <= len(w)
), earliest AS (
    SELECT win, min(doc_id) AS first_doc FROM windows GROUP BY win
), repeated AS (
    SELECT DISTINCT v.doc_id, unnest(range(v.i, v.i + 13)) AS i FROM windows v JOIN earliest e USING (win) WHERE e.first_doc < v.doc_id
), kept AS (
    SELECT p.doc_id, string_agg(p.w[p.i], ' ' ORDER BY p.i) AS text, count(*) AS n
    FROM places p ANTI JOIN repeated r ON p.doc_id = r.doc_id AND p.i = r.i GROUP BY p.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels")
    grades = labels.select("doc_id", toxicity.severity_grade(F.col("toxic"), F.col("quality")).alias("grade"))
    return toxicity.train(docs, grades, n_grades=3)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of all documents by a model of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = toxicity.severities(docs, toxicity_model(spark, docs, sf_dir))
    return judged.select("doc_id", "severity", "grade", F.col("rejected").alias("toxic"))


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All second visits of the pages resolved against the full captures."""
    found = revisits.resolved(revisits.recrawled(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", revisits.header_text(F.col("headers")))


OP8_SQL = r"""
WITH keyed AS (
    SELECT page_id, coalesce(html, '') AS html, md5(coalesce(html, '')) AS digest,
           regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?.*$', 1) AS host,
           regexp_replace(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?.*$', 2), '/$', '') AS path,
           array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?.*$', 3), '&'),
                                                 lambda p: p <> '' AND NOT starts_with(p, 'utm_'))), '&') AS query,
           contains(url, '://') AS whole
    FROM pages
), pages_of AS (
    SELECT page_id, html, digest,
           CASE WHEN whole THEN regexp_replace(translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(80|443)$', '')
                                || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS url_key
    FROM keyed
), found AS (
    SELECT v.*, (SELECT arg_max(r.page_id, r.page_id) FROM pages_of r
                 WHERE r.url_key = v.url_key AND r.page_id < v.page_id + length(v.html)) AS original
    FROM pages_of v
)
SELECT (f.page_id * 2 + 1)::BIGINT AS record_id, f.url_key, (f.page_id + length(f.html))::BIGINT AS captured, (f.original * 2)::BIGINT AS original_id,
       CASE WHEN f.original IS NULL THEN 'no_original' WHEN o.digest = f.digest THEN 'resolved' ELSE 'validator_mismatch' END AS outcome,
       CASE WHEN o.digest = f.digest
            THEN 'content-length: ' || strlen(o.html) || chr(10) || 'content-type: text/html' || chr(10)
            ELSE 'content-length: 0' || chr(10) END
       || 'date: ' || (f.page_id + length(f.html)) || chr(10) || 'etag: W/"' || f.digest || '"' || chr(10)
       || 'expires: ' || (f.page_id + length(f.html) + 60) AS headers,
       CASE WHEN o.digest = f.digest THEN o.digest END AS digest
FROM found f LEFT JOIN pages_of o ON o.page_id = f.original
"""


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices of all whole documents."""
    return licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _op9_sql() -> str:
    def quoted(word: str) -> str:
        return "'" + word.replace("'", "''") + "'"

    rows = ", ".join(
        f"({k}, '{name}', {len(licenses.words_of(text))}, [{', '.join(map(quoted, licenses.bigrams(text)))}])"
        for k, (name, text) in enumerate(licenses.TEMPLATES)
    )
    anchors = ", ".join(f"({k}, {quoted(g)}, {at})" for k, (_, text) in enumerate(licenses.TEMPLATES) for g, at in licenses.anchors(text))
    return (
        r"""
WITH templates(k, name, m, t) AS (VALUES """
        + rows
        + r"""
), anchors(k, gram, spot) AS (VALUES """
        + anchors
        + r"""
), docs AS (
    SELECT row_number() OVER () AS rid, doc_id, lower(coalesce(text, '')) AS text FROM documents
), words AS (
    SELECT rid, unnest(list_append(string_split(text, chr(10)), replace(text, chr(10), ' '))) AS unit FROM docs
), lines AS (
    SELECT DISTINCT rid, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g, array_to_string(w, ' ') AS line
    FROM (SELECT rid, regexp_extract_all(unit, '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM words) WHERE len(w) > 1
), matched AS (
    SELECT rid, line, k, name, 2.0::DOUBLE * len(list_intersect(t, g)) / (len(t) + len(g)) AS dice
    FROM lines JOIN templates ON 200 * least(len(t), len(g)) >= 80 * (len(t) + len(g))
), notices AS (
    SELECT rid, count(DISTINCT line) AS n FROM matched WHERE dice * 100 >= 80 GROUP BY rid
), pairs AS (
    SELECT rid, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p
    FROM (SELECT rid, regexp_extract_all(replace(text, chr(10), ' '), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM docs) WHERE len(w) > 1
), starts AS (
    SELECT DISTINCT rid, k, i - spot AS start
    FROM (SELECT rid, unnest(p) AS gram, unnest(range(len(p))) AS i FROM pairs) JOIN anchors USING (gram)
), passages AS (
    SELECT rid, k, name, t, greatest(start, 0) AS place, list_distinct(p[greatest(start, 0) + 1 : start + m - 1]) AS g
    FROM starts JOIN pairs USING (rid) JOIN templates USING (k)
), units AS (
    SELECT rid, k, name, dice, NULL AS place FROM matched
    UNION ALL
    SELECT rid, k, name, 2.0::DOUBLE * len(list_intersect(t, g)) / (len(t) + len(g)), place FROM passages
), best AS (
    SELECT * FROM units WHERE dice * 100 >= 80
    QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dice DESC, k, place NULLS LAST) = 1
)
SELECT doc_id, name AS license, k::INTEGER AS template, dice, place::INTEGER AS place, coalesce(n, 0)::BIGINT AS n_notices
FROM docs LEFT JOIN best USING (rid) LEFT JOIN notices USING (rid)
"""
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the public rank file, and decoded again."""
    docs = table(spark, sf_dir, "documents")
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(encoded, RANKS)).drop("ids")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable vectors on the leading 16 components of the different vectors' covariance."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    white = whitening.whitened(vectors, whitening.train(vectors))
    each = white.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "of"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "of.whitened", "of.explained", "identity_error")


def held_out(doc_id: Column) -> Column:
    """One document in five, by its id; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all whole documents by a network that learns from the ones not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = language.train(docs.filter(~held_out(F.col("doc_id"))))
    judged = language.predicted(docs.select("doc_id", "text"), known)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of each language in all whole documents."""
    return phrases.mined(table(spark, sf_dir, "documents").select("text", "lang"))


OP13_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[.,;:!?
-
]')) AS piece
    FROM documents
), texts AS (
    SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces
), totals AS (
    SELECT lang, sum(len(w))::HUGEINT AS n FROM texts GROUP BY lang
), places AS (
    SELECT pid, lang, w, unnest(range(1, len(w) + 1)) AS i FROM texts
), grams AS (
    SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM places, range(1, 6) s(m) WHERE i + m - 1 <= len(w)
), counts AS (
    SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), longer AS (
    SELECT lang, f, string_split(phrase, ' ') AS w, m FROM counts WHERE m > 2
), inside AS (
    SELECT DISTINCT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, f
    FROM longer, range(2, 5) s(k), range(1, 5) t(i) WHERE k < m AND i + k - 1 <= m
), candidates AS (
    SELECT c.lang, c.m, c.phrase, c.f AS a, t.n, string_split(c.phrase, ' ') AS w FROM counts c JOIN totals t USING (lang)
    WHERE c.m > 1 AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.f >= 100 * c.f)
), cuts AS (
    SELECT c.lang, c.phrase, c.a, c.n, k, x.f AS l, y.f AS r, (1000 * c.a * c.n) // (x.f * y.f) AS score
    FROM candidates c, range(1, 5) s(k)
    JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ')
    JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 :], ' ')
    WHERE k < c.m
), lowest AS (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cuts
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE nth = 1
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_embeddings": op2_embeddings,
    "op3_mix": op3_mix,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_substring": op6_substring,
    "op7_toxicity": op7_toxicity,
    "op8_revisits": op8_revisits,
    "op9_licenses": op9_licenses,
    "op10_bpe": op10_bpe,
    "op11_whitening": op11_whitening,
    "op12_language": op12_language,
    "op13_phrases": op13_phrases,
}

ORACLES = {
    "op3_mix": OP3_SQL,
    "op5_quality": OP5_SQL,
    "op6_substring": OP6_SQL,
    "op8_revisits": OP8_SQL,
    "op9_licenses": _op9_sql(),
    "op13_phrases": OP13_SQL,
}
