"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs what the rules leave open. Parsing, features, suffix statistics and
rules are column expressions; fitting and scoring are Spark ML's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINING_ROWS = 20_000  # bound of the labelled sample the trees are fitted on
SUFFIX_PRIOR = 20.0  # labelled URLs that a suffix's own rate is weighed against
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path starts so."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit("." + self.host))) & F.startswith(path, F.lit(self.path))


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def parsed(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``host`` (A-Z lower-cased) and ``path`` of a URL; both empty for a null or one without ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
    found = urls.withColumns({name: F.regexp_extract(url, shape, k) for k, name in enumerate(("host", "path"), 1)})
    return found.withColumn("host", F.translate("host", UPPER, LOWER)).withColumn("_tail", F.regexp_extract(url, shape, 3))


def ruled(parts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``rule`` and ``ruling`` of the longest rule that fits; of two as long, the one listed first."""
    longest_first = sorted(rules, key=lambda r: -len(r.text))
    fits = [(r, r.fits(F.col("host"), F.col("path"))) for r in longest_first]

    def first(of) -> Column:
        return F.coalesce(*[F.when(fit, F.lit(of(r))) for r, fit in fits], F.lit(None).cast("string"))

    return parts.withColumn("rule", first(lambda r: r.text)).withColumn("ruling", first(lambda r: r.verdict))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.split(text, "")
    n = F.greatest(F.size(chars), F.lit(1)).cast("double")
    shares = F.transform(F.array_distinct(chars), lambda c: (F.size(chars) - F.size(F.array_remove(chars, c))) / n)
    return -F.aggregate(shares, F.lit(0.0), lambda a, p: a + p * F.log2(p))


FEATURES = ("length", "host_length", "path_length", "labels", "depth", "digit_ratio", "digits_in_last", "entropy",
            "parameters", "fragment", "hyphens", "last_length", "extension", "suffix_rate", "folder_rate")


def lexical(parts: DataFrame) -> DataFrame:
    """``parts`` with the lexical features and the two suffixes that statistics are kept for."""
    whole = F.concat("host", "path", "_tail")
    length = F.greatest(F.length(whole), F.lit(1))
    last = F.regexp_extract("path", r"([^/]*)/?$", 1)
    query = F.regexp_extract("_tail", r"(?s)^\?([^#]*)", 1)
    return parts.withColumns(
        {
            "length": F.length(whole).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "labels": F.size(F.split("host", r"\.")).cast("double"),
            "depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
            "digit_ratio": F.regexp_count(whole, F.lit("[0-9]")) / length,
            "digits_in_last": F.regexp_count(last, F.lit("[0-9]")).cast("double"),
            "entropy": _entropy(whole),
            "parameters": F.when(query != "", F.regexp_count(query, F.lit("&")) + 1).otherwise(0).cast("double"),
            "fragment": F.contains("_tail", F.lit("#")).cast("double"),
            "hyphens": F.regexp_count(whole, F.lit("[-_]")).cast("double"),
            "last_length": F.length(last).cast("double"),
            "extension": F.contains(last, F.lit(".")).cast("double"),
            "suffix": F.regexp_extract("host", r"([^.]*)$", 1),
            "folder": F.concat_ws("/", F.regexp_extract("host", r"([^.]*)$", 1), F.regexp_extract("path", r"^/([^/]*)/", 1)),
        }
    )


def _rates(labelled: DataFrame, key: str, overall: float) -> DataFrame:
    """Share of blocked URLs for each value of ``key``, drawn to the overall share where there are few."""
    counts = labelled.groupBy(F.col(key).alias(f"_{key}")).agg(F.sum("label").alias("blocked"), F.count("*").alias("n"))
    rate = (F.col("blocked") + overall * SUFFIX_PRIOR) / (F.col("n") + SUFFIX_PRIOR)
    return counts.select(f"_{key}", rate.alias(f"{key}_rate"))


class Filter:
    """Boosted trees and the suffix statistics of all labelled URLs."""

    def __init__(self, overall: float, rates: dict[str, DataFrame], trees=None):
        self.overall, self.rates, self.trees = overall, rates, trees

    def features(self, parts: DataFrame) -> DataFrame:
        out = parts
        for key, rates in self.rates.items():
            out = out.join(rates, F.col(key) == F.col(f"_{key}"), "left").drop(f"_{key}")
            out = out.withColumn(f"{key}_rate", F.coalesce(f"{key}_rate", F.lit(self.overall)))
        return VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(out)

    def blocks(self, parts: DataFrame) -> DataFrame:
        """``parts`` (from ``lexical``) with ``blocked``, whether the trees would block the URL."""
        if self.trees is None:
            return parts.withColumn("blocked", F.lit(self.overall >= 0.5))
        return self.trees.transform(self.features(parts)).withColumn("blocked", F.col("_prediction") == 1.0)


def train(labelled: DataFrame, rows: int = TRAINING_ROWS, trees: int = 20, depth: int = 4) -> Filter:
    """Fit on at most ``rows`` different labelled URLs, those whose parts hash lowest, weighed by how often they occur.

    ``labelled`` comes from ``lexical`` and has ``label``, 1.0 to block; statistics are over all of it. The sorted
    sample is one small partition, so sums run in one order and reruns give the same trees. Without
    labelled rows nothing is blocked.
    """
    labelled = labelled.filter("label IS NOT NULL")
    overall, seen = labelled.agg(F.avg("label"), F.count("*")).first()
    if not seen:
        return Filter(0.0, {})
    rates = {key: _rates(labelled, key, overall).cache() for key in ("suffix", "folder")}
    # Suffixes and folders are as many as the URLs make them; only few are broadcast.
    fitted = Filter(overall, {key: F.broadcast(of) if of.count() <= TRAINING_ROWS else of for key, of in rates.items()})
    order = [F.xxhash64("host", "path", "_tail"), "host", "path", "_tail", "label"]
    different = labelled.groupBy("host", "path", "_tail", "label").agg(F.count("*").cast("double").alias("_weight"))
    sample = different.orderBy(*order).limit(rows).cache()
    if sample.select("label").distinct().count() == 2:
        boosted = GBTClassifier(
            featuresCol="_features", labelCol="label", weightCol="_weight", predictionCol="_prediction", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=11, checkpointInterval=-1,
        )
        boosted.setProbabilityCol("_probability").setRawPredictionCol("_raw")
        fitted.trees = boosted.fit(fitted.features(lexical(sample)).repartition(1).sortWithinPartitions(*order))
    return fitted


def judged(urls: DataFrame, known: Filter, rules: tuple[Rule, ...] = RULES, url_col: str = "url") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict``, by the longest rule that fits, else by the trees.

    Null and odd URLs have empty host and path, fit no rule and are judged by the trees on empty
    features. Rows are judged one by one; other columns are kept, but for four of these names; an empty
    table stays empty.
    """
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    own = urls.select(F.struct(*kept).alias("_row"), F.col(url_col).alias("_url"))
    scored = known.blocks(lexical(ruled(parsed(own, "_url"), rules)))
    verdict = F.coalesce("ruling", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return scored.withColumn("verdict", verdict).select(*[F.col("_row")[c].alias(c) for c in kept], "host", "path", "rule", "verdict")


def rule_labels(urls: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url") -> DataFrame:
    """The URLs that a rule decides, as labelled rows for ``train``."""
    decided = ruled(parsed(urls.select(url_col), url_col), rules).filter("ruling IS NOT NULL")
    return lexical(decided).withColumn("label", (F.col("ruling") == "block").cast("double"))
