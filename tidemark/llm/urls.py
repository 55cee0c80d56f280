"""URL filters: fixed rules first, then gradient-boosted trees on lexical features.

A rule fits a host and all its subdomains, if the URL's path starts with the rule's path; the longest
rule wins and its verdict stands. All other URLs are judged by the trees. Their labels are the verdicts
of URLs that a rule fits, from a bounded sample of at most `SAMPLE` of them; or a column of labels.

Features come from the URL alone: lengths, depth, ratios of digits and other characters, entropy of the
characters, parameters, and smoothed rates of blocked URLs among labelled hosts with the same last one
or two labels (for training, from the other half of the sample).

Edge cases: a null URL, or one without `://`, has an empty host and path and is judged by the trees; if
the labels are of one kind or missing, all others get that kind, or are allowed; ties and repeated rows
are judged alike; long URLs are whole; an empty table gives an empty result; further columns stay, whatever
their names, except that host, path, rule, verdict and method_verdict are replaced.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, bounded_ids, cut, of_row, table

SAMPLE = 10_000
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return f"{self.host}{self.path}"


RULES = (
    Rule(BLOCK, "com", "/en/"),
    Rule(ALLOW, "example.com", "/en/7"),
    Rule(ALLOW, "net", "/de/"),
    Rule(BLOCK, "example.net", "/de/8"),
    Rule(BLOCK, "org", "/es/"),
)


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substr("url", at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return pages.withColumn("host", F.translate(host, string.ascii_uppercase, string.ascii_lowercase)).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def with_rule(parts: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and its verdict, both null where none fits. rules: a configured list, longest first here."""
    chosen, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(str(r))):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(r.path))
        chosen, verdict = F.when(fits, str(r)).otherwise(chosen), F.when(fits, r.verdict).otherwise(verdict)
    return parts.withColumn("rule", chosen).withColumn("verdict", verdict)


def features() -> dict[str, Column]:
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    count = lambda pattern, c=url: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    chars = F.split(url, "")
    entropy = F.aggregate(
        F.transform(F.array_distinct(chars), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n),
        F.lit(0.0),
        lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0),
    )
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "length": F.length(url),
        "host_length": F.length("host"),
        "host_labels": count(r"\.", F.col("host")) + 1,
        "host_hyphens": count("-", F.col("host")),
        "host_longest_label": F.coalesce(F.array_max(F.transform(F.split("host", r"\."), F.length)), F.lit(0)),
        "host_vowels": count("[aeiou]", F.col("host")) / F.greatest(F.length("host"), F.lit(1)),
        "path_length": F.length("path"),
        "depth": count("/", F.col("path")),
        "digit_ratio": count("[0-9]") / n,
        "other_ratio": count("[^A-Za-z0-9]") / n,
        "entropy": F.when(F.length(url) > 0, entropy).otherwise(0.0),
        "parameters": F.when(F.length(query) > 0, count("&", query) + 1).otherwise(0),
        "fragment": F.contains(url, F.lit("#")).cast("int"),
        "secure": F.startswith(url, F.lit("https")).cast("int"),
        "extension": F.col("path").rlike(r"\.[A-Za-z0-9]+$").cast("int"),
    }




LEVELS = (1, 2)
WEIGHT = 20.0


def _suffix_rates(labelled: DataFrame, by: list[str], prior: float) -> DataFrame:
    """Rates of blocked among labelled; at most as many rows as the sample has."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.substring_index("host", ".", -k).alias("suffix")) for k in LEVELS])).alias("s")
    return labelled.select(*by, "label", each).groupBy(*by, "s.level", "s.suffix").agg(((F.sum("label") + WEIGHT * prior) / (F.count("*") + WEIGHT)).alias("rate"))


def _with_rates(rows: DataFrame, rates: DataFrame, by: list[str], prior: float) -> DataFrame:
    for k in LEVELS:
        r = rates.filter(F.col("level") == k).select(*by, F.col("suffix").alias("_suffix"), F.col("rate").alias(f"_rate_{k}"))
        rows = rows.withColumn("_suffix", F.substring_index("host", ".", -k)).join(F.broadcast(r), ["_suffix", *by], "left").drop("_suffix").fillna(prior, [f"_rate_{k}"])
    return rows


class Filter:
    """Trees and suffix rates learned from labelled URLs."""

    def __init__(self, labelled: DataFrame, sample: int = SAMPLE, seed: int = 11):
        """labelled: page_id, url, host, path and label (1: block)."""
        chosen = labelled.join(F.broadcast(bounded_ids(labelled, sample, "page_id")), "page_id").groupBy("page_id").agg(*[F.max(c).alias(c) for c in ("url", "host", "path", "label")]).limit(sample)
        rows = cut(chosen.withColumn("half", F.pmod(F.xxhash64("page_id"), F.lit(2))).repartition(1).sortWithinPartitions("page_id"))
        n, blocked = rows.agg(F.count("*"), F.sum("label")).first()
        self.prior = (blocked or 0) / n if n else 0.0
        self.model = None
        if not 0 < self.prior < 1:
            return
        self.rates = cut(_suffix_rates(rows, [], self.prior))
        other = _suffix_rates(rows, ["half"], self.prior).withColumn("half", 1 - F.col("half"))
        train = self._vectors(_with_rates(rows, other, ["half"], self.prior))
        # A bounded sample in one sorted partition: the same trees in every run.
        train = cut(train.select("page_id", "_vector", F.col("label").cast("double").alias("label")).repartition(1).sortWithinPartitions("page_id"))
        self.model = GBTClassifier(featuresCol="_vector", labelCol="label", predictionCol="_blocked", maxDepth=4, maxIter=20, stepSize=0.2, seed=seed).setRawPredictionCol("_raw").setProbabilityCol("_p").fit(train)

    @staticmethod
    def _vectors(rows: DataFrame) -> DataFrame:
        fs = features()
        named = rows.select("*", *[c.cast("double").alias(f"_f_{k}") for k, c in fs.items()])
        names = [f"_f_{k}" for k in fs]
        return VectorAssembler(inputCols=[*names, *[f"_rate_{k}" for k in LEVELS]], outputCol="_vector").transform(named).drop(*names)

    def judge(self, parts: DataFrame) -> DataFrame:
        """parts with method_verdict."""
        if self.model is None:
            return parts.withColumn("method_verdict", F.lit(BLOCK if self.prior == 1 else ALLOW))
        scored = self.model.transform(self._vectors(_with_rates(parts, self.rates, [], self.prior)))
        return scored.withColumn("method_verdict", F.when(F.col("_blocked") == 1, BLOCK).otherwise(ALLOW)).drop("_vector", "_blocked", "_raw", "_p", *[f"_rate_{k}" for k in LEVELS])


def filter_urls(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """pages with host, path, rule, verdict and method_verdict (what the trees say of every URL)."""
    added = ("host", "path", "rule", "verdict", "method_verdict")
    parts = with_rule(with_parts(as_row(pages, "page_id", "url")), rules)
    labelled = parts.filter(F.col("rule").isNotNull()).select("page_id", "url", "host", "path", (F.col("verdict") == BLOCK).cast("int").alias("label"))
    judged = Filter(labelled, sample).judge(parts)
    return judged.withColumn("verdict", F.coalesce("verdict", "method_verdict")).select(*of_row(pages, added), *added)


def query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "method_verdict")
