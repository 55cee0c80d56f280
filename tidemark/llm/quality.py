"""Quality rules as learned decision lists, in DataFrame functions only.

Features are counted over whole texts inside each row, without a shuffle. Rules are conjunctions of
thresholds that separate rows labelled bad from rows labelled good. They are learned by sequential
covering: a rule grows by the condition with the largest gain in information, is pruned on rows held
back, and is kept if it is precise enough there; the rows it covers are set aside, and the next rule
grows on the rest. The result is an ordered list, which becomes one conditional Spark expression.

Learning reads a sample of at most `SAMPLE` labelled documents, chosen by a hash of doc_id, and gets
only counts of cells (quantile ranks of the features, label) on the driver.

Edge cases: null and empty texts have no words and all counts are 0; null labels and labels of unknown
documents are not learned from; without labels of both kinds the list is empty and keeps every row;
repeated rows are rows of their own; further columns of the input stay. Repeated windows are found by
64-bit hashes of three words, compared within one text only.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, as_row, bounded_ids, cut, of_row, table, words

#: Labelled documents that are learned from, at most.
SAMPLE = 20_000
SYMBOLS = "#*$%&|<>"
#: Up to so many different repeated windows in a text, membership is looked up in a list.
FEW = 32


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    first = as_row(
        docs,
        words(F.col(text)).alias("_w"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    w = F.col("_w")
    hashed = first.withColumn("n_words", F.size("_w").cast("long")).withColumn(
        "_h",
        F.when(F.size("_w") < 3, F.array().cast("array<bigint>")).otherwise(
            F.slice(F.transform("_w", lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.size("_w") - 2)
        ),
    )
    # No repeat at all is the usual case, and array_distinct() tells it fastest.
    maybe = hashed.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array("_h")))
    twice = maybe.withColumn(
        "_twice",
        F.when(F.col("_s").isNotNull(), F.array_distinct(F.array_compact(F.zip_with("_s", F.slice("_s", F.lit(2), F.size("_s")), lambda a, b: F.when(a == b, a))))),
    )
    by_list = F.array_compact(F.transform("_h", lambda x, i: F.when(F.array_contains("_twice", x), i)))
    placed = twice.withColumn(
        "_p",
        F.when(F.col("_twice").isNull(), F.lit(None))
        .when(F.size("_twice") <= FEW, by_list)
        .otherwise(_repeated_places(F.col("_h"))),
    )
    gaps = F.zip_with("_p", F.slice("_p", F.lit(2), F.size("_p")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    counted = placed.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")).withColumn(
        "n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")
    )
    # A generator, as filters on the features must not be pushed into the steps above: each would be copied where it is used.
    return counted.select(*of_row(docs, FEATURES), F.inline(F.array(F.struct(*FEATURES))))


def _repeated_places(h: Column) -> Column:
    """Places whose hash is found elsewhere too, ascending, in n log n steps."""
    s = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    ahead = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)))
    return F.sort_array(F.array_distinct(F.flatten(F.array_compact(ahead))))


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures() -> dict[str, Column]:
    """What thresholds are put on."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "n_dup_lines": F.col("n_dup_lines").cast("double"),
        "repeat_share": F.col("n_repeat_words") / n,
    }


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        m = measures()[self.measure]
        return m > F.lit(self.threshold) if self.above else m <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:g}"


def conditional(rules: list[tuple[Condition, ...]]) -> Column:
    """The list as one ordered expression: the first rule that fits rejects, none keeps."""
    out = None
    for rule in rules:
        fits = rule[0].column()
        for c in rule[1:]:
            fits = fits & c.column()
        out = F.when(fits, F.lit(False)) if out is None else out.when(fits, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(labelled: DataFrame, label: str = "quality", cuts: int = 24, precision: float = 0.9, most: int = 12) -> list[tuple[Condition, ...]]:
    """Rules for rows with label 0 against rows with label 1. labelled: a bounded number of rows with FEATURES and doc_id."""
    ms = measures()
    rows = labelled.filter(F.col(label).isin(0, 1)).select(*[m.alias(k) for k, m in ms.items()], F.col(label).alias("good"), (F.abs(F.xxhash64("doc_id")) % 3 == 0).alias("held"))
    grid = rows.agg(*[F.percentile_approx(k, [i / cuts for i in range(1, cuts)], 10_000).alias(k) for k in ms]).first()
    grid = {k: sorted(set(grid[k] or [])) for k in ms}
    rank = lambda k: sum((F.when(F.col(k) > F.lit(c), 1).otherwise(0) for c in grid[k]), F.lit(0)).alias(k)
    cells = rows.select(*[rank(k) for k in ms], "good", "held").groupBy(*ms, "good", "held").count().orderBy(*ms, "good", "held").collect()
    names = list(ms)
    grow = [(tuple(c[k] for k in names), c.good, c["count"]) for c in cells if not c.held]
    prune = [(tuple(c[k] for k in names), c.good, c["count"]) for c in cells if c.held]
    options = [(j, above, i) for j, k in enumerate(names) for i in range(len(grid[k])) for above in (True, False)]
    rules = []
    while len(rules) < most:
        rule = _grow(grow, options)
        if not rule:
            break
        rule = min((rule[:i] for i in range(1, len(rule) + 1)), key=lambda r: (-_worth(r, prune), len(r)))
        good, bad = _covered(rule, prune)
        if bad < 3 or bad < precision * (good + bad):
            break
        rules.append(tuple(Condition(names[j], above, grid[names[j]][i]) for j, above, i in rule))
        grow, prune = ([c for c in cs if not _fits(rule, c[0])] for cs in (grow, prune))
    return rules


def _fits(rule, ranks) -> bool:
    """A measure's rank is the number of cuts it lies above."""
    return all((ranks[j] > i) == above for j, above, i in rule)


def _covered(rule, cells) -> tuple[int, int]:
    n = Counter()
    for ranks, good, count in cells:
        if _fits(rule, ranks):
            n[good] += count
    return n[1], n[0]


def _worth(rule, cells) -> float:
    good, bad = _covered(rule, cells)
    return (bad - good) / max(1, bad + good)


def _grow(cells, options):
    rule: list = []
    good, bad = _covered(rule, cells)
    while good and bad and len(rule) < 4:
        now = math.log2(bad / (good + bad))
        inside = [c for c in cells if _fits(rule, c[0])]
        best = (0.0, None)
        for o in options:
            g, b = _covered([o], inside)
            if b >= 3 and (gain := b * (math.log2(b / (g + b)) - now)) > best[0] + 1e-9:
                best = (gain, o, g, b)
        if best[1] is None:
            break
        rule.append(best[1])
        good, bad = best[2:]
    return rule


def learn_from(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[Condition, ...]]:
    known = labels.select("doc_id", "quality").na.drop()
    chosen = known.join(F.broadcast(bounded_ids(known, sample)), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality")).limit(sample)
    # At most `sample` rows of two numbers are broadcast.
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return learn(cut(with_features(labelled).drop("text")))


def judge(docs: DataFrame, rules: list[tuple[Condition, ...]]) -> DataFrame:
    """docs with the features, base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return with_features(docs).withColumn("base_failed", failed).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(conditional(rules)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = learn_from(docs, table(spark, sf_dir, "labels"))
    return judge(docs.select("doc_id", "text"), rules).select("doc_id", *FEATURES, "base_failed", "kept")
