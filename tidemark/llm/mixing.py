"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

A source's target is its share of all words by weight, but at most `epochs` times the words it has; what
a capped source leaves is shared again among the others by weight, until none is above its cap. A source
then takes each of its documents floor(target / size) times, and of a further repetition those that come
first in a seeded order until the target is reached; of the last one only the words that are left, from its
beginning on. realize() keeps the text of what is taken as it is: a part is a prefix of its document.

Nothing here holds a whole source in one task: the seeded order is cut into hash ranges of about `RANGE`
documents, the edge of a source is found on the ranges' sums, and only the documents of that one range are
shuffled and ordered; all others are decided where they are read.

Edge cases: a null text has size 0; a null source is a source, ordered last; an empty table gives an empty
result; repeated rows are documents of their own; further columns are kept as they are, whatever their names,
but those that this operator adds (size, source_size, target, whole, part, taken) are replaced. Reruns agree,
as the order depends on seed, doc_id and size only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, as_row, cut, of_row, table, words

#: Documents in a hash range, about.
RANGE = 10_000
#: Sources whose plans are broadcast at most, a few numbers each; beyond that the join is shuffled.
SMALL = 100_000
ADDED = ("size", "source_size", "target", "whole", "part", "taken")


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ranked(sources: DataFrame, partitions: int = 32) -> DataFrame:
    """Adds place, from 0, by code point and null last. Only one row for each partition is numbered in one task."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = cut(sources.repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id()))
    before = dealt.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    # At most one row for each of the partitions above.
    return dealt.join(F.broadcast(before), "part").select(
        "source", "source_size", (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1).alias("place")
    )


def water_fill(sources: DataFrame, epochs: float) -> DataFrame:
    """Adds target to (source, source_size, weight). Each round brings one row of sums to the driver."""
    level, n_capped = None, -1
    cap, weight = F.col("source_size") * F.lit(float(epochs)), F.col("weight")
    while True:
        capped = F.lit(False) if level is None else cap < weight * F.lit(level)
        s = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(capped, cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(capped, 0.0).otherwise(weight)).alias("open"),
            F.sum(capped.cast("long")).alias("n"),
        ).first()
        total = s.total or 0
        if s.n in (n_capped, None) or not s.open:
            break
        level, n_capped = (total - s.held) / s.open, s.n
    return sources.withColumn("target", F.least(cap, weight * F.lit(float(level or 0.0))))


def mix(docs: DataFrame, weights=(5, 2, 1), epochs: float = 3.0, seed: int = 7, size: Column | None = None) -> DataFrame:
    """docs with size, source_size, target, whole (repetitions), part (words of one more) and taken (words of all)."""
    bits = max(12, (docs.count() // RANGE).bit_length())
    rows = as_row(docs, "source", "doc_id", (size_of(F.col("text")) if size is None else size).alias("size"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("range", F.shiftrightunsigned("h", 64 - bits))
    ranges = cut(rows.groupBy("source", "range").agg(F.sum("size").alias("range_size")))
    sources = ranked(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    targets = water_fill(cut(sources.withColumn("weight", weight)), epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.select(F.col("source").alias("of"), "source_size", "target", whole.alias("whole")).withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")))
    w = Window.partitionBy("source").orderBy("range")  # a row for some 10,000 documents
    summed = ranges.withColumn("before", F.sum("range_size").over(w) - F.col("range_size"))
    inside = F.col("source").eqNullSafe(F.col("of")) & (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("range_size"))
    edges = cut(plan.join(summed, inside, "left").select("of", "source_size", "target", "whole", "rest", F.col("range").alias("edge"), "before"))
    planned = rows.join(F.broadcast(edges) if edges.count() <= SMALL else edges, F.col("source").eqNullSafe(F.col("of")))
    plain = planned.filter(~F.col("range").eqNullSafe(F.col("edge"))).withColumn("part", F.when(F.col("range") < F.col("edge"), F.col("size")).otherwise(0).cast("long"))
    upto = F.sum("size").over(Window.partitionBy("source", "range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    left = F.col("rest") - F.col("before") - (upto - F.col("size"))
    at_edge = planned.filter(F.col("range") == F.col("edge")).withColumn("part", F.greatest(F.lit(0), F.least("size", left)).cast("long"))
    decided = plain.unionByName(at_edge).withColumn("taken", F.col("size") * F.col("whole") + F.col("part"))
    return decided.select(*of_row(docs, ADDED), *ADDED)


def first_words(text: Column, n: Column) -> Column:
    """text up to the end of its n-th word."""
    pieces = F.split(text, f"(?<={SPACE_CLASS})(?!{SPACE_CLASS})", -1)  # each a word and the white space behind it, or that at the beginning
    ahead = F.contains(F.lit(SPACES), F.left(text, F.lit(1))).cast("int")
    return F.rtrim(F.array_join(F.slice(pieces, F.lit(1), n.cast("int") + ahead), ""), F.lit(SPACES))


def realize(mixed: DataFrame, text: str = "text") -> DataFrame:
    """A row for each repetition that mix() decided on, the partial one with its first words only; the added columns go."""
    partial = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    copies = F.concat(
        F.array_repeat(F.lit(True), F.col("whole").cast("int") + ((F.col("part") > 0) & ~partial).cast("int")),
        F.array_repeat(F.lit(False), partial.cast("int")),
    )
    rows = as_row(mixed, F.explode(copies).alias("all"))
    realized = F.when(F.col("all"), F.col(f"row.`{text}`")).otherwise(first_words(F.col(f"row.`{text}`"), F.col("row.part")))
    names = [c for c in mixed.columns if c not in ADDED]
    return rows.select(*[realized.alias(text) if name == text else c for name, c in zip(names, of_row(mixed, ADDED))])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("n"))
    return mix(sized, size=F.col("n")).select("doc_id", "size", "source_size", "target", "taken")
