"""Connected components of undirected edges by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """A round: every node's neighbours (larger ones, or smaller ones and itself) point to the smallest of all."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    moved = both.join(least, F.col("u") == F.col("c"))
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node), for all nodes of edges (columns u and v; loops don't count).

    Each pair of rounds is written to the checkpoint folder; only a count and a sum of hashes come to the
    driver. Joins have one row for each node on one side, so a node with very many edges can be split.
    """
    now, sign = cut(edges.select("u", "v").filter("u <> v").distinct()), None
    while True:
        before, now = now, cut(_stars(_stars(now, True), False))
        release(before)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if new == sign:
            break
        sign = new
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
