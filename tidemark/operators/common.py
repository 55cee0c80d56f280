"""Row numbers and lineage cuts that scale past one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one and a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _dealt(df: DataFrame, order, partitions: int | None) -> DataFrame:
    """df range-partitioned by order and written, with its partition's number."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def number_rows(df: DataFrame, *order: Column | str, name: str = "seq", start: int = 1, partitions: int | None = None) -> DataFrame:
    """Consecutive numbers in a total order, without a task that sees all rows.

    Rows are range-partitioned by the order and numbered inside their partition; what lies before a
    partition comes from a table of one row for each partition, which is broadcast.
    """
    dealt = _dealt(df, order, partitions)
    counts = dealt.groupBy("_part").count()
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + local + (start - 1)).cast("long")).drop("_part", "_before")


def running_sums(df: DataFrame, order: list, sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """Adds, under each name, the sum of its column over a row and all before it in a total order; no task sees all rows."""
    dealt = _dealt(df.select("*", *[F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(f"_v_{k}") for k, c in sums.items()]), order, partitions)
    totals = dealt.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    ahead = Window.orderBy("_part")  # a row for each partition
    before = totals.select("_part", *[(F.sum(f"_t_{k}").over(ahead) - F.col(f"_t_{k}")).alias(f"_b_{k}") for k in sums])
    local = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.join(F.broadcast(before), "_part").select("*", *[(F.col(f"_b_{k}") + F.sum(f"_v_{k}").over(local)).alias(k) for k in sums])
    return summed.drop("_part", *[f"_{x}_{k}" for k in sums for x in "vb"])
