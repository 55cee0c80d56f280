"""What the operators of this subpackage share: words, tables and lineage cuts."""

from __future__ import annotations

import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Task functions travel by value, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: White space that parts words: space and the five ASCII controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a class of Java's regular expressions, which split() takes.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), "")


def columns(df: DataFrame, without=()) -> list[Column]:
    """The columns of df, whatever their names are."""
    return [F.col(f"`{c}`") for c in df.columns if c not in without]


def as_row(df: DataFrame, *more: Column | str) -> DataFrame:
    """df's columns in one struct, `row`, beside others: so no name of theirs can clash with an operator's own."""
    return df.select(F.struct(*columns(df)).alias("row"), *more)


def of_row(df: DataFrame, without=()) -> list[Column]:
    """The columns that as_row() put away; df: as it was before."""
    return [F.col(f"row.`{c}`").alias(c) for c in df.columns if c not in without]


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session (one machine, as in tests) gets a temporary folder; a cluster gets an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


#: Spark's setting by which a query's shuffle files go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the cluster's shared checkpoint folder and reads it from there, so that it isn't computed again.

    As nothing leads back behind df then, its shuffle files go at once. What is written stays until release().
    """
    shared_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.set(CLEANUP, before)


def release(*cuts: DataFrame) -> None:
    """Deletes what cut() wrote for these; no later job may read them."""
    for df in cuts:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_ids(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """At most n different keys, chosen by their hash alone; all of them where there are no more than that.

    The share that is kept is set so that n is hardly ever reached; the limit makes the bound hard, so the
    result may be broadcast or collected.
    """
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    there = keys.count()
    if there > n:
        keys = keys.filter(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40)) < int((1 << 40) * 0.97 * n / there))
    return keys.limit(n)
