"""A training corpus from raw documents: five stages, each written as Parquet and read again.

1. language: documents in which no language is found, or none with a third of the words, go.
2. lines: of equal and near-equal lines the first stays; documents of which nothing stays go.
3. neardup: of each group of near duplicates one document stays.
4. mixing: sources are repeated or sampled to their target weights.
5. packing: documents are tokenized and packed into sequences.

Stages 1 to 4 return the columns of documents. Each works on all that its predecessor kept.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, lines, mixing, neardup, packing
from tidemark.llm.common import cut, shared_folder, table

#: Below this share of words the main language is no reason to keep a document. Words of no learned language count too.
LEAST_SHARE = 1 / 3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of rows that are sent to Python at once, about. Spark's bound is 10,000 rows, whatever their texts' lengths.
BATCH = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's bound of Arrow batches, unless it is lower; it stays, as stages run when their result is written.

    A batch is held by the JVM and by Python for each task, beside a heap that many stages have filled.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH:
        spark.conf.set(key, str(BATCH))


def keeping(stage):
    """The stage on the columns of documents, others put away in one, so that no name of theirs can clash."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        others = [c for c in docs.columns if c not in COLUMNS]
        away = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("others")] if others else []
        out = stage(spark, docs.select(*[c for c in docs.columns if c in COLUMNS], *away), sf_dir)
        return out.select(*[F.col(f"others.`{c}`").alias(c) if c in others else F.col(c) for c in docs.columns])

    return run


@keeping
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs, langid.learn(docs))
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*docs.columns)


@keeping
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs)


@keeping
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = neardup.near_duplicates(docs.select("doc_id", "text")).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


@keeping
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.realize(mixing.mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bounded_batches(spark)
    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language", language), ("lines", line_dedup), ("neardup", near_dedup), ("mixing", source_mix), ("packing", pack)]

#: Hashes, a learned model and a tokenizer: SQL cannot express the stages. tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written to the shared folder and read again; a stage's files go once the next is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            store.delete(path(before), True)
        before = f"{folder}/{name}"
    packed = cut(STAGES[-1][1](spark, docs, sf_dir))
    store.delete(path(folder), True)
    return packed
