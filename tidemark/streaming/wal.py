"""Ingestion as micro-batches: a landing folder streams into numbered log folders, and those into a table.

Each micro-batch becomes one folder seq=n of the log, named by its batch id, so a batch that Spark runs
again overwrites itself. The table is merged on reading: folder v=n holds what won in batch n, and every
`WHOLE` batches the whole state is written beside, in <table>.whole/v=n, from the last whole one and the
batches since. So a batch costs what it brings, and a reader merges less than `WHOLE` batches into one state.
Late rows are settled by version, not time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.tables import merge, validate

#: Batches from one whole state to the next. Writer and readers of a table must have the same.
WHOLE = 16


def landing(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_log(stream: DataFrame, log: str, checkpoint: str, required: Sequence[str] = (), once: bool = True) -> StreamingQuery:
    """Valid rows of the stream go to log/seq=n, others to log.rejected/seq=n; the batch is durable before the next begins."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        judged = validate(batch, required).persist()
        judged.filter("verdict <> 'ok'").write.mode("overwrite").parquet(f"{log}.rejected/seq={batch_id + 1}")
        judged.filter("verdict = 'ok'").drop("verdict").write.mode("overwrite").parquet(f"{log}/seq={batch_id + 1}")
        judged.unpersist()

    writer = stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def materialize(spark: SparkSession, log: str, table: str, schema: StructType, keys: Sequence[str], version: str, checkpoint: str) -> StreamingQuery:
    """Adds each log folder to the entity table: the winners of the batch, and now and then the whole state."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("basePath", log).parquet(log)

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = batch if "op" in batch.columns else batch.withColumn("op", F.lit("I"))
        n = batch_id + 1
        merge(rows.limit(0), rows, keys, version, keep_deletes=True).write.mode("overwrite").parquet(f"{table}/v={n}")
        if n % WHOLE == 0:
            _state(spark, table, n, n - WHOLE, keys, version).write.mode("overwrite").parquet(f"{table}.whole/v={n}")

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _state(spark: SparkSession, table: str, n: int, whole: int, keys: Sequence[str], version: str) -> DataFrame:
    """The state after batch n, deletes included, from the whole state of an earlier batch (0: none) and the batches since."""
    if n == whole:
        return spark.read.parquet(f"{table}.whole/v={n}")
    since = spark.read.parquet(*[f"{table}/v={i}" for i in range(whole + 1, n + 1)])
    return merge(spark.read.parquet(f"{table}.whole/v={whole}") if whole else since.limit(0), since, keys, version, keep_deletes=True)


def current(spark: SparkSession, table: str, n: int, keys: Sequence[str], version: str) -> DataFrame:
    """The rows after batch n; deletes, which the table keeps for late writes, are left out."""
    return _state(spark, table, n, n - n % WHOLE, keys, version).filter("op <> 'D'").drop("op")


def generator(spark: SparkSession, rate: int, unique: int, payload_bytes: int, seed: int = 1, rows: int | None = None) -> DataFrame:
    """Synthetic tasks: unique_id in [0, unique), random payload; a rate stream, or `rows` rows of a batch."""
    source = spark.readStream.format("rate").option("rowsPerSecond", max(1, rate)).load() if rows is None else spark.range(rows).select(F.col("id").alias("value"), F.timestamp_millis(F.lit(0)).alias("timestamp"))
    return source.select(
        F.col("timestamp").alias("run_at"),
        F.floor(F.rand(seed) * unique).cast("string").alias("unique_id"),
        F.randstr(F.lit(payload_bytes), F.lit(seed)).alias("payload"),
    )
