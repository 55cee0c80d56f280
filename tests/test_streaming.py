import pytest
from pyspark.sql import functions as F

from conftest import DATA
from tidemark.operators import tables
from tidemark.streaming import wal


@pytest.mark.parametrize("whole", [2, 3, 16])
def test_stream_equals_batch(spark, tmp_path, monkeypatch, whole):
    """Shuffled files with late and repeated versions end in the state that one merge gives, whenever the whole state is written."""
    monkeypatch.setattr(wal, "WHOLE", whole)
    e = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").select((F.col("user_id")).alias("k"), F.col("event_id").alias("version"), "value", F.lit("U").alias("op"))
    e = e.withColumn("op", F.when(F.col("version") % 11 == 0, "D").otherwise(F.col("op")))
    bad = e.limit(2).withColumn("k", F.lit(None).cast("long"))
    land, log, table = (str(tmp_path / x) for x in ("land", "log", "table"))
    for i in (2, 0, 1):
        e.filter(F.col("version") % 3 == i).unionByName(bad).coalesce(1).write.mode("append").parquet(land)
    wal.write_log(wal.landing(spark, land, e.schema), log, str(tmp_path / "c1"), ["k"]).awaitTermination()
    schema = e.withColumn("seq", F.lit(1)).schema
    assert spark.read.parquet(log).count() == e.count() and spark.read.parquet(f"{log}.rejected").count() == 6
    wal.materialize(spark, log, table, schema, ["k"], "version", str(tmp_path / "c2")).awaitTermination()
    last = max(int(p.name[2:]) for p in (tmp_path / "table").iterdir())
    got = sorted((r.k, r.version, r.value) for r in wal.current(spark, table, last, ["k"], "version").collect())
    assert last == 3 and (tmp_path / "table.whole").exists() == (whole <= last)
    base = spark.createDataFrame([], e.drop("op").schema)
    want = tables.merge(base, e.withColumn("seq", F.lit(1).cast("long")), ["k"], "version")
    assert got == sorted((r.k, r.version, r.value) for r in want.collect())


def test_generator(spark):
    rows = wal.generator(spark, 5, 3, 8, rows=50).collect()
    assert len(rows) == 50 and {r.unique_id for r in rows} <= {"0", "1", "2"} and all(len(r.payload) == 8 for r in rows)
    assert wal.generator(spark, 5, 3, 8).isStreaming
