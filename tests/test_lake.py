import pytest
from pyspark.sql import functions as F

from tidemark.operators import queue, tables
from tidemark.operators.common import running_sums
from tidemark.sources.commit import ClientError, Conflict, StoreError, retry, within
from tidemark.sources.lake import Lake


@pytest.fixture
def lake(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.create_namespace("n")
    return lake


def rows(spark, start, n):
    return spark.range(start, start + n).select("id", (F.col("id") % 3).cast("string").alias("kind"))


def test_names_and_schemas_are_checked(spark, lake):
    schema = rows(spark, 0, 1).schema
    with pytest.raises(Conflict):
        lake.create_namespace("n")
    with pytest.raises(StoreError):
        lake.create_table("other", "t", schema)
    for bad in ({"keys": ["x"], "version": "id"}, {"keys": ["id"]}, {"keys": ["kind"], "version": "kind"}, {"partition_by": ["x"]}):
        with pytest.raises(ValueError):
            lake.create_table("n", "t", schema, **bad)
    t = lake.create_table("n", "t", schema, ["kind"], "id")
    assert (t.keys, t.version, t.read().count()) == (["kind"], "id", 0)
    with pytest.raises(Conflict):
        lake.create_table("n", "t", schema)
    with pytest.raises(ValueError):
        t.append(spark.range(3))


def test_snapshots_are_fenced_and_compaction_keeps_rows(spark, lake):
    t = lake.create_table("n", "t", rows(spark, 0, 1).schema, partition_by=["kind"])
    t.append(rows(spark, 0, 30).repartition(3))
    late = lake.table("n", "t")
    t.append(rows(spark, 30, 30).repartition(3))
    with pytest.raises(Conflict):
        late.append(rows(spark, 99, 1))
    with pytest.raises(Conflict):
        late.prune()
    assert late.read().count() == 30 and lake.table("n", "t").read().count() == 60
    plan = t.read().filter("kind = '1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan
    before = t.files().count()
    n = t.compact()
    assert n == before > 3 == t.files().count() and sorted(r.id for r in t.read().collect()) == list(range(60))
    # What was rewritten, and what the late writer left.
    assert t.prune() >= n + 1 and t.read().count() == 60 and t.compact() == 0


def test_one_row_for_each_task(spark):
    tasks = spark.sql("SELECT id task_id, 'Running' state, 'w' worker_id, timestamp_ntz'2024-01-01' scheduled_at, timestamp_ntz'2024-01-02' lease_expires_at, 0 retry_count, 1 max_retries FROM range(3)")
    acks = spark.sql("SELECT * FROM VALUES (0, 'w', 1, true), (0, 'w', 0, false), (0, 'x', 0, true), (1, 'x', 0, true), (1, 'y', 0, true) AS t(task_id, ack_worker, ack_seq, success)").withColumn("retry_at", F.lit(None).cast("timestamp_ntz"))
    now = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    got = queue.acknowledge(tasks, acks, now).orderBy("task_id").collect()
    assert [(r.state, r.outcome, r.worker_id, r.lease_expires_at is None, r.retry_count) for r in got] == [("Created", "Retry", None, True, 1), ("Running", "Rejected", "w", False, 0), ("Running", "None", "w", False, 0)]
    beats = spark.sql("SELECT * FROM VALUES (0, 'w'), (0, 'w'), (0, 'x'), (1, 'x') AS t(task_id, beat_worker)")
    assert [r.extended for r in queue.heartbeat(tasks, beats, now, "30 SECONDS").orderBy("task_id").collect()] == [True, False, False]
    with pytest.raises(ValueError):
        queue.fails(F.lit(1), 1.5)


def test_slices(spark):
    stats = spark.createDataFrame([(1, 1400), (2, 750), (3, 700), (4, 9000), (5, 1)], "slice int, n_rows long")
    assert [r.merged for r in tables.merge_small(stats, 1500).orderBy("slice").collect()] == [0, 1, 1, 2, 3]
    keys = spark.range(10).select((F.col("id") * 3).alias("k"))
    bounds = tables.slice_bounds(keys, "k", 4)
    assert [(r.lo, r.hi) for r in bounds.orderBy("slice").collect()] == [(0, 9), (9, 18), (18, 24), (24, None)]
    got = tables.assign_slices(keys, bounds, "k")
    assert [r.slice for r in got.orderBy("k").collect()] == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    sums = running_sums(spark.range(100), ["id"], {"s": F.col("id")}, 7).orderBy("id").collect()
    assert [r.s for r in sums] == [i * (i + 1) // 2 for i in range(100)]


def test_retries_reload_only_for_moved_brokers():
    for error, n in ((ClientError("Status", "NotFound"), 0), (ClientError("Status", "Unavailable"), 2), (ClientError("Timeout"), 2), (OSError(), 0)):
        reloads = []

        def call(error=error):
            raise error

        with pytest.raises(type(error)):
            retry(call, lambda reloads=reloads: reloads.append(1), tries=3, sleep=lambda s: None)
        assert len(reloads) == n
    import time

    with pytest.raises(ClientError):
        within(lambda: time.sleep(0.5), 0.01)
    assert within(lambda: 3) == 3
