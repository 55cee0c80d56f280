from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import core
from tidemark.operators import queue, tables
from tidemark.operators.common import number_rows


def test_log_lines(spark):
    ts = F.timestamp_millis(F.lit(1738553106789))
    df = spark.range(1).select(
        core.log_line(F.lit("INFO"), ts, F.lit("hello"), core.log_field("count", F.lit(2)), core.log_field("status", F.lit("ok"), True)).alias("a"),
        core.log_line(F.lit("INFO"), ts, F.lit("short"), core.log_field("user", F.lit("sam"), True), explicit=True).alias("b"),
        core.log_line(F.lit("INFO"), F.lit(None).cast("timestamp"), F.lit("x" * 70)).alias("c"),
    )
    a, b, c = df.first()
    assert a == "[INFO] [02-03|03:25:06.789] hello" + " " * 36 + 'count=2 status="ok"'
    assert b == "[INFO] [02-03|03:25:06.789] short" + " " * 56 + 'user="sam"'
    assert c == "[INFO] [<unknown-timestamp>] " + "x" * 70


def test_buckets_are_closed_above(spark):
    got = spark.createDataFrame([(0.0,), (0.005,), (0.0051,), (10.0,), (11.0,)], "v double").select(core.bucket(F.col("v"))).collect()
    assert [r[0] for r in got] == [0, 0, 1, 13, 14]


def test_ids():
    assert core.ulid(0, bytes(10)) == "0" * 26
    assert core.ulid(1, bytes(10)) < core.ulid(2, bytes(10))
    with pytest.raises(ValueError):
        core.ulid(-1)
    u = core.uuid7(1700000000000)
    assert u[14] == "7" and u[19] in "89ab" and u < core.uuid7(1700000000001)


def test_number_rows(spark):
    got = number_rows(spark.range(1000).withColumn("k", F.col("id") * 7 % 1000), "k", partitions=7).orderBy("k").collect()
    assert [r.seq for r in got] == list(range(1, 1001))
    assert number_rows(spark.range(0), "id").count() == 0


def test_merge_doesnt_depend_on_order(spark):
    log = [(1, 5, 1, "I", "a"), (1, 5, 2, "U", "b"), (1, 4, 3, "U", "late"), (2, 1, 1, "I", "c"), (2, 2, 2, "D", "c"), (3, 1, 1, "D", "x"), (3, 1, 2, "I", "y")]
    schema = "k int, version int, seq long, op string, v string"
    base = spark.createDataFrame([], "k int, version int, seq long, v string")
    want = [(1, "b"), (3, "y")]
    once = tables.merge(base, spark.createDataFrame(log, schema), ["k"], "version")
    assert sorted((r.k, r.v) for r in once.collect()) == want
    again = tables.merge(once, spark.createDataFrame(log[::-1], schema), ["k"], "version")
    assert sorted((r.k, r.v) for r in again.collect()) == want


def test_schedule_keeps_live_tasks(spark):
    t = datetime(2024, 1, 1)
    requests = spark.createDataFrame([("a", t, 2), ("a", t, 1), ("b", t, 3)], "unique_id string, run_at timestamp_ntz, request_seq int")
    live = spark.createDataFrame([("b",)], "unique_id string")
    assert [r.request_seq for r in queue.schedule(requests, live).collect()] == [1]


def test_lease_takes_at_least_one_and_expires_at_now(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, t, "Running", t, 0), (2, datetime(2024, 1, 2), "Created", None, 1), (3, t, "Failed", None, 0)]
    tasks = spark.createDataFrame(rows, "task_id int, scheduled_at timestamp_ntz, state string, lease_expires_at timestamp_ntz, retry_count int")
    got = queue.lease(tasks, F.lit(t).cast("timestamp_ntz"), 0, "30 SECONDS", "w").collect()
    assert [(r.task_id, r.attempt, r.lease_expires_at) for r in got] == [(1, 1, datetime(2024, 1, 1, 0, 0, 30))]
