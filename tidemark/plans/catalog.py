"""The queries of the table engine and the task queue, and SQL that gives the same rows.

Each query applies operators of this package to whole tables of a folder of Parquet files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import uuid

from ..functions import core
from ..operators import queue, tables
from ..operators.common import cut, number_rows, shared_folder
from ..sources import manifest
from ..sources.lake import Lake, Table

NOW = "2024-01-03 00:00:00"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


LINE_ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def _lines(spark, sf_dir):
    return tables.latest(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c).desc() for c in LINE_ORDER])


def entity_latest(spark, sf_dir):
    return _lines(spark, sf_dir)


def entity_tombstone(spark, sf_dir):
    return _lines(spark, sf_dir).filter("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber", "l_shipdate")


def append_union(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_id", "user_id")
    return tables.append(e.filter("event_id % 10 < 6"), e.filter("event_id % 10 >= 4"))


def merge_two_batches(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).cast("long").alias("version"), "o_totalprice", F.lit(1).cast("long").alias("seq"))
    newer = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit(2).cast("long").alias("version"), (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit(2).cast("long").alias("seq"), F.when(F.col("o_orderkey") % 2 == 0, "D").otherwise("U").alias("op"))
    stale = o.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit(0).cast("long").alias("version"), F.lit(-1.0).alias("o_totalprice"), F.lit(3).cast("long").alias("seq"), F.lit("U").alias("op"))
    return tables.merge(o, newer.unionByName(stale), ["o_orderkey"], "version").select("o_orderkey", "version", "o_totalprice", "seq")


def positional_delete(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    rows = tables.with_position(e).select("event_id", "user_id", "file_path", "pos")
    deletes = rows.filter("event_id % 10 = 3").select("file_path", "pos")
    return tables.delete_positions(rows, deletes).select("event_id", "user_id")


def row_lineage(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_id", "user_id")
    return tables.with_lineage(e, ["event_id"], 1000, 7)


def microbatch_flush(spark, sf_dir):
    w = F.date_trunc("second", "ts").cast("timestamp_ntz")
    e = _read(spark, sf_dir, "events").groupBy(w.alias("batch_start")).agg(F.count("*").alias("n_rows"), F.min("event_id").alias("min_id"), F.max("event_id").alias("max_id"))
    return number_rows(e, "batch_start", name="wal_seq")


def _assigned(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    by = ["o_orderpriority"]
    return tables.assign_slices(o, tables.slice_bounds(o, "o_custkey", 4, by), "o_custkey", by)


def slice_assign(spark, sf_dir):
    return _assigned(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderpriority", "slice")


def slice_stats(spark, sf_dir):
    return tables.slice_stats(_assigned(spark, sf_dir), "o_custkey", ["o_orderpriority"])


def slice_split_decision(spark, sf_dir):
    return tables.split_decision(slice_stats(spark, sf_dir), 750).select("o_orderpriority", "slice", "n_rows", "split")


def slice_merge(spark, sf_dir):
    merged = tables.merge_small(slice_stats(spark, sf_dir), 1500, ["o_orderpriority"])
    return merged.groupBy("o_orderpriority", "merged").agg(F.sum("n_rows").alias("n_rows"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))


def _day_files(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return tables.file_stats(e, F.date_format("ts", "yyyy-MM-dd").alias("day"), ["event_id", "user_id"])


def file_stats(spark, sf_dir):
    return _day_files(spark, sf_dir)


def compaction_plan(spark, sf_dir):
    plan = tables.compaction_plan(_day_files(spark, sf_dir), "day", "n_rows", 1000)
    return plan.groupBy("bin").agg(F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows"))


def orphan_prune(spark, sf_dir):
    return tables.orphans(_read(spark, sf_dir, "orders").select("o_orderkey"), _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


def partition_prune(spark, sf_dir):
    return _read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_custkey >= 100").select("o_orderkey", "o_custkey")


def cluster_rank(spark, sf_dir):
    """Clustering by a column that is no key: rows with the rank of their ship date, which is one row each."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    ranks = number_rows(li.select("l_shipdate").distinct(), "l_shipdate", name="rank")
    return li.join(ranks, "l_shipdate").select("l_orderkey", "l_linenumber", "l_shipdate", "rank")


def validate_split(spark, sf_dir):
    e = _read(spark, sf_dir, "events").withColumn("user_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")))
    return tables.validate(e, ["event_id", "user_id"], {"value_range": F.col("value") >= 5}).groupBy("verdict").agg(F.count("*").alias("n_rows"))


def tenant_isolation(spark, sf_dir):
    o, c = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_nationkey").agg(F.count("*").alias("n_orders"), F.min("o_orderkey").alias("min_order"))


def route_affinity(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    key = F.concat(F.lit("events/"), F.col("event_type"))
    return e.groupBy(tables.route(key, 4).alias("worker")).agg(F.count("*").alias("n_rows"))


# ---------------------------------------------------------------- queue


def _tasks(spark, sf_dir):
    """Events as tasks: every third is running, held by w0 to w4."""
    e = _read(spark, sf_dir, "events")
    running = F.col("event_id") % 3 == 0
    return e.select(
        F.col("event_id").alias("task_id"),
        F.col("user_id").cast("string").alias("unique_id"),
        F.col("ts").alias("scheduled_at"),
        F.lit(3).alias("max_retries"),
        (F.col("event_id") % 5).cast("int").alias("retry_count"),
        F.when(running, "Running").otherwise("Created").alias("state"),
        F.when(running, F.concat(F.lit("w"), (F.col("user_id") % 5).cast("string"))).alias("worker_id"),
        F.when(running, F.col("ts") + F.expr("INTERVAL 30 SECONDS")).alias("lease_expires_at"),
    )


def queue_schedule_dedup(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("unique_id"), F.col("ts").alias("run_at"), F.col("event_id").alias("request_seq"))
    return queue.schedule(e)


def queue_lease(spark, sf_dir):
    leased = queue.lease(_tasks(spark, sf_dir), _now(), 10, "30 SECONDS", "w1")
    return leased.select("task_id", "unique_id", "attempt", "scheduled_at", "lease_expires_at", "worker_id")


def lease_expiry(spark, sf_dir):
    return _tasks(spark, sf_dir).select("task_id", "state", F.coalesce(queue.eligible(_now()), F.lit(False)).alias("eligible"))


def queue_ack(spark, sf_dir):
    """Acknowledgements of every other task, twice by each of two workers."""
    acks = _read(spark, sf_dir, "events").filter("event_id % 2 = 0").select(
        F.col("event_id").alias("task_id"),
        F.explode(F.array(*[F.concat(F.lit("w"), ((F.col("user_id") + k) % 4).cast("string")) for k in (0, 1)])).alias("ack_worker"),
        F.when(F.col("event_id") % 10 == 6, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("retry_at"),
        (F.col("event_id") % 4 == 0).alias("_ok"),
    )
    acks = acks.select("task_id", "ack_worker", "retry_at", F.posexplode(F.array("_ok", ~F.col("_ok"))).alias("ack_seq", "success"), F.lit("task failed").alias("error_message"))
    return queue.acknowledge(_tasks(spark, sf_dir), acks, _now()).select("task_id", "state", "outcome", "scheduled_at", "retry_count", "worker_id", "lease_expires_at", "error_message")


def queue_after_lease(spark, sf_dir):
    tasks = _tasks(spark, sf_dir)
    return queue.after_lease(tasks, queue.lease(tasks, _now(), 10, "30 SECONDS", "w9")).select("task_id", "state", "worker_id", "lease_expires_at")


def worker_step(spark, sf_dir):
    worked = queue.work(_tasks(spark, sf_dir), _now(), "w9", 100, 0.3)
    return worked.select("task_id", "state", "outcome", "retry_count", "worker_id", "error_message")


def queue_progress(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, "handled").otherwise("produced")
    return queue.progress(_read(spark, sf_dir, "events").select(F.col("ts"), kind.alias("kind"))).select(F.col("at").cast("timestamp_ntz").alias("began"), "produced", "handled", "in_flight")


def reload_rule(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, ("Transport", "Timeout", "Status"))), (F.col("event_id") % 3 + 1).cast("int"))
    code = F.element_at(F.array(*map(F.lit, ("NotFound", "Unavailable", "DeadlineExceeded", "Internal"))), (F.col("user_id") % 4 + 1).cast("int"))
    return e.select("event_id", queue.reloads_broker(kind, code).alias("reloads"))


def failure_rate(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", queue.fails(F.col("event_id"), 0.25).alias("fails"), queue.checked_rate(F.col("event_id") % 5 / 4).alias("rate"))


def heartbeat_extend(spark, sf_dir):
    beats = _read(spark, sf_dir, "events").filter("event_id % 2 = 0").select(F.col("event_id").alias("task_id"), F.concat(F.lit("w"), (F.col("user_id") % 4).cast("string")).alias("beat_worker"))
    return queue.heartbeat(_tasks(spark, sf_dir), beats, _now(), "30 SECONDS").select("task_id", "extended", "lease_expires_at")


def request_histogram(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("rpc"), core.bucket(F.col("value") / 10).alias("bucket")).agg(F.count("*").alias("n_requests"))


def completion_latency(spark, sf_dir):
    o, li = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    done = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("done"))
    days = F.datediff("done", "o_orderdate").cast("long")
    return o.join(done, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n_tasks"), F.min(days).alias("min_days"), F.max(days).alias("max_days"))


def log_line(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    level = F.when(F.col("value") > 15, "WARN").otherwise("INFO")
    return e.select("event_id", core.log_line(level, F.col("ts"), F.col("event_type"), core.log_field("user", F.col("user_id")), core.log_field("kind", F.col("event_type"), True)).alias("line"))


def variant_extract(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


def ack_records(spark, sf_dir):
    failed = F.col("event_id") % 4 == 0
    return _read(spark, sf_dir, "events").select("event_id", F.when(failed, "Failure").otherwise("Success").alias("result"), F.when(failed, "task failed").alias("error_message"), core.interval_ns(F.col("user_id")).alias("interval_ns"))


def completion_percentiles(spark, sf_dir):
    """Milliseconds from an order to its last shipment, by priority."""
    o, li = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    done = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("done"))
    ms = (F.datediff("done", "o_orderdate").cast("long") * 86_400_000).alias("ms")
    timed = o.join(done, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderpriority", ms)
    return timed.groupBy("o_orderpriority").agg(*[F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY ms)").cast("long").alias(f"p{p}") for p in (50, 90, 99)])


def ids(spark, sf_dir):
    """Ids of known time and bits, and whether random ones have their version."""
    e, n = _read(spark, sf_dir, "events"), F.col("event_id")
    v4 = core.uuid4().rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return e.select("event_id", core.ulid_of(n * 1000003, n * 7919, n * 104729).alias("ulid"), core.uuid7_of(n * 1000003, n, n * 104729).alias("uuid7"), v4.alias("v4"))


def log_levels(spark, sf_dir):
    level = F.element_at(F.array(*map(F.lit, core.LEVELS)), (F.col("event_id") % 5 + 1).cast("int"))
    e = _read(spark, sf_dir, "events").withColumn("level", level).filter(core.at_least(F.col("level"), "WARN"))
    return e.select("event_id", core.log_json(F.col("level"), F.col("ts"), F.col("event_type"), user=F.col("user_id")).alias("line"))


# ---------------------------------------------------------------- manifests and lake tables


def _manifests(spark, sf_dir):
    e, n = _read(spark, sf_dir, "events"), F.col("event_id")
    pair = lambda url, value: F.struct(F.lit(url).alias("type_url"), F.encode(value, "UTF-8").alias("value"))
    at = F.timestamp_millis(n * 1000)
    status = (n % 3).cast("int")
    tasks = e.select(
        core.uuid7_of(n, n, n).alias("id"), at.alias("originally_scheduled_at"), at.alias("scheduled_at"), F.lit(3).alias("max_retries"), (n % 4).cast("int").alias("retry_count"), status.alias("status"),
        F.when(status == 1, core.uuid7_of(n, n, n + 1)).alias("worker_id"), F.when(status == 1, at).alias("last_heartbeat"), F.when(status == 1, at).alias("lease_expires_at"),
        F.when(status == 2, F.col("event_type")).alias("error_message"), F.when(status == 2, pair("e", F.col("event_type"))).alias("details"), pair("p", F.col("props")).alias("payload"), (n % 64).alias("queue"),
    )
    return manifest.encode(tasks, "queue", manifest.Header("10.1.2.3", 8080, 7, manifest.ZSTD))


def manifest_round_trip(spark, sf_dir):
    """Tasks in 64 manifests, each encoded and decoded."""
    t = manifest.decode(_manifests(spark, sf_dir))
    return t.select("id", F.unix_millis("scheduled_at").alias("scheduled_ms"), "retry_count", "status", "worker_id", "error_message", F.decode("payload.value", "UTF-8").alias("payload"))


def manifest_headers(spark, sf_dir):
    return manifest.headers(_manifests(spark, sf_dir)).select(F.col("path").cast("long").alias("queue"), "version", "broker_url", F.col("epoch").cast("long").alias("epoch"), "compression")


def _lake_table(spark, sf_dir, keys=()) -> Table:
    """Events in a table of their own, partitioned by type, appended in two writes."""
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    lake = Lake(spark, f"{shared_folder(spark)}/lake-{uuid.uuid4().hex}")
    lake.create_namespace("default")
    t = lake.create_table("default", "events", e.schema, partition_by=["event_type"])
    t.append(e.filter("event_id % 2 = 0"))
    t.append(e.filter("event_id % 2 = 1"))
    return t


def _once(table: Table, rows):
    """rows, written; the table they come from goes."""
    out = cut(rows)
    path = table.spark._jvm.org.apache.hadoop.fs.Path(table.path).getParent().getParent()
    path.getFileSystem(table.spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def table_scan(spark, sf_dir):
    t = _lake_table(spark, sf_dir)
    return _once(t, t.read().filter("event_type = 'click'"))


def table_file_stats(spark, sf_dir):
    """Of each file its rows; summed up by partition and write, as the files' names are random."""
    t = _lake_table(spark, sf_dir)
    s = t.file_stats(["event_id"])
    return _once(t, s.groupBy("event_type", (F.col("min_event_id") % 2).alias("half")).agg(F.sum("n_rows").alias("n_rows"), F.min("min_event_id").alias("min_event_id"), F.max("max_event_id").alias("max_event_id")))


def table_compact(spark, sf_dir):
    """Files and rows of each partition once small files are one and the old ones are gone."""
    t = _lake_table(spark, sf_dir)
    rewritten, removed = t.compact(), t.prune()
    by = t.file_stats([]).groupBy("event_type").agg(F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows"))
    return _once(t, by.withColumn("all_removed", F.lit(rewritten == removed > 0)))


def queries():
    found = [
        entity_latest, entity_tombstone, append_union, merge_two_batches, positional_delete, row_lineage, microbatch_flush,
        slice_assign, slice_stats, slice_split_decision, slice_merge, file_stats, compaction_plan, orphan_prune, partition_prune,
        cluster_rank, validate_split, tenant_isolation, route_affinity, queue_schedule_dedup, queue_lease, lease_expiry,
        queue_ack, heartbeat_extend, request_histogram, completion_latency, log_line, variant_extract, ack_records,
        queue_after_lease, worker_step, queue_progress, reload_rule, failure_rate, completion_percentiles, ids, log_levels,
        manifest_round_trip, manifest_headers, table_scan, table_file_stats, table_compact,
    ]
    return {f.__name__: f for f in found}


_LATEST = f"SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in LINE_ORDER)}) AS rn FROM lineitem) WHERE rn = 1"
_TASKS = """SELECT event_id AS task_id, CAST(user_id AS VARCHAR) AS unique_id, ts AS scheduled_at, 3 AS max_retries, CAST(event_id % 5 AS INTEGER) AS retry_count,
  CASE WHEN event_id % 3 = 0 THEN 'Running' ELSE 'Created' END AS state, CASE WHEN event_id % 3 = 0 THEN 'w' || (user_id % 5) END AS worker_id,
  CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 30 SECOND END AS lease_expires_at FROM events"""
_NOW = f"TIMESTAMP '{NOW}'"
_ELIGIBLE = f"((state = 'Created' AND scheduled_at <= {_NOW}) OR (state = 'Running' AND lease_expires_at <= {_NOW}))"
_SLICES = """WITH tiles AS (
  SELECT o_orderpriority, o_custkey, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS slice FROM (SELECT DISTINCT o_orderpriority, o_custkey FROM orders)
), assigned AS (SELECT o_orderkey, o_custkey, o_orderpriority, CAST(slice AS INTEGER) AS slice FROM orders JOIN tiles USING (o_orderpriority, o_custkey)
), stats AS (SELECT o_orderpriority, slice, count(*) AS n_rows, min(o_custkey) AS min_key, max(o_custkey) AS max_key FROM assigned GROUP BY ALL)
"""
_DAYS = "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_rows, min(event_id) AS min_event_id, max(event_id) AS max_event_id, min(user_id) AS min_user_id, max(user_id) AS max_user_id FROM events GROUP BY ALL"


def _uuid7(millis, high, low):
    """SQL that writes an id of known bits."""
    head, tail = f"printf('%012x', {millis})", f"printf('8%015x', {low})"
    return f"substr({head}, 1, 8) || '-' || substr({head}, 9) || '-7' || printf('%03x', ({high}) % 4096) || '-' || substr({tail}, 1, 4) || '-' || substr({tail}, 5)"


def oracle_sql():
    return {
        "entity_latest": _LATEST,
        "entity_tombstone": f"SELECT l_orderkey, l_linenumber, l_shipdate FROM ({_LATEST}) WHERE l_returnflag <> 'R'",
        "append_union": "SELECT event_id, user_id FROM events WHERE event_id % 10 < 6 UNION ALL SELECT event_id, user_id FROM events WHERE event_id % 10 >= 4",
        "merge_two_batches": """SELECT o_orderkey, version, o_totalprice, seq FROM (
          SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC, seq DESC) AS rn FROM (
            SELECT o_orderkey, CAST(1 AS BIGINT) AS version, o_totalprice, CAST(1 AS BIGINT) AS seq, 'I' AS op FROM orders
            UNION ALL SELECT o_orderkey, 2, o_totalprice * 2, 2, CASE WHEN o_orderkey % 2 = 0 THEN 'D' ELSE 'U' END FROM orders WHERE o_orderkey % 3 = 0
            UNION ALL SELECT o_orderkey, 0, -1.0, 3, 'U' FROM orders WHERE o_orderkey % 5 = 0)) WHERE rn = 1 AND op <> 'D'""",
        "positional_delete": "SELECT event_id, user_id FROM events WHERE event_id % 10 <> 3",
        "row_lineage": "SELECT event_id, user_id, 999 + row_number() OVER (ORDER BY event_id) AS _row_id, CAST(7 AS BIGINT) AS _last_updated_seq FROM events",
        "microbatch_flush": "SELECT *, row_number() OVER (ORDER BY batch_start) AS wal_seq FROM (SELECT date_trunc('second', ts) AS batch_start, count(*) AS n_rows, min(event_id) AS min_id, max(event_id) AS max_id FROM events GROUP BY 1)",
        "slice_assign": _SLICES + "SELECT * FROM assigned",
        "slice_stats": _SLICES + "SELECT * FROM stats",
        "slice_split_decision": _SLICES + "SELECT o_orderpriority, slice, n_rows, n_rows > 750 AS split FROM stats",
        "slice_merge": _SLICES.replace("WITH tiles", "WITH RECURSIVE tiles", 1) + """, steps AS (
          SELECT o_orderpriority, slice, n_rows, min_key, max_key, CAST(0 AS BIGINT) AS merged, n_rows AS held FROM stats WHERE slice = 1
          UNION ALL SELECT s.o_orderpriority, s.slice, s.n_rows, s.min_key, s.max_key, CASE WHEN held + s.n_rows <= 1500 THEN merged ELSE merged + 1 END, CASE WHEN held + s.n_rows <= 1500 THEN held + s.n_rows ELSE s.n_rows END
          FROM steps p JOIN stats s ON s.o_orderpriority = p.o_orderpriority AND s.slice = p.slice + 1)
          SELECT o_orderpriority, merged, CAST(sum(n_rows) AS BIGINT) AS n_rows, min(min_key) AS min_key, max(max_key) AS max_key FROM steps GROUP BY ALL""",
        "file_stats": _DAYS,
        "compaction_plan": f"""SELECT bin, count(*) AS n_files, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM (
          SELECT *, CAST(coalesce(sum(n_rows) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1000 AS BIGINT) AS bin FROM ({_DAYS})) GROUP BY bin""",
        "orphan_prune": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
        "partition_prune": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey >= 100",
        "cluster_rank": "SELECT l_orderkey, l_linenumber, l_shipdate, dense_rank() OVER (ORDER BY l_shipdate) AS rank FROM lineitem",
        "validate_split": "SELECT CASE WHEN event_id % 7 = 0 THEN 'null_user_id' WHEN value >= 5 THEN 'ok' ELSE 'value_range' END AS verdict, count(*) AS n_rows FROM events GROUP BY 1",
        "tenant_isolation": "SELECT c_nationkey, count(*) AS n_orders, min(o_orderkey) AS min_order FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
        "route_affinity": "SELECT CAST(('0x' || substr(md5('events/' || event_type), 1, 8)) AS BIGINT) % 4 AS worker, count(*) AS n_rows FROM events GROUP BY 1",
        "queue_schedule_dedup": "SELECT unique_id, run_at, request_seq FROM (SELECT CAST(user_id AS VARCHAR) AS unique_id, ts AS run_at, event_id AS request_seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1",
        "queue_lease": f"SELECT task_id, unique_id, retry_count + 1 AS attempt, scheduled_at, {_NOW} + INTERVAL 30 SECOND AS lease_expires_at, 'w1' AS worker_id FROM ({_TASKS}) WHERE {_ELIGIBLE} ORDER BY scheduled_at, task_id LIMIT 10",
        "lease_expiry": f"SELECT task_id, state, coalesce({_ELIGIBLE}, false) AS eligible FROM ({_TASKS})",
        "queue_ack": f"""WITH a AS (SELECT event_id AS task_id, unnest(['w' || (user_id % 4), 'w' || ((user_id + 1) % 4)]) AS ack_worker, event_id % 4 = 0 AS success, CASE WHEN event_id % 10 = 6 THEN ts + INTERVAL 1 HOUR END AS retry_at FROM events WHERE event_id % 2 = 0),
          j AS (SELECT t.*, a.ack_worker, a.success, a.retry_at, CASE WHEN t.task_id % 2 <> 0 THEN 'None' WHEN ack_worker IS NULL THEN 'Rejected' WHEN success THEN 'Done' WHEN retry_count < max_retries THEN 'Retry' ELSE 'Failed' END AS outcome
            FROM ({_TASKS}) t LEFT JOIN a ON a.task_id = t.task_id AND state = 'Running' AND worker_id = ack_worker)
          SELECT task_id, CASE outcome WHEN 'Done' THEN 'Done' WHEN 'Retry' THEN 'Created' WHEN 'Failed' THEN 'Failed' ELSE state END AS state, outcome,
            CASE WHEN outcome = 'Retry' THEN coalesce(retry_at, {_NOW}) ELSE scheduled_at END AS scheduled_at, CASE WHEN outcome = 'Retry' THEN retry_count + 1 ELSE retry_count END AS retry_count,
            CASE WHEN outcome IN ('None', 'Rejected') THEN worker_id END AS worker_id, CASE WHEN outcome IN ('None', 'Rejected') THEN lease_expires_at END AS lease_expires_at, CASE WHEN outcome IN ('Retry', 'Failed') THEN 'task failed' END AS error_message FROM j""",
        "queue_after_lease": f"""WITH c AS (SELECT task_id FROM ({_TASKS}) WHERE {_ELIGIBLE} ORDER BY scheduled_at, task_id LIMIT 10)
          SELECT task_id, CASE WHEN task_id IN (FROM c) THEN 'Running' ELSE state END AS state, CASE WHEN task_id IN (FROM c) THEN 'w9' ELSE worker_id END AS worker_id,
            CASE WHEN task_id IN (FROM c) THEN {_NOW} + INTERVAL 30 SECOND ELSE lease_expires_at END AS lease_expires_at FROM ({_TASKS})""",
        "worker_step": f"""WITH c AS (SELECT task_id FROM ({_TASKS}) WHERE {_ELIGIBLE} ORDER BY scheduled_at, task_id LIMIT 100),
          j AS (SELECT *, CASE WHEN task_id NOT IN (FROM c) THEN 'None' WHEN CAST(('0x' || substr(md5('0:' || task_id), 1, 8)) AS BIGINT) / 4294967296.0 >= 0.3 THEN 'Done' WHEN retry_count < max_retries THEN 'Retry' ELSE 'Failed' END AS outcome FROM ({_TASKS}))
          SELECT task_id, CASE outcome WHEN 'None' THEN state WHEN 'Retry' THEN 'Created' ELSE outcome END AS state, outcome, CAST(retry_count + CASE WHEN outcome = 'Retry' THEN 1 ELSE 0 END AS INTEGER) AS retry_count,
            CASE WHEN outcome = 'None' THEN worker_id END AS worker_id, CASE WHEN outcome IN ('Retry', 'Failed') THEN 'task failed' END AS error_message FROM j""",
        "queue_progress": """SELECT began, CAST(sum(p) OVER w AS BIGINT) AS produced, CAST(sum(h) OVER w AS BIGINT) AS handled, CAST(sum(p - h) OVER w AS BIGINT) AS in_flight FROM (
          SELECT time_bucket(INTERVAL 5 SECOND, ts) AS began, count(*) FILTER (event_id % 3 <> 0) AS p, count(*) FILTER (event_id % 3 = 0) AS h FROM events GROUP BY 1) WINDOW w AS (ORDER BY began)""",
        "reload_rule": "SELECT event_id, event_id % 3 = 1 OR (event_id % 3 = 2 AND user_id % 4 IN (1, 2)) AS reloads FROM events",
        "failure_rate": "SELECT event_id, CAST(('0x' || substr(md5('0:' || event_id), 1, 8)) AS BIGINT) / 4294967296.0 < 0.25 AS fails, (event_id % 5) / CAST(4 AS DOUBLE) AS rate FROM events",
        "completion_percentiles": "SELECT o_orderpriority, " + ", ".join(f"quantile_disc(d, {p / 100}) AS p{p}" for p in (50, 90, 99)) + " FROM (SELECT o_orderpriority, date_diff('day', o_orderdate, done) * 86400000 AS d FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS done FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey) GROUP BY 1",
        "ids": "SELECT event_id, " + " || ".join(f"substr('{core.CROCKFORD}', CAST((({x}) >> {5 * i}) & 31 AS BIGINT) + 1, 1)" for x, n in (("event_id * 1000003", 10), ("event_id * 7919", 8), ("event_id * 104729", 8)) for i in range(n - 1, -1, -1)) + f" AS ulid, {_uuid7('event_id * 1000003', 'event_id', 'event_id * 104729')} AS uuid7, true AS v4 FROM events",
        "log_levels": """SELECT event_id, '{"level":"' || CASE event_id % 5 WHEN 3 THEN 'WARN' ELSE 'ERROR' END || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '","message":"' || event_type || '","user":' || user_id || '}' AS line FROM events WHERE event_id % 5 >= 3""",
        "manifest_round_trip": f"SELECT {_uuid7('event_id', 'event_id', 'event_id')} AS id, event_id * 1000 AS scheduled_ms, CAST(event_id % 4 AS INTEGER) AS retry_count, CAST(event_id % 3 AS INTEGER) AS status, CASE WHEN event_id % 3 = 1 THEN {_uuid7('event_id', 'event_id', 'event_id + 1')} END AS worker_id, CASE WHEN event_id % 3 = 2 THEN event_type END AS error_message, props AS payload FROM events",
        "manifest_headers": "SELECT DISTINCT event_id % 64 AS queue, 1 AS version, 'http://10.1.2.3:8080' AS broker_url, CAST(7 AS BIGINT) AS epoch, 1 AS compression FROM events",
        "table_scan": "SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'click'",
        "table_file_stats": "SELECT event_type, event_id % 2 AS half, count(*) AS n_rows, min(event_id) AS min_event_id, max(event_id) AS max_event_id FROM events GROUP BY 1, 2",
        "table_compact": "SELECT event_type, CAST(1 AS BIGINT) AS n_files, count(*) AS n_rows, true AS all_removed FROM events GROUP BY 1",
        "heartbeat_extend": f"""WITH b AS (SELECT event_id AS task_id, 'w' || (user_id % 4) AS beat_worker FROM events WHERE event_id % 2 = 0),
          j AS (SELECT t.*, coalesce(state = 'Running' AND worker_id = beat_worker AND lease_expires_at > {_NOW}, false) AS extended FROM ({_TASKS}) t LEFT JOIN b USING (task_id))
          SELECT task_id, extended, CASE WHEN extended THEN {_NOW} + INTERVAL 30 SECOND ELSE lease_expires_at END AS lease_expires_at FROM j""",
        "request_histogram": "SELECT event_type AS rpc, CAST(" + " + ".join(f"(value / 10 > CAST({b} AS DOUBLE))::INT" for b in core.BOUNDS) + " AS INTEGER) AS bucket, count(*) AS n_requests FROM events GROUP BY 1, 2",
        "completion_latency": "SELECT o_orderpriority, count(*) AS n_tasks, min(d) AS min_days, max(d) AS max_days FROM (SELECT o_orderpriority, date_diff('day', o_orderdate, done) AS d FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS done FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey) GROUP BY 1",
        "log_line": """SELECT event_id, '[' || CASE WHEN value > 15 THEN 'WARN' ELSE 'INFO' END || '] [' || strftime(ts, '%m-%d|%H:%M:%S') || '.' || lpad(CAST(date_part('millisecond', ts) % 1000 AS VARCHAR), 3, '0') || '] ' || rpad(event_type, CAST(greatest(length(event_type), 40) AS INTEGER), ' ') || ' user=' || user_id || ' kind="' || event_type || '"' AS line FROM events""",
        "variant_extract": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
        "ack_records": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Failure' ELSE 'Success' END AS result, CASE WHEN event_id % 4 = 0 THEN 'task failed' END AS error_message, CAST(greatest(floor(1000000000 / greatest(user_id, 1)), 1) AS BIGINT) AS interval_ns FROM events",
    }
