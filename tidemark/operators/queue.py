"""A task queue as a DataFrame: schedule, lease, acknowledge and heartbeat give the table's next state.

Tasks: task_id, unique_id, originally_scheduled_at, scheduled_at, max_retries, retry_count, state
(Created, Running, Failed), worker_id, last_heartbeat, lease_expires_at, error_message. `now` is an
argument, so that results don't depend on the clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_sums

MAX_RETRIES = 3


def schedule(requests: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Requests that become tasks: the first of each unique_id, unless a live task has it.

    requests: unique_id, run_at, request_seq.
    """
    w = Window.partitionBy("unique_id").orderBy("run_at", "request_seq")
    first = requests.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return first if live is None else first.join(live.select("unique_id"), "unique_id", "left_anti")


def eligible(now: Column) -> Column:
    """Due, or leased with a lease that is over at `now`."""
    return ((F.col("state") == "Created") & (F.col("scheduled_at") <= now)) | ((F.col("state") == "Running") & (F.col("lease_expires_at") <= now))


def lease(tasks: DataFrame, now: Column, max_tasks: int, lease_for: str, worker_id: str) -> DataFrame:
    """The tasks a poll gets: eligible, in order of schedule, at least one and at most max_tasks."""
    chosen = tasks.filter(eligible(now)).orderBy("scheduled_at", "task_id").limit(max(1, max_tasks))
    return (
        chosen.withColumn("attempt", F.col("retry_count") + 1)
        .withColumn("worker_id", F.lit(worker_id))
        .withColumn("lease_expires_at", now + F.expr(f"INTERVAL {lease_for}"))
        .withColumn("state", F.lit("Running"))
    )


def after_lease(tasks: DataFrame, leased: DataFrame) -> DataFrame:
    """All tasks as they are once `leased`, what a poll got, is running. leased has a poll's max_tasks rows at most, so it is broadcast."""
    held = leased.select(F.col("task_id").alias("_id"), F.col("worker_id").alias("_worker"), F.col("lease_expires_at").alias("_until"))
    t = tasks.join(F.broadcast(held), F.col("task_id") == F.col("_id"), "left")
    got = F.col("_id").isNotNull()
    changed = {"state": F.lit("Running"), "worker_id": F.col("_worker"), "lease_expires_at": F.col("_until")}
    return t.select(*[F.when(got, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in tasks.columns])


def acknowledge(tasks: DataFrame, acks: DataFrame, now: Column, order: Sequence[str] = ("ack_seq",)) -> DataFrame:
    """All tasks after acknowledgements, one row each, with outcome and error_message.

    acks: task_id, ack_worker, success, retry_at, perhaps error_message and the columns of order (which of a
    worker's acknowledgements came first; else success, then retry_at decide). Only the worker that holds a
    running task may acknowledge it, and only its first acknowledgement counts; a task that has others alone is
    Rejected. Success: Done. Failure: Created again at retry_at or now while retries are left, else Failed.
    A task that is no longer running has no worker and no lease.
    """
    if "error_message" not in acks.columns:
        acks = acks.withColumn("error_message", F.lit(None).cast("string"))
    by = [c for c in order if c in acks.columns]
    first = acks.groupBy(F.col("task_id").alias("_id"), "ack_worker").agg(F.min(F.struct(*by, (~F.col("success")).alias("failed"), "retry_at", "error_message")).alias("_ack"))
    any_ = acks.select(F.col("task_id").alias("_any")).distinct()
    holds = (F.col("task_id") == F.col("_id")) & (F.col("worker_id") == F.col("ack_worker")) & (F.col("state") == "Running")
    t = tasks.drop("error_message").join(first, holds, "left").join(any_, F.col("task_id") == F.col("_any"), "left")
    retry = F.col("retry_count") < F.col("max_retries")
    outcome = F.when(F.col("_any").isNull(), "None").when(F.col("_id").isNull(), "Rejected").when(~F.col("_ack.failed"), "Done").when(retry, "Retry").otherwise("Failed")
    t = t.withColumn("outcome", outcome)
    is_ = lambda *x: F.col("outcome").isin(*x)
    over = is_("Done", "Retry", "Failed")
    return (
        t.withColumn("state", F.when(is_("Retry"), "Created").when(over, F.col("outcome")).otherwise(F.col("state")))
        .withColumn("scheduled_at", F.when(is_("Retry"), F.coalesce("_ack.retry_at", now)).otherwise(F.col("scheduled_at")))
        .withColumn("retry_count", F.when(is_("Retry"), F.col("retry_count") + 1).otherwise(F.col("retry_count")))
        .withColumn("worker_id", F.when(~over, F.col("worker_id")))
        .withColumn("lease_expires_at", F.when(~over, F.col("lease_expires_at")))
        .withColumn("error_message", F.when(is_("Retry", "Failed"), F.col("_ack.error_message")))
        .drop("ack_worker", "_ack", "_id", "_any")
    )


def heartbeat(tasks: DataFrame, beats: DataFrame, now: Column, lease_for: str) -> DataFrame:
    """Extends the leases of tasks whose holder beats, however often: beats has beat_worker and task_id. Others are left as they are."""
    own = beats.select(F.col("task_id").alias("_id"), F.col("beat_worker").alias("_worker")).distinct()
    t = tasks.join(own, (F.col("task_id") == F.col("_id")) & (F.col("worker_id") == F.col("_worker")), "left")
    mine = F.coalesce(F.col("_id").isNotNull() & (F.col("state") == "Running") & (F.col("lease_expires_at") > now), F.lit(False))
    return t.withColumn("extended", mine).withColumn("lease_expires_at", F.when(mine, now + F.expr(f"INTERVAL {lease_for}")).otherwise(F.col("lease_expires_at"))).drop("_id", "_worker")


def work(tasks: DataFrame, now: Column, worker_id: str, max_tasks: int = 10, error_rate: float = 0.0, lease_for: str = "30 SECONDS", seed: int = 0) -> DataFrame:
    """The table after one step of a worker: poll, fail at a rate, acknowledge. A foreachBatch of a trigger at the worker's rate runs it again and again."""
    leased = lease(tasks, now, max_tasks, lease_for, worker_id)
    acks = leased.select("task_id", F.col("worker_id").alias("ack_worker"), (~fails(F.col("task_id"), error_rate, seed)).alias("success"), F.lit(None).cast(tasks.schema["scheduled_at"].dataType).alias("retry_at"), F.lit("task failed").alias("error_message"))
    return acknowledge(after_lease(tasks, leased), acks, now)


def fails(key: Column, rate: float, seed: int = 0) -> Column:
    """Whether the event of this key fails, as a share `rate` of them do; the same in every run."""
    if not 0 <= rate <= 1:
        raise ValueError("a rate is a number from 0 to 1")
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32) < F.lit(float(rate))


def checked_rate(rate: Column) -> Column:
    """rate, or an error if it isn't from 0 to 1."""
    return F.when(rate.between(0, 1), rate).otherwise(F.raise_error(F.lit("a rate is a number from 0 to 1")))


#: Status codes after which a client looks for the broker anew. Fixed values.
RELOAD_CODES = ("Unavailable", "DeadlineExceeded")


def reloads_broker(kind: Column, code: Column) -> Column:
    """Whether an error (its kind: Transport, Timeout, Status ...; a status has a code) is one of a broker that may have moved."""
    return F.coalesce((kind == "Timeout") | ((kind == "Status") & code.isin(*RELOAD_CODES)), F.lit(False))


def progress(events: DataFrame, every: str = "5 seconds") -> DataFrame:
    """Running counts and gauges for each interval: produced, handled, and in_flight, what is produced and not handled. events: ts, kind (produced, handled)."""
    is_ = lambda k: F.count_if(F.col("kind") == k)
    counts = events.groupBy(F.window("ts", every).start.alias("at")).agg(is_("produced").alias("n_produced"), is_("handled").alias("n_handled"))
    summed = running_sums(counts, ["at"], {"produced": F.col("n_produced"), "handled": F.col("n_handled")})
    return summed.select("at", "produced", "handled", (F.col("produced") - F.col("handled")).alias("in_flight"))
