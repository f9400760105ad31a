"""Queue states as table transitions, and the streams built on them.

A live queue runs in one micro-batch writer at a time (foreachBatch with a checkpoint), so no row locks are needed.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LEASE = timedelta(minutes=5)


def enqueued(queue: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """Queue with the new rows whose key has no open row yet."""
    return queue.unionByName(new.dropDuplicates([key]).join(queue.filter("status <> 'done'").select(key), key, "left_anti").select(*new.columns), allowMissingColumns=True)


def available(as_of: datetime) -> Column:
    now = F.lit(as_of).cast("timestamp_ntz")
    free = (F.col("status") == "queued") | ((F.col("status") == "leased") & (F.col("leased_until") <= now))
    return free & (F.col("available_at") <= now)


def claimed(queue: DataFrame, as_of: datetime, n: int) -> DataFrame:
    """The first n rows by id that can be had: queued ones and expired leases."""
    return queue.filter(available(as_of)).orderBy("queue_id").limit(n)


def leased(queue: DataFrame, as_of: datetime, n: int) -> DataFrame:
    """Queue after a claim of n rows."""
    mine = claimed(queue, as_of, n).select("queue_id", F.lit(True).alias("mine"))
    rows = queue.join(mine, "queue_id", "left")
    until = F.lit(as_of + LEASE).cast("timestamp_ntz")
    return rows.withColumns({"status": F.when(F.col("mine"), "leased").otherwise(F.col("status")), "leased_until": F.when(F.col("mine"), until).otherwise(F.col("leased_until")), "attempts": F.col("attempts") + F.coalesce(F.col("mine").cast("int"), F.lit(0))}).drop("mine")


def finished(queue: DataFrame, results: DataFrame) -> DataFrame:
    """results: queue_id, error. Done rows are acknowledged; failed ones go back to the queue with their error, never to a state of their own."""
    rows = queue.join(results.withColumn("told", F.lit(True)), "queue_id", "left")
    ok, failed = F.col("told") & F.col("error").isNull(), F.col("told") & F.col("error").isNotNull()
    return rows.withColumns({"status": F.when(ok, "done").when(failed, "queued").otherwise(F.col("status")), "last_error": F.when(failed, F.col("error")).otherwise(F.col("last_error"))}).drop("told", "error")


def retried(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """Alerting rows are queued again and their acknowledgement cleared."""
    rows = queue.join(ids.withColumn("hit", F.lit(True)), "queue_id", "left")
    hit = F.coalesce("hit", F.lit(False)) & F.col("last_error").isNotNull() & (F.col("status") != "done")
    return rows.withColumns({"status": F.when(hit, "queued").otherwise(F.col("status")), "acknowledged": F.when(hit, False).otherwise(F.col("acknowledged"))}).drop("hit")


def acknowledged(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """Alerting rows are marked as seen, once."""
    rows = queue.join(ids.withColumn("hit", F.lit(True)), "queue_id", "left")
    hit = F.coalesce("hit", F.lit(False)) & F.col("last_error").isNotNull() & (F.col("status") != "done")
    return rows.withColumn("acknowledged", F.col("acknowledged") | hit).drop("hit")


def advanced_cursor(cursor: Column, seen: Column, monotone: bool) -> Column:
    """A monotone cursor never goes back; an opaque one is what was seen last."""
    return F.greatest(F.coalesce(cursor, F.lit("")), seen) if monotone else seen


def delayed(version: Column, track: Column, tracks: list[str], at: Column, delay: timedelta) -> Column:
    """When a document may be extracted: later for new versions on the listed tracks."""
    return F.when((version > 1) & track.isin(tracks), at + F.lit(delay)).otherwise(at)


def requeued_jobs(jobs: DataFrame, as_of: datetime, stale: timedelta) -> DataFrame:
    """Running jobs without a sign of life for too long go back to the queue; a cancel request keeps its first time."""
    old = (F.col("status") == "running") & (F.col("heartbeat_at") < F.lit(as_of - stale))
    return jobs.withColumn("status", F.when(old, "queued").otherwise(F.col("status")))


def per_minute(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events per minute and type of a stream or table; late events are waited for as long as given."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("minute"), "event_type", "n")


def sliding(events: DataFrame, size: str, step: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def deduplicated(events: DataFrame, key: str = "event_id", overlap: str = "300 seconds") -> DataFrame:
    """Events once by key although sweeps overlap by so much."""
    return events.withWatermark("ts", overlap).dropDuplicatesWithinWatermark([key])


def drained(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what is there in micro-batches, then stop; a repeated batch has the same number, so `apply` can be idempotent."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
