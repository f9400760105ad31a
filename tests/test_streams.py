"""Change logs, leases and feeds as streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lithic.functions.storage import shared_dir
from lithic.streaming import capture, leases

CHANGES = "seq long, at timestamp_ntz, document_id long, op string, content_hash string"
T0 = datetime(2024, 1, 1)


def change(seq, doc, op, content=None):
    return (seq, T0 + timedelta(minutes=seq), doc, op, content)


def facts(spark):
    return spark.createDataFrame([(1, 1, None, None), (2, 1, T0, "superseded"), (3, 2, None, None), (4, 99, None, None)], "fact_id long, document_id long, valid_to timestamp_ntz, reason string")


def state(log):
    docs = sorted((r.document_id, r.content_hash, r.version, r.reason) for r in log.documents().collect())
    raw = sorted((r.document_id, r.version, r.content_hash, r.reason) for r in log.raw().collect())
    return docs, raw, sorted((r.fact_id, r.reason) for r in log.facts().collect())


def test_batches_land_retire_and_revive(spark):
    log = capture.CaptureLog(spark, shared_dir(spark, "log"), facts(spark), capture.Storm(None))
    first = [change(1, 1, "upsert", "a"), change(2, 1, "upsert", "a"), change(3, 1, "upsert", "b"), change(4, 2, "upsert", "x"), change(5, 3, "delete"), change(6, None, "upsert", "z"), change(6, 2, "upsert", "x")]
    log.apply(spark.createDataFrame(first, CHANGES), 0)
    assert state(log) == ([(1, "b", 2, None), (2, "x", 1, None)], [(1, 1, "a", None), (1, 2, "b", None), (2, 1, "x", None)], [(1, None), (2, "superseded"), (3, None), (4, None)])
    second = spark.createDataFrame([change(10, 1, "delete"), change(11, 2, "delete"), change(12, 2, "upsert", "y")], CHANGES)
    log.apply(second, 1)
    after = ([(1, "b", 2, "source_tombstone"), (2, "y", 2, None)], [(1, 1, "a", "source_tombstone"), (1, 2, "b", "source_tombstone"), (2, 1, "x", None), (2, 2, "y", None)], [(1, "source_tombstone"), (2, "superseded"), (3, None), (4, None)])
    assert state(log) == after
    log.apply(second, 1)  # run again
    assert state(log) == after and log.ledger().count() == 2
    log.apply(spark.createDataFrame([change(20, 1, "upsert", "b")], CHANGES), 2)
    docs, _, f = state(log)
    assert docs[0] == (1, "b", 2, None) and f[0] == (1, None) and f[1] == (2, "superseded")
    assert [r.revived for r in log.ledger().orderBy("batch").collect()] == [0, 0, 1]
    assert log.documents().filter("document_id = 1 AND valid_to IS NULL").count() == 1


def test_storm_guard_and_resync(spark):
    log = capture.CaptureLog(spark, shared_dir(spark, "log"), facts(spark), capture.Storm(2, 0.1))
    log.apply(spark.createDataFrame([change(i, i, "upsert", f"c{i}") for i in range(1, 9)], CHANGES), 0)
    log.resync(spark.createDataFrame([(1, "c1"), (2, "new"), (50, "c50")], "document_id long, content_hash string"), T0 + timedelta(days=1))
    docs = {r.document_id: (r.content_hash, r.reason) for r in log.documents().collect()}
    assert docs[1] == ("c1", None) and docs[2] == ("new", None) and docs[50] == ("c50", None)
    assert [d for d, x in docs.items() if x[1]] == [3, 4]  # six are missing, two may go
    last = log.ledger().filter("batch = 1").first()
    assert (last.status, last.landed, last.tombstoned, last.refused) == ("storm", 2, 2, 4)


def test_empty_batches_and_log(spark):
    log = capture.CaptureLog(spark, shared_dir(spark, "log"), facts(spark).limit(0))
    assert log.documents().count() == 0
    log.apply(spark.createDataFrame([], CHANGES), 0)
    assert state(log) == ([], [], []) and log.ledger().count() == 1


EVENTS = "queue_id long, seq long, ts timestamp, op string, worker string, error string"


def run_leases(spark, batches):
    folder, out = shared_dir(spark, "queue"), shared_dir(spark, "states")
    for b in batches:
        spark.createDataFrame(b, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    spark.conf.set(*leases.STATE_STORE)
    try:
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
        leases.leased_states(stream).writeStream.format("parquet").option("checkpointLocation", shared_dir(spark, "check")).trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.unset(leases.STATE_STORE[0])
    return spark.read.schema(leases.OUT).parquet(out)


def event(queue_id, seq, minute, op, worker=None, error=None):
    return (queue_id, seq, T0 + timedelta(minutes=minute), op, worker, error)


def test_leases_run_out_by_timers(spark):
    tick = [event(-1, 0, 60, "tick")]
    states = run_leases(spark, [
        [event(1, 1, 0, "enqueue"), event(1, 2, 1, "claim", "a"), event(1, 3, 2, "claim", "b"), event(2, 4, 0, "claim", "a"), event(3, 5, 0, "claim", "a"), event(4, 6, 0, "claim", "a"), event(5, 7, 0, "heartbeat", "a")],
        [event(1, 8, 5, "heartbeat", "a"), event(2, 9, 3, "finish", "b"), event(2, 10, 4, "finish", "a"), event(3, 11, 4, "finish", "a", "boom"), event(4, 12, 4, "cancel")],
        [event(1, 13, 9, "heartbeat", "b"), event(3, 14, 59, "claim", "c"), event(2, 15, 20, "enqueue"), event(6, 16, 58, "claim", "z")], tick, tick,
    ])
    last = {r.queue_id: (r.status, r.worker, r.attempts, r.last_error) for r in leases.latest(states).collect()}
    assert last == {
        1: ("queued", None, 1, None), 2: ("queued", None, 1, None), 3: ("leased", "c", 2, "boom"), 4: ("done", None, 1, None), 6: ("leased", "z", 1, None),
    }
    assert states.filter("seq = -1 AND queue_id = 1").first().at == T0 + timedelta(minutes=10)  # the heartbeat moved the end
    assert states.filter("queue_id = 5").count() == 0


@pytest.mark.parametrize("row,event_,want", [
    (leases.NEW, ("claim", "a", None), ("leased", "a", 1, None, 300_000, False)),
    (("leased", "a", 1, None, 9, True), ("finish", "a", "boom"), ("done", None, 1, "boom", 0, True)),
    (("leased", "a", 1, None, 9, False), ("claim", "b", None), None),
    (("done", None, 1, None, 0, False), ("cancel", "b", None), None),
    (("done", None, 3, "x", 0, True), ("enqueue", None, None), ("queued", None, 3, None, 0, False)),
])
def test_lease_steps(row, event_, want):
    assert leases.after(row, *event_, 0, True) == want


def test_states_in_order(spark):
    rows = spark.createDataFrame([(1, -1, "queued", None, 1, None, T0), (1, 5, "leased", "a", 2, None, T0)], leases.OUT)
    assert leases.latest(rows).first().status == "leased"
    assert leases.latest(rows.filter(F.lit(False))).count() == 0
