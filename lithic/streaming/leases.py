"""Leases as keyed state with timers: a queue row is held by one worker until it is finished or its lease runs out.

A row's state lives with its key. A claim sets a timer for the end of the lease in event time, a heartbeat moves it, and when the watermark
passes it the row is free again, so that no sweep over the whole queue looks for expired leases.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from lithic.streaming.queue import LEASE

ROW = StructType([
    StructField("status", StringType()), StructField("worker", StringType()), StructField("attempts", IntegerType()), StructField("last_error", StringType()),
    StructField("until", LongType()), StructField("cancel", BooleanType()),
])
OUT = "queue_id long, seq long, status string, worker string, attempts int, last_error string, at timestamp"
#: The session needs this store for timers.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


NAMES = [c.split()[0] for c in OUT.split(", ")]
#: status, worker, attempts, last_error, until, cancel of a row that no event has changed yet.
NEW = ("queued", None, 0, None, 0, False)


def ran_out(row: tuple) -> tuple:
    return ("done" if row[5] else "queued", None, row[2], row[3], 0, row[5])


def after(row: tuple, op: str, worker: str | None, error: str | None, now: int, known: bool) -> tuple | None:
    """A row's state after an event at a time (ms), None if it changes nothing."""
    status, holder, attempts, last, until, cancel = row
    end = now + int(LEASE.total_seconds() * 1000)
    holds = status == "leased" and holder == worker
    if op == "enqueue" and (not known or status == "done"):
        return ("queued", None, attempts, None, 0, False)
    if op == "claim" and status == "queued":
        return ("leased", worker, attempts + 1, last, end, cancel)
    if op == "heartbeat" and holds:
        return ("leased", holder, attempts, last, end, cancel)
    if op == "finish" and holds:
        return ("queued" if error is not None and not cancel else "done", None, attempts, last if error is None else error, 0, cancel)
    if op == "cancel" and status == "queued":
        return ("done", None, attempts, last, 0, True)
    if op == "cancel" and status == "leased":
        return ("leased", holder, attempts, last, until, True)
    return None


class Leases(StatefulProcessor):
    """Events of a row (seq, ts, op, worker, error) in order of (ts, seq). enqueue: queued unless it is open. claim: leased by the worker if it is queued, else nothing. heartbeat: the
    holder's lease starts anew. finish: done, or queued again with the error, if the worker holds it. cancel: a queued row is done, a leased one becomes so once it
    isn't held any more. A row without an enqueue counts as queued at its first claim. Every change is put out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", ROW)

    def moved(self, key: tuple, seq: int, old: tuple, new: tuple, at: int) -> tuple:
        """Keep a new state, with the timer of its lease in place of the old one's, and say what it is."""
        if old[4] != new[4]:
            if old[4]:
                self.handle.deleteTimer(old[4])
            if new[4]:
                self.handle.registerTimer(new[4])
        self.row.update(new)
        return (key[0], seq, *new[:4], pd.Timestamp(at, unit="ms"))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "seq"], kind="stable")
        known, out = self.row.exists(), []
        row = tuple(self.row.get()) if known else NEW
        for e in events.itertuples():
            now = e.ts.value // 1_000_000
            if row[0] == "leased" and row[4] <= now:  # it ran out before this event, whether or not the watermark has got there
                out.append(self.moved(key, -1, row, ended := ran_out(row), row[4]))
                row = ended
            new = after(row, e.op, e.worker, e.error if isinstance(e.error, str) else None, now, known)
            if new is not None:
                out.append(self.moved(key, int(e.seq), row, new, now))
                row, known = new, True
        yield pd.DataFrame(out, columns=NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        row, at = tuple(self.row.get()), expiredTimerInfo.getExpiryTimeInMs()
        out = []
        if row[0] == "leased" and row[4] == at:
            new = ran_out(row)
            self.row.update(new)
            out.append((key[0], -1, *new[:4], pd.Timestamp(at, unit="ms")))
        yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def leased_states(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """A stream of queue events (queue_id, seq, ts, op, worker, error) as the stream of each row's states: queue_id, seq (-1: the lease ran out), status, worker, attempts, last_error, at."""
    rows = events.select("queue_id", "seq", "ts", "op", "worker", "error").withWatermark("ts", late)
    return rows.groupBy("queue_id").transformWithStateInPandas(Leases(), OUT, "Append", "EventTime")


def latest(states: DataFrame) -> DataFrame:
    """The last state of each row of a table of states."""
    order = F.struct("at", F.col("seq") >= 0, "seq")
    return states.groupBy("queue_id").agg(F.max_by(F.struct("status", "worker", "attempts", "last_error"), order).alias("s")).select("queue_id", "s.*")
