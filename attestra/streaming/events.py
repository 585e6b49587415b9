"""Windows, sessions, first occurrences and leases over the event stream.

What is emitted in append mode is emitted once, when the watermark has passed it, and leaves the state then. What is still
open when the input ends stays in the state and comes with later input; ``final_sessions`` closes it, as no more will come.
Rows older than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.tables import table
from .run import finished, keyed_state, shared_folder, source

LEASE_MS = 3_600_000
#: How long after a lease's end its key is remembered.
FORGET_MS = 24 * LEASE_MS


def tumbling(spark: SparkSession, sf_dir: str, size: str = "1 hour", late: str = "60 days") -> DataFrame:
    """Counts and sums by window and type. The last emission of a window is its result."""
    e = source(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    stream = e.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    out = finished(stream.select(F.col("w.start").alias("window_start"), "event_type", "events", "total"), "update")
    last = out.groupBy("window_start", "event_type").agg(F.max(F.struct("epoch", "events", "total")).alias("r"))
    return last.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "r.events", F.round("r.total", 4).alias("total"))


def _events(spark: SparkSession, sf_dir: str, late: str) -> DataFrame:
    return source(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """``user_id, session_start, session_end, events`` of ``events(at, user_id)`` with a watermark: sessions ended by a gap."""
    stream = events.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return stream.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "30 minutes") -> DataFrame:
    """``window_start, event_type, events, most`` of overlapping windows."""
    stream = events.groupBy(F.window("at", size, step).alias("w"), "event_type").agg(F.count("*").alias("events"), F.max("value").alias("most"))
    return stream.select(F.col("w.start").alias("window_start"), "event_type", "events", "most")


def firsts(events: DataFrame) -> DataFrame:
    """``user_id, content_hash`` of contents that the user hasn't sent within the watermark; copies go as they come in."""
    content = F.sha2(F.concat_ws("|", "event_type", "props"), 256)
    return events.withColumn("content_hash", content).dropDuplicatesWithinWatermark(["user_id", "content_hash"]).select("user_id", "content_hash")


def final_sessions(spark: SparkSession, sf_dir: str, late: str = "2 hours", gap: str = "30 minutes") -> DataFrame:
    """All sessions of the input. Its end closes those still open: one row, later than them all, moves the watermark past them.

    That row's own session ends behind the watermark and is never emitted.
    """
    rows = source(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), "user_id")
    spark.createDataFrame([], rows.schema).write.parquet(end := shared_folder(spark, "end"))

    def close() -> None:
        last = table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("at")).where("at IS NOT NULL")
        last.select((F.col("at") + F.expr(f"INTERVAL {late} {gap} 1 second")).alias("at"), F.lit(None).cast(rows.schema["user_id"].dataType).alias("user_id")).write.mode("append").parquet(end)

    both = rows.unionByName(spark.readStream.schema(rows.schema).parquet(end)).withWatermark("at", late)
    out = finished(sessions(both, gap), "append", close)
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")), "events")


def final_sliding(spark: SparkSession, sf_dir: str, late: str = "2 hours") -> DataFrame:
    out = finished(sliding(_events(spark, sf_dir, late)), "append")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", "most")


def final_firsts(spark: SparkSession, sf_dir: str, late: str = "60 days") -> DataFrame:
    return finished(firsts(_events(spark, sf_dir, late)), "append").drop("epoch")


class Leases(StatefulProcessor):
    """A key's lease: who asks while it runs finds it BUSY, who asks later takes it over; a timer says when it has run out.

    A second timer forgets the key, so state holds the keys of the last day only. Outcomes follow event times alone, so
    they don't depend on how rows are spread over batches, as long as none is late.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "until long, attempt long, over boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        both = [(r["ms"].to_numpy(np.int64), r["event_id"].to_numpy(np.int64)) for r in rows]
        ms, ids = (np.concatenate(x) for x in zip(*both))
        order = np.lexsort([ids, ms])
        ms, ids = ms[order], ids[order]
        until, attempt, over = self.lease.get() or (None, 0, True)  # one call to the state; each is a trip to the engine
        timer = until if until is None or not over else until + FORGET_MS  # the one that is set
        outcomes, attempts, ended = np.full(len(ms), "BUSY", object), np.zeros(len(ms), np.int64), []
        at = 0
        while at < len(ms):  # a round for each lease
            if until is not None and ms[at] < until:
                to = int(np.searchsorted(ms, until, "left"))
                attempts[at:to] = attempt
                at = to
                continue
            if until is not None and not over:
                ended.append((until, attempt))
            known = until is not None and ms[at] < until + FORGET_MS
            outcomes[at], attempt = ("TAKEN_OVER", attempt + 1) if known else ("ACQUIRED", 1)
            until, over = int(ms[at]) + LEASE_MS, False
            attempts[at] = attempt
            at += 1
        if not over and timer != until:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(until)
        self.lease.update((until, attempt, over))
        yield _outcomes(key[0], ids, ms, outcomes, attempts, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, attempt, over = self.lease.get()
        if over:
            self.lease.clear()
            return
        self.lease.update((until, attempt, True))
        self.handle.registerTimer(until + FORGET_MS)
        none = np.zeros(0, np.int64)
        yield _outcomes(key[0], none, none, none.astype(object), none, [(until, attempt)])

    def close(self) -> None:
        pass


def _outcomes(key: int, ids: np.ndarray, ms: np.ndarray, outcomes: np.ndarray, attempts: np.ndarray, ended: list[tuple[int, int]]) -> pd.DataFrame:
    """What became of events, then the leases that ended, which have no event: one frame a key, as each costs more than its rows."""
    over = np.array(ended, np.int64).reshape(-1, 2)
    event = pd.arrays.IntegerArray(np.append(ids, np.zeros(len(over), np.int64)), np.repeat([False, True], [len(ids), len(over)]))
    return pd.DataFrame({"user_id": key, "event_id": event, "ms": np.append(ms, over[:, 0]), "outcome": np.append(outcomes, np.full(len(over), "EXPIRED", object)), "attempt": np.append(attempts, over[:, 1])})


def leases(events: DataFrame) -> DataFrame:
    """``user_id, event_id, ms, outcome, attempt`` of ``events(at, user_id, event_id)`` with a watermark.

    A row for each event, and a row EXPIRED without an event at each lease's end, once the watermark or a later request has
    passed it.
    """
    rows = events.select("user_id", "event_id", "at", F.unix_millis("at").alias("ms"))
    return rows.groupBy("user_id").transformWithStateInPandas(Leases(), "user_id long, event_id long, ms long, outcome string, attempt long", "Append", "EventTime")


def final_leases(spark: SparkSession, sf_dir: str, late: str = "2 hours") -> DataFrame:
    with keyed_state(spark):
        return finished(leases(_events(spark, sf_dir, late)), "append").drop("epoch")
