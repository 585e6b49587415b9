"""Streams in several batches: what is emitted, what the state still holds, what is late."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestra.streaming import events
from attestra.streaming.run import keyed_state

HOUR = 3600
START = datetime.datetime(2024, 1, 1)


def run(spark, tmp_path, batches, make, late="1 hour"):
    """A file a batch; gives the emitted rows by epoch and the rows of state after each batch."""
    for n, rows in enumerate(batches):
        data = [(i, START + datetime.timedelta(seconds=s), u, t, float(i), f"p{i % 3}") for i, s, u, t in rows]
        spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{n:03d}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "000")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")).withColumn("at", F.col("ts")).withWatermark("at", late)
    out = []
    with keyed_state(spark):
        query = make(stream).writeStream.outputMode("append").foreachBatch(lambda df, epoch: out.extend((epoch, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    return out, [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def outcomes(rows):
    return sorted((r[1], r[3], r[4], r[5], r[2]) for r in rows if r[2] is not None), sorted((r[1], r[3], r[5]) for r in rows if r[4] == "EXPIRED")


ASKS = [(1, 0, 1, "a"), (2, 600, 1, "a"), (3, 2 * HOUR, 1, "a"), (4, 2 * HOUR + 5, 2, "a"), (5, 4 * HOUR, 2, "a"), (6, 40 * HOUR, 1, "a"), (7, 80 * HOUR, 3, "a")]


@pytest.mark.parametrize("cuts", [[7], [2, 3, 5, 7], [1, 2, 3, 4, 5, 6, 7]])
def test_leases_dont_depend_on_batches(spark, tmp_path, cuts):
    batches = [ASKS[a:b] for a, b in zip([0, *cuts], cuts)]
    rows, state = run(spark, tmp_path, batches, events.leases)
    got, ended = outcomes(rows)
    assert [(u, o, n) for u, _, o, n, _ in got] == [(1, "ACQUIRED", 1), (1, "BUSY", 1), (1, "TAKEN_OVER", 2), (1, "ACQUIRED", 1), (2, "ACQUIRED", 1), (2, "TAKEN_OVER", 2), (3, "ACQUIRED", 1)]
    at = lambda s: int((START + datetime.timedelta(seconds=s) - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
    assert ended == sorted([(1, at(HOUR), 1), (1, at(3 * HOUR), 2), (2, at(2 * HOUR + 5 + HOUR), 1), (2, at(5 * HOUR), 2), (1, at(41 * HOUR), 1)])


def test_sessions_and_windows_come_once_and_leave_the_state(spark, tmp_path):
    batches = [[(i, i * 60, i % 5, "a") for i in range(20)], [(98, 50 * HOUR, 9, "b")], [(99, 50 * HOUR + 1, 9, "b")], [(100, 100, 0, "late")], [(101, 51 * HOUR, 9, "b")]]  # lateness counts from the batch after next
    rows, state = run(spark, tmp_path, batches, events.sessions)
    assert sorted(r[1] for r in rows) == [0, 1, 2, 3, 4] and sum(r[4] for r in rows) == 20  # the late row is in none
    assert state[0] == 5 and state[-1] <= 2
    rows, state = run(spark, tmp_path / "w", batches, events.sliding)
    assert len({(r[1], r[2]) for r in rows}) == len(rows) and sum(r[3] for r in rows) == 4 * 20  # each event is in four windows


def test_copies_go_until_the_watermark_has_passed_them(spark, tmp_path):
    batches = [[(0, 0, 1, "a"), (3, 10, 1, "a"), (1, 20, 1, "a")], [(6, 30, 1, "a")], [(9, 50 * HOUR, 2, "a")], [(10, 50 * HOUR, 2, "b")], [(12, 51 * HOUR, 1, "a")]]
    rows, state = run(spark, tmp_path, batches, events.firsts)
    assert sorted(r[1] for r in rows) == [1, 1, 1, 2, 2]  # user 1 may send the first content again two days later
    assert state[-1] <= 3


def test_a_key_costs_one_frame_and_one_read_of_its_state():
    calls = []

    class State:
        def get(self):
            calls.append("get")

        def exists(self):
            calls.append("exists")
            return False

        def update(self, value):
            calls.append("update")

    lease = events.Leases()
    lease.lease, lease.handle = State(), type("Handle", (), {"registerTimer": lambda self, at: calls.append(at)})()
    frames = list(lease.handleInputRows((7,), iter([pd.DataFrame({"ms": [0, 10, events.LEASE_MS], "event_id": [1, 2, 3]})]), None))
    assert len(frames) == 1 and calls == ["get", 2 * events.LEASE_MS, "update"]
    assert frames[0].astype(object).where(frames[0].notna(), None).values.tolist() == [
        [7, 1, 0, "ACQUIRED", 1], [7, 2, 10, "BUSY", 1], [7, 3, events.LEASE_MS, "TAKEN_OVER", 2], [7, None, events.LEASE_MS, "EXPIRED", 1]
    ]
