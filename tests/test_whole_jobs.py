"""Jobs that have to be whole whatever the size of their input: sessions at the input's end, evidence in ranges of claims."""

import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from attestra.operators import text_index, vector_index, verify
from attestra.streaming import events


def test_open_sessions_come_when_the_input_ends(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=m), u) for i, (m, u) in enumerate([(0, 1), (10, 1), (300, 1), (301, None), (310, 2), (339, 1), (340, 1)])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = sorted(((r.user_id or 0), (r.session_start - start).seconds // 60, (r.session_end - start).seconds // 60, r.events) for r in events.final_sessions(spark, str(tmp_path)).collect())
    assert found == [(0, 301, 331, 1), (1, 0, 40, 2), (1, 300, 330, 1), (1, 339, 370, 2), (2, 310, 340, 1)]


def test_evidence_in_runs_is_that_of_ids(spark):
    hits = spark.createDataFrame([(i, "c", 1, 1, 1, [i, i + 1]) for i in range(12)] + [(20, "c", 1, 1, 1, [1, 8]), (21, "c", 1, 1, 1, [])], "query_id long, chunk_id string, note_id long, version_id long, generation long, claim_ids array<long>")
    notes = spark.createDataFrame([(1, 1, 1, None, "p")], "note_id long, version_id long, generation long, deleted_at long, path string")
    versions = spark.createDataFrame([(1, "ACTIVE", "h")], "version_id long, status string, content_hash string")
    by_ids = spark.createDataFrame([("h", 1, 1, [1, 2, 3, 7, 8])], "content_hash string, note_id long, version_id long, claim_ids array<long>")
    by_runs = by_ids.drop("claim_ids").withColumn("claim_runs", F.expr("array(struct(1L AS first, 3L AS last), struct(7L AS first, 8L AS last))"))
    found = lambda artifacts: sorted(r.query_id for r in verify.located_evidence(hits, notes, versions, artifacts).collect())
    assert found(by_ids) == found(by_runs) == [1, 2, 7, 20, 21]


def test_queries_go_to_their_lists_in_bounded_batches():
    rng = np.random.default_rng(1)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(list(rng.normal(size=(3000, 4))), pa.list_(pa.float64()))], ["id", "vector"])
    given = list(vector_index._nearest_lists(rng.normal(size=(256, 4)), 256)([batch]))
    assert max(b.num_rows for b in given) <= vector_index.BLOCK and sum(b.num_rows for b in given) == 3000 * 256


def test_a_task_gathers_postings_by_token():
    """A token's name leaves a task once for all documents there, its blocks are the heaviest first, and runs over several batches are one."""
    kind = pa.list_(pa.struct([("token", pa.string()), ("tf", pa.int64()), ("length", pa.int64())]))
    rows = [[{"token": "all", "tf": 1 + i % 7, "length": 50 + i}, {"token": f"t{i % 40}", "tf": 2, "length": 50 + i}] for i in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 100)), pa.array(rows[a : a + 100], kind)], ["chunk_id", "counts"]) for a in (0, 100, 200)]
    (packed,) = text_index._packed(128, 1 << 20)(batches)
    assert packed.num_rows == 41 and packed.column("token").to_pylist() == sorted(packed.column("token").to_pylist())
    runs = packed.drop_columns("salt")
    blocks = [r for b in text_index._cut(128, 1 << 20, 1)([runs.slice(i, 1) for i in range(41)]) for r in b.to_pylist()]
    hot = [b for b in blocks if b["token"] == "all"]
    assert [len(b["ids"]) for b in hot] == [128, 128, 44] and sorted(i for b in hot for i in b["ids"]) == list(range(300))
    assert [t for b in hot for t in b["tfs"]] == sorted((1 + i % 7 for i in range(300)), reverse=True)
    assert all(b["most_tf"] == max(b["tfs"]) and b["least_length"] == min(b["lengths"]) for b in blocks) and len(blocks) == 43
