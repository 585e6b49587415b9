"""Packing token pieces into windows by Karmarkar-Karp multiway differencing.

Documents are cut into full windows, which stay as they are, and a rest in pieces of a quarter of a window at most: with
four pieces or more to a window the sums come out within a percent of each other. The pieces meet in bounded batches; in each, every piece starts as a partial partition over k windows, and the two partitions of largest imbalance
are merged again and again with opposing order (largest with smallest), which leaves k windows of nearly equal sums.
k starts at the least number that could hold the batch and rises whenever a window exceeds its capacity.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import Encoder
from .shared import Workspace, small_batches

#: Pieces packed together; parts of a window that a piece of a document's rest may fill.
BATCH, PARTS = 1024, 4
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def differencing(lengths: list[int], windows: int) -> list[list[int]]:
    """The windows' members by largest differencing over ``windows`` parts."""
    left, right, item = [], [], []

    def node(a: int, b: int, i: int) -> int:
        left.append(a)
        right.append(b)
        item.append(i)
        return len(item) - 1

    heap = []
    for i, n in enumerate(lengths):
        sums, roots = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], roots[0] = n, node(-1, -1, i)
        heap.append((-n, i, sums, roots))
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, s, r = heapq.heappop(heap)
        _, _, t, q = heapq.heappop(heap)
        t, q = t[::-1], q[::-1]  # both are sorted, largest first
        total = s + t
        joined = np.where(q < 0, r, q)
        for i in np.flatnonzero((r >= 0) & (q >= 0)):
            joined[i] = node(int(r[i]), int(q[i]), -1)
        order = np.argsort(-total, kind="stable")
        total = total[order]
        heapq.heappush(heap, (int(total[-1] - total[0]), serial, total, joined[order]))
        serial += 1
    out = []
    for root in heap[0][3].tolist() if heap else []:
        members, stack = [], [root]
        while stack:
            x = stack.pop()
            if x >= 0:
                if item[x] >= 0:
                    members.append(item[x])
                stack += (left[x], right[x])
        out.append(sorted(members))
    return out


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; each index lies in exactly one."""
    if not lengths:
        return []
    if max(lengths) > capacity:
        raise ValueError("a piece is longer than a window")
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        windows = differencing(lengths, k)
        if all(sum(lengths[i] for i in w) <= capacity for w in windows):
            return [w for w in windows if w]
        k += 1


def _cut(tokenizer: str, end_id: int, capacity: int):
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            out = []
            for doc, found in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                ids = memoryview(np.concatenate([found, end])).cast("B")
                n = len(ids) // 4
                whole, part = n - n % capacity, max(1, capacity // PARTS)
                cuts = [(at, capacity) for at in range(0, whole, capacity)] + [(at, min(part, n - at)) for at in range(whole, n, part)]
                out += [(doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n) for at, size in cuts]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(5)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _assign(capacity: int, batch_size: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []

        def windows(rows: list[tuple]) -> list[tuple]:
            nonlocal serial
            out = []
            for window in pack([r[2] for r in rows], capacity):
                offset = 0
                for i in window:
                    out.append((*rows[i], serial, offset))
                    offset += rows[i][2]
                serial += 1
            return out

        def rows_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(7)], [*names, "sequence_id", "offset"])

        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if row[2] == capacity:
                    out.append((*row, serial, 0))
                    serial += 1
                else:
                    waiting.append(row)
                    if len(waiting) == batch_size:
                        out += windows(waiting)
                        waiting = []
            yield rows_of(out)
        yield rows_of(windows(waiting))

    return run


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """``docs(doc_id long, text string, ...)`` -> ``doc_id, start, length, ids_crc32, doc_tokens`` for each piece."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cut(tokenizer, end_id, capacity), PIECES)


def packed(docs: DataFrame, ws: Workspace, tokenizer: str | None = None, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """A row for each piece: those of ``token_pieces`` with ``sequence_id`` and ``offset``, gapless from 0 in a sequence.

    Null texts count as empty: they hold the end id alone. Rows with equal or null ids are documents of their own. An
    empty table gives an empty result; other columns are ignored. Pieces are written before they are dealt out, so that
    a repeated task sees the same rows in the same order.
    """
    with small_batches(docs.sparkSession):
        pieces = ws.keep(token_pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id, capacity), "pieces")
    order = ("mixed", "doc_id", "start", "ids_crc32")
    dealt = pieces.withColumn("mixed", F.xxhash64("doc_id", "start", "ids_crc32", "length"))
    dealt = dealt.repartition(F.col("mixed")).sortWithinPartitions(*order).drop("mixed")
    return dealt.mapInArrow(_assign(capacity, BATCH), PIECES + ", sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    return ws.keep(packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), ws), "packed")
