"""A kept index of vectors: inverted lists around centroids, probed by the nearest lists of a query.

Centroids come from k-means over a bounded sample; every row goes to the list of its nearest centroid. Rows lie sorted by
list, so a search reads the row groups of the lists it probes. Filters on the rows' other columns work before any vector
is looked at. Searching all lists is exact. Changes work by segments, as in ``text_index``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.versioned import Tables
from ..streaming.run import kept
from .retrieve import _best, ranked

#: Rows that centroids are learned from, their number at most, rounds of learning, and rows of a block that is multiplied at once.
SAMPLE, MOST_LISTS, ROUNDS, BLOCK = 65_536, 4_096, 12, 2_048
#: Rows that are searched for, to learn how many lists a wanted recall takes.
TRIED = 256


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def learned(sample: np.ndarray, lists: int, seed: int = 1) -> np.ndarray:
    """Directions of centroids by k-means on the sphere; lists that run empty begin again at the worst placed rows."""
    x = _unit(sample)
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = np.empty(len(x), np.int64)
        fit = np.empty(len(x))
        for at in range(0, len(x), BLOCK):
            scores = x[at : at + BLOCK] @ centers.T
            near[at : at + BLOCK], fit[at : at + BLOCK] = scores.argmax(1), scores.max(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        empty = np.bincount(near, minlength=len(centers)) == 0
        sums[empty] = x[np.argsort(fit)[: int(empty.sum())]]
        centers = _unit(sums)
    return centers


def _nearest_lists(centers: np.ndarray, probes: int):
    step = max(1, BLOCK // max(1, min(probes, len(centers))))  # so that a batch that goes out has a block's rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                if not len(centers):
                    continue
                scores = _matrix(batch.column("vector")) @ centers.T
                n = min(probes, len(centers))
                best = np.argpartition(-scores, n - 1, axis=1)[:, :n] if n < len(centers) else np.tile(np.arange(n), (len(scores), 1))
                rows = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), n)))
                yield pa.RecordBatch.from_arrays([pa.array(best.ravel().astype(np.int32)), *rows.columns], ["list", *batch.schema.names])

    return run


def _in_lists(rows: DataFrame, centers: np.ndarray, probes: int) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_nearest_lists(centers, probes), f"list int, {fields}")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by list -> a row for each run of one list: its ids and its vectors as one matrix."""
    for batch in batches:
        lists = batch.column("list").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]])) if len(lists) else []
        for a, b in zip(cuts, [*cuts[1:], len(lists)]):
            for at in range(a, b, BLOCK):
                part = batch.slice(at, min(BLOCK, b - at))
                yield pa.RecordBatch.from_arrays([part.column("list").slice(0, 1), pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([_matrix(part.column("vector")).tobytes()])], ["list", "ids", "data"])


class VectorIndex:
    """An index in a folder; each change is one commit."""

    def __init__(self, store: Tables):
        self.store = store

    def build(self, rows: DataFrame, operation: str, lists: int | None = None) -> int:
        """``rows(id long, vector array<double>, ...)``; ids are distinct. The number of lists is the root of the rows' by default."""
        n = rows.count()
        lists = min(MOST_LISTS, lists or max(1, round(n**0.5)))
        share = min(1.0, 1.1 * SAMPLE / max(n, 1))
        sample = (rows if share == 1 else rows.sample(share, 1)).select("vector").limit(SAMPLE)
        centers = sample.repartition(1).mapInArrow(_learn(lists), "list int, center array<double>")
        with self.store.transaction(operation) as t:
            t.write("centers", centers)
            t.append("rows", self._sorted(rows, self._centers(t.read("centers")), t.base + 1))
            t.append("gone", rows.limit(0).select("id", F.lit(t.base + 1).alias("segment")))
            return t.commit()

    @staticmethod
    def _sorted(rows: DataFrame, centers: np.ndarray, segment: int) -> DataFrame:
        placed = _in_lists(rows, centers, 1).withColumn("segment", F.lit(segment))
        return placed.repartitionByRange("list", "id").sortWithinPartitions("list", "id")  # a list may fill many partitions

    @staticmethod
    def _centers(table: DataFrame) -> np.ndarray:
        """At most ``MOST_LISTS`` vectors."""
        centers = [r.center for r in table.orderBy("list").collect()]
        return np.array(centers) if centers else np.zeros((0, 1))

    def rows(self) -> DataFrame:
        return self.store.read("rows").join(self.store.read("gone"), ["id", "segment"], "left_anti")

    def upsert(self, rows: DataFrame, operation: str) -> int:
        """Rows in place of those with the same ids, in the lists that there are."""
        done = self.store.committed(operation)
        if done is not None:
            return done
        with self.store.transaction(operation) as t:
            old = kept(self.rows().join(rows.select("id"), "id", "left_semi").select("id", "segment"), "leaving")
            t.append("rows", self._sorted(rows, self._centers(t.read("centers")), t.base + 1))
            t.append("gone", old)
            return t.commit()

    def delete(self, ids: DataFrame, operation: str) -> int:
        done = self.store.committed(operation)
        if done is not None:
            return done
        with self.store.transaction(operation) as t:
            t.append("gone", self.rows().join(ids.select("id"), "id", "left_semi").select("id", "segment"))
            return t.commit()

    def search(self, queries: DataFrame, k: int, probes: int | None = None, where: Column | None = None, digits: int = 6) -> DataFrame:
        """``query_id, doc_id, score, rank`` of the largest dot products in the ``probes`` nearest lists of each query; in all if None.

        ``queries(query_id long, vector)``. ``where`` is a condition on the rows' own columns.
        """
        centers = self._centers(self.store.read("centers"))
        rows = self.rows() if where is None else self.rows().where(where)
        if not len(centers):
            return queries.select("query_id", F.lit(0).cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        if probes is None or probes >= len(centers):  # every query goes to every block; lists don't matter
            asked = queries.select(F.lit(0).alias("list"), F.col("query_id").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(_blocks, "list int, ids array<long>, data binary")
            whole = rows.select(F.lit(0).alias("list"), "id", "vector").mapInArrow(_blocks, "list int, ids array<long>, data binary")
            pairs = whole.select("ids", "data").crossJoin(asked.select(F.col("ids").alias("qids"), F.col("data").alias("qdata")))
            return ranked(pairs.mapInArrow(_best(k, digits), "query_id long, doc_id long, score double"), k, F.col("doc_id"), digits)
        wanted = _in_lists(queries.select(F.col("query_id").alias("id"), F.col("vector").cast("array<double>").alias("vector")), centers, probes)
        asked = kept(wanted.repartition("list").sortWithinPartitions("list").mapInArrow(_blocks, "list int, ids array<long>, data binary"), "asked")
        blocks = rows.select("list", "id", "vector").sortWithinPartitions("list").mapInArrow(_blocks, "list int, ids array<long>, data binary")
        pairs = blocks.join(asked.select("list", F.col("ids").alias("qids"), F.col("data").alias("qdata")), "list")
        return ranked(pairs.select("ids", "data", "qids", "qdata").mapInArrow(_best(k, digits), "query_id long, doc_id long, score double"), k, F.col("doc_id"), digits)

    def probes_for(self, target: float, k: int, seed: int = 3) -> int:
        """How many lists to probe so that of the exact best ``k`` a share of ``target`` is found, as measured on ``TRIED`` rows."""
        rows = self.rows().select("id", "list", "vector")
        n = rows.count()
        tried = kept((rows if n <= TRIED else rows.sample(min(1.0, 1.2 * TRIED / n), seed)).limit(TRIED), "tried")
        hits = self.search(tried.select(F.col("id").alias("query_id"), "vector"), k)
        where = hits.join(rows.select(F.col("id").alias("doc_id"), "list"), "doc_id").select("query_id", "list").collect()  # TRIED * k rows
        centers = self._centers(self.store.read("centers"))
        order = {r.id: np.argsort(np.argsort(-(np.array(r.vector) @ centers.T))) for r in tried.collect()}
        places = np.sort([order[r.query_id][r.list] for r in where])
        return int(places[min(len(places) - 1, int(np.ceil(target * len(places))))]) + 1 if len(places) else 1


def _learn(lists: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [_matrix(b.column("vector")) for b in batches if b.num_rows]
        if sample:
            centers = learned(np.concatenate(sample), lists)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centers), dtype=np.int32)), pa.array(list(centers), pa.list_(pa.float64()))], ["list", "center"])

    return run


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``query_id, share``: how much of the exact result was found."""
    hit = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("share"))
