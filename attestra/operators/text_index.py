"""A kept inverted index: BM25 without reading texts, brought up to date by segments.

Rows that come in make a segment of postings; rows that go are named as dead with the segment they are in. Document
frequencies and lengths are kept as sums of differences, so they are exact after any sequence of changes. Postings lie
in blocks of the same token, those of most weight first, with the largest frequency and the smallest length of the
block: what its best document can score. A search drops the blocks that can't reach the best ``k``, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_counts
from ..sources.versioned import Tables
from ..streaming.run import kept
from .retrieve import K1, B, _doc_blocks, best_of_blocks, ranked

#: Postings of a block, and postings that a task gathers or sorts at once, so that a token in every document is dealt out.
BLOCK, SHARD = 128, 1 << 20


def _documents(rows: DataFrame, segment: int) -> DataFrame:
    counts = token_counts(F.col("text"))
    rows = rows.select(F.col("chunk_id").cast("long").alias("chunk_id"), "version_id", F.sha2("text", 256).alias("content_hash"), F.coalesce(counts, F.array().cast("array<struct<token: string, tf: bigint, length: bigint>>")).alias("counts"))
    return rows.withColumn("length", F.coalesce(F.get("counts", F.lit(0))["length"], F.lit(0))).withColumn("segment", F.lit(segment))


def _runs(tokens: pa.Array, ids: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, most: int | None) -> pa.RecordBatch:
    """Postings as a row a token, or rows of ``most`` postings of it; the heaviest first."""
    coded = tokens.dictionary_encode()
    names = coded.dictionary.take(order := pc.sort_indices(coded.dictionary))  # tokens stay in their order
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    code = place[coded.indices.to_numpy(zero_copy_only=False)]
    by = np.lexsort((ids, lengths, -tfs.astype(np.int64), code))
    code, ids, tfs, lengths = code[by], ids[by], tfs[by], lengths[by]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    if most:
        inside = np.arange(len(code)) - first[np.searchsorted(first, np.arange(len(code)), "right") - 1]
        first = np.flatnonzero(inside % most == 0)
    offsets = pa.array(np.append(first, len(code)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, tfs, lengths)]
    return pa.RecordBatch.from_arrays([names.take(pa.array(code[first])), *lists], ["token", "ids", "tfs", "lengths"])


def _packed(block: int, at_once: int):
    """Rows with counts -> their postings by token; a token that fills a block here has a salt, so that its postings are dealt out."""

    def out(parts: list[tuple]) -> pa.RecordBatch:
        tokens = pa.concat_arrays([p[0] for p in parts])
        rows = _runs(tokens, *(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3)), None)
        full = pc.list_value_length(rows.column("ids")).to_numpy() >= block
        salt = np.where(full, rows.column("ids").flatten().to_numpy()[rows.column("ids").offsets.to_numpy()[:-1]] + 1, 0)
        return rows.append_column("salt", pa.array(salt))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            counts = batch.column("counts")
            flat, sizes = counts.flatten(), pc.list_value_length(counts).to_numpy(zero_copy_only=False)
            if not len(flat):
                continue
            number = lambda name: flat.field(name).to_numpy(zero_copy_only=False).astype(np.int32)
            parts.append((flat.field("token"), np.repeat(batch.column("chunk_id").to_numpy(zero_copy_only=False), sizes), number("tf"), number("length")))
            held += len(flat)
            if held >= at_once:
                yield out(parts)
                parts, held = [], 0
        if parts:
            yield out(parts)

    return run


def _cut(block: int, at_once: int, segment: int):
    """Runs sorted by token -> blocks. What belongs to a batch's last token waits for the next batch, up to a bound."""

    def taken(runs: pa.RecordBatch) -> tuple:
        sizes = pc.list_value_length(runs.column("ids")).to_numpy(zero_copy_only=False)
        return (runs.column("token").take(pa.array(np.repeat(np.arange(runs.num_rows), sizes))), *(runs.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "tfs", "lengths")))

    def out(parts: list[tuple]) -> pa.RecordBatch:
        rows = _runs(pa.concat_arrays([p[0] for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3)), block)
        starts = rows.column("ids").offsets.to_numpy()[:-1]
        most, least = rows.column("tfs").values.to_numpy()[starts], np.minimum.reduceat(rows.column("lengths").values.to_numpy(), starts)
        lists = [rows.column("ids"), *(rows.column(c).cast(pa.list_(pa.int64())) for c in ("tfs", "lengths"))]
        columns = [rows.column("token"), pa.array(np.full(rows.num_rows, segment, np.int32)), *lists, pa.array(most.astype(np.int64)), pa.array(least.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["token", "segment", "ids", "tfs", "lengths", "most_tf", "least_length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = batch.column("token")
            last = pc.index(pc.equal(tokens, tokens[-1]), True).as_py()  # the runs of the last token begin here
            if parts and (last or parts[-1][0][-1] != tokens[0]):
                parts.append(taken(batch.slice(0, last))) if last else None
                yield out(parts)
                parts, held = [], 0
            elif last:
                yield out([taken(batch.slice(0, last))])
            parts.append(taken(batch.slice(last)))
            held += len(parts[-1][0])
            if held >= at_once:
                yield out(parts)
                parts, held = [], 0
        if parts:
            yield out(parts)

    return run


def _postings(documents: DataFrame, segment: int) -> DataFrame:
    """``token, segment, ids, tfs, lengths, most_tf, least_length``: blocks of each token's postings, the heaviest first.

    Tasks gather postings by token before the one shuffle, so a token's name travels once for many of its postings.
    """
    packed = documents.select("chunk_id", "counts").mapInArrow(_packed(BLOCK, SHARD), "token string, ids array<long>, tfs array<int>, lengths array<int>, salt long")
    met = packed.repartition("token", "salt").drop("salt").sortWithinPartitions("token")
    return met.mapInArrow(_cut(BLOCK, SHARD, segment), "token string, segment int, ids array<long>, tfs array<long>, lengths array<long>, most_tf long, least_length long")


def _dealt(buckets: int, at_once: int):
    """Blocks of postings, and rows that are dead as blocks without a token -> what a task has gathered for each bucket of documents."""

    def out(parts: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(parts).combine_chunks()
        ids = rows.column("id").to_numpy()
        bucket = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)
        code = rows.column("token").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        by = np.lexsort((ids, code, bucket))
        rows, ids, bucket = rows.take(pa.array(by)).combine_chunks(), ids[by], bucket[by].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        sealed = []
        for a, b in zip(first, [*first[1:], len(ids)], strict=True):
            part = rows.slice(a, b - a)
            part = part.set_column(0, "token", part.column("token").dictionary_encode()).set_column(2, "id", pa.array(np.diff(ids[a:b], prepend=0)))
            with pa.ipc.new_stream(sink := pa.BufferOutputStream(), part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(part)
            sealed.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(sealed, pa.binary())], ["bucket", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            sizes = pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False)
            of = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            tfs, lengths = (batch.column(x).flatten().cast(pa.int32()) for x in ("tfs", "lengths"))
            parts.append(pa.table([batch.column("token").take(of), batch.column("segment").take(of), batch.column("ids").flatten(), tfs, lengths], ["token", "segment", "id", "tf", "length"]))
            held += len(of)
            if held >= at_once:
                yield out(parts)
                parts, held = [], 0
        if held:
            yield out(parts)

    return run


def _met(parts: pa.Table) -> pa.Table:
    """All that was gathered for a bucket of documents -> blocks of its documents with their counts, without postings of dead rows."""
    opened = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in parts.column("part")]
    ids = np.concatenate([np.cumsum(p.column("id").to_numpy()) for p in opened])
    token = pa.concat_arrays([x.cast(pa.string()) for p in opened for x in p.column("token").chunks])
    segment, tf, length = (np.concatenate([p.column(x).to_numpy() for p in opened]) for x in ("segment", "tf", "length"))
    dead = token.is_null().to_numpy(zero_copy_only=False)
    by = np.lexsort((~dead, segment, ids))  # what is dead stands before its postings
    first = np.concatenate([[True], (ids[by][1:] != ids[by][:-1]) | (segment[by][1:] != segment[by][:-1])])
    by = by[~dead[by][np.flatnonzero(first)][np.cumsum(first) - 1]]
    starts = np.flatnonzero(np.concatenate([[True], ids[by][1:] != ids[by][:-1]])[: len(by)])
    flat = pa.StructArray.from_arrays([token.take(pa.array(by)), pa.array(tf[by]), pa.array(length[by])], ["token", "tf", "length"])
    docs = pa.RecordBatch.from_arrays([pa.array(ids[by][starts]), pa.ListArray.from_arrays(pa.array(np.append(starts, len(by)).astype(np.int32)), flat)], ["doc_id", "counts"])
    return pa.Table.from_batches(_doc_blocks([docs]), pa.schema([("docs", pa.binary())]))


def _terms_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.sum(F.size("ids")).alias("df"))


def _term_changes(documents: DataFrame, sign: int) -> DataFrame:
    tokens = documents.where("length > 0").select(F.explode(F.split("tokens", " ")).alias("token"))
    return tokens.groupBy("token").agg((F.count("*") * sign).alias("df"))


def _totals(documents: DataFrame, sign: int) -> DataFrame:
    with_words = documents.where("length > 0")
    return with_words.agg((F.count("*") * sign).alias("n"), (F.coalesce(F.sum("length"), F.lit(0)) * sign).alias("total"))


class TextIndex:
    """An index in a folder. Each change is one commit of all its tables, so a search sees all of it or nothing."""

    def __init__(self, store: Tables):
        self.store = store

    def documents(self, version: int | None = None) -> DataFrame:
        """The rows that are in the index: ``chunk_id, version_id, content_hash, counts, length, segment``."""
        rows = self.store.read("documents", version)
        return rows.join(self.store.read("dead", version), ["chunk_id", "segment"], "left_anti")

    def lookup(self, chunk_ids: DataFrame | None = None, version_id: object = None) -> DataFrame:
        """``chunk_id, version_id, content_hash`` of given ids, each once, or of one version."""
        rows = self.documents().select("chunk_id", "version_id", "content_hash")
        if version_id is not None:
            rows = rows.where(F.col("version_id") == version_id)
        return rows if chunk_ids is None else rows.join(chunk_ids.select("chunk_id"), "chunk_id", "left_semi")

    def _change(self, operation: str, new: DataFrame | None, gone: DataFrame | None) -> int:
        """``gone(chunk_id)`` leaves, then ``new(chunk_id, version_id, text)`` enters in place of what had the same ids."""
        done = self.store.committed(operation)
        if done is not None:
            return done
        with self.store.transaction(operation) as t:
            segment, first = t.base + 1, "documents" not in t.tables
            if new is not None:
                t.append("documents", _documents(new, segment))
                rows = self.store._read(t.tables["documents"][-1:])
            else:
                rows = self.documents().limit(0)
            held = rows.limit(0) if first else self.store.read("documents", t.base)
            held = held.select("chunk_id", "segment", "length", F.array_join("counts.token", " ").alias("tokens"))  # what it takes to count a row out; a token has no blank
            if not first:
                leaving = kept(rows.select("chunk_id") if gone is None else gone.select(F.col("chunk_id").cast("long").alias("chunk_id")), "leaving")
                held = kept(held.join(leaving, "chunk_id", "left_semi").join(self.store.read("dead", t.base), ["chunk_id", "segment"], "left_anti"), "old")
            if new is None:
                t.append("documents", rows)
            t.append("dead", held.select("chunk_id", "segment"))
            t.append("postings", _postings(rows, segment))
            entered = _terms_of(self.store._read(t.tables["postings"][-1:]))
            t.append("terms", entered.unionByName(_term_changes(held, -1)).groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0"))
            t.append("totals", _totals(rows, 1).unionByName(_totals(held, -1)))
            return t.commit()

    def upsert(self, rows: DataFrame, operation: str) -> int:
        """``rows(chunk_id long, version_id, text)`` in place of those with the same ids; ids are distinct. Null texts are empty."""
        return self._change(operation, rows, None)

    def delete(self, chunk_ids: DataFrame, operation: str) -> int:
        return self._change(operation, None, chunk_ids)

    def compact(self, operation: str) -> int:
        """One segment of all that is live, made without texts; searches find the same."""
        with self.store.transaction(operation) as t:
            rows = self.documents(t.base).withColumn("segment", F.lit(t.base + 1))
            t.write("documents", rows)
            rows = t.read("documents")
            t.write("dead", rows.limit(0).select("chunk_id", "segment"))
            t.write("postings", _postings(rows, t.base + 1))
            t.write("terms", _terms_of(t.read("postings")))
            t.write("totals", _totals(rows, 1))
            return t.commit()

    def weights(self, queries: DataFrame) -> DataFrame:
        """``query_id, token, weight, mean`` of ``queries(query_id, token, tf)``, from what the index knows."""
        df = self.store.read("terms").join(queries.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.sum("df").cast("double").alias("df")).where("df > 0")
        corpus = self.store.read("totals").agg(F.sum("n").cast("double").alias("n"), F.sum("total").cast("double").alias("total"))  # one row
        idf = df.crossJoin(corpus).select("token", (F.col("total") / F.col("n")).alias("mean"), F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        return queries.join(idf, "token").select("query_id", "token", (F.col("tf") * F.col("idf")).alias("weight"), "mean")

    def search(self, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
        """``query_id, doc_id, score, rank`` of the best ``k``, as exact as a search of all postings.

        A floor for a query's ``k``-th score comes from the heaviest block of each of its tokens: what documents score by
        these blocks alone is no more than they score in all. A block goes if its best document, were it the best in all
        other tokens too, stays below the floor of every query with its token. What is left is dealt out by document, each
        posting once for all queries, and scored where all of a document's postings are.
        """
        c = F.col
        share = lambda tf, length: tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / c("mean")))
        weights = kept(self.weights(queries), "weights")
        asked = weights.select("token", "mean").distinct()
        dead = self.store.read("dead")

        met = self.store.read("postings").join(asked, "token").withColumn("most", share(c("most_tf"), c("least_length")))
        tops = met.groupBy("token", "mean").agg(F.max("most").alias("top"), F.sum(F.size("ids")).alias("postings"), F.max_by(F.struct("segment", "ids", "tfs", "lengths"), "most").alias("b"))
        tops = kept(tops, "tops")  # a row for each token asked for
        rows = tops.select("token", "mean", "b.segment", F.inline(F.arrays_zip(c("b.ids").alias("chunk_id"), c("b.tfs").alias("tf"), c("b.lengths").alias("length"))))
        rows = rows.join(dead, ["chunk_id", "segment"], "left_anti").select("token", c("chunk_id").alias("doc_id"), share(c("tf"), c("length")).alias("share"))
        sums = rows.join(weights, "token").groupBy("query_id", "doc_id").agg(F.sum(c("weight") * c("share")).alias("score"))
        floor = ranked(sums, k, c("doc_id"), 12).where(c("rank") == k).select("query_id", c("score").alias("floor"))
        own = weights.drop("mean").join(tops.select("token", "mean", "top"), "token").withColumn("most", c("weight") * c("top"))
        bound = own.groupBy("query_id").agg(F.sum("most").alias("all")).join(floor, "query_id", "left")
        least = F.when(c("floor").isNull(), 0.0).otherwise((c("floor") * (1 - 1e-9) - 1e-9 - c("all") + c("most")) / c("weight"))
        least = kept(own.join(bound, "query_id").groupBy("token", "mean").agg(F.min(least).alias("least")), "least")

        open_ = self.store.read("postings").join(least, "token").where(share(c("most_tf"), c("least_length")) >= c("least")).select("token", "segment", "ids", "tfs", "lengths")
        none = F.array(F.lit(0).cast("long"))
        gone = dead.select(F.lit(None).cast("string").alias("token"), "segment", F.array("chunk_id").alias("ids"), none.alias("tfs"), none.alias("lengths"))
        buckets = (tops.agg(F.sum("postings")).first()[0] or 0) // SHARD + 1
        dealt = open_.unionByName(gone).mapInArrow(_dealt(buckets, SHARD), "bucket long, part binary")
        blocks = dealt.groupBy("bucket").applyInArrow(_met, "docs binary")
        return best_of_blocks(blocks, "long", weights, k, digits)
