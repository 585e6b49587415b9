"""Passages that an earlier document has already, found with sorted suffixes and cut out.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts in a document with a smaller id. Three passes find
these strings. First, suffixes at anchors are range-partitioned by their leading bytes with sampled splitters; each range
is sorted by multikey quicksort, and stretches that a document of smaller id has whole are done. Only stretches whose
anchor also stands in unlike stretches, and the first ones of anchors that lie on a splitter and so in several ranges, go
on: their bytes are partitioned the same way, and each range sorts their windows, byte for byte. Last, windows whose
anchor lies on a splitter are compared across ranges: each range hands on its first documents only.

Anchors of hot passages fill several ranges by document, so no range holds a group whole. Ranges hold about ``PER_RANGE``
rows. Equal stretches are told by 104 bits of two hashes; windows by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace, arrow_map
from .suffixes import WIDTH, Splitters, as_words, multikey_order, starts_of, stretches, utf8_of, windows

#: Rows of a range, and texts and words looked at to find the splitters.
PER_RANGE, SAMPLE, SAMPLED = 1 << 20, 4_000, 400_000
#: Pending stretches of a range: a stretch has about 16 windows of some hundred bytes while they are sorted.
STRETCHES = PER_RANGE // 64
#: Anchors in a byte of text, about.
DENSITY = 1 / 15
#: A document is named by its id and these bits of a checksum, so that rows which share an id stay apart.
TAG = 20


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumn("tag", F.crc32(F.col("text").cast("binary")).bitwiseAND((1 << TAG) - 1))


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """``doc, place, word, whole`` of each stretch; the place holds first window, number of windows and tag."""
    for batch in batches:
        doc, tag = _columns(batch, "doc_id", "tag")
        for s in stretches(*utf8_of(batch.column("text"))):
            yield doc[s.row], (s.start << (TAG + 8)) | (s.windows << TAG) | tag[s.row], s.word, s.whole


def _pending(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """``doc, place, word, bytes`` of each pending stretch; a text's at a time."""
    for batch in batches:
        doc = batch.column("doc_id").to_numpy()
        data, offsets = utf8_of(batch.column("text"))
        lists = batch.column("stretches")
        for i in range(batch.num_rows):
            place, word = (np.asarray(lists[i].values.field(k)) for k in (0, 1))
            first, size = place >> (TAG + 8), ((place >> TAG) & 255) + WIDTH - 1
            ends = np.concatenate([[0], np.cumsum(size)])
            taken = np.repeat(first - ends[:-1], size) + np.arange(ends[-1]) + offsets[i]
            yield np.full(len(place), doc[i]), place, word.view(np.uint64), _binary(data[taken], ends)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _words(every: int):
    """Every so many words of texts' anchors, to find the splitters from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, word, _ in _anchors(batches):
            yield pa.RecordBatch.from_arrays([_signed(word[::every].copy())], ["word"])

    return run


def _splitters(words: DataFrame, ranges: int) -> Splitters:
    return Splitters(words.toArrow().column("word").to_numpy().view(np.uint64), ranges)


def _deal_anchors(split: Splitters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, place, word, whole in _anchors(batches):
            yield pa.RecordBatch.from_arrays([pa.array(split.deal(word, doc)), _signed(word), _signed(whole), _signed(doc), _signed(place)], ["range", "word", "whole", "doc_id", "place"])

    return run


def _sort_anchors(split: Splitters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        word, whole, doc, place = (np.concatenate([b.column(c).to_numpy() for b in got]) for c in ("word", "whole", "doc_id", "place"))
        del got
        word, whole = word.view(np.uint64), whole.view(np.uint64)
        order = multikey_order([word, whole, doc])
        word, whole, doc, place = word[order], whole[order], doc[order], place[order]
        alike, anchor = starts_of([word, whole]), starts_of([word])
        sizes = np.diff(np.append(alike, len(word)))
        had = doc > np.repeat(doc[alike], sizes)
        unlike = np.add.reduceat(np.bincount(alike, minlength=len(word)), anchor) > 1
        several = unlike & (np.minimum.reduceat(doc, anchor) < np.maximum.reduceat(doc, anchor))
        pending = ~had & (np.repeat(several, np.diff(np.append(anchor, len(word)))) | split.across(word))
        out = had | pending
        yield pa.RecordBatch.from_arrays([_signed(doc[out]), _signed(place[out]), _signed(word[out]), pa.array(had[out])], ["doc_id", "place", "word", "had"])

    return run


def _deal_stretches(split: Splitters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, place, word, data in _pending(batches):
            yield pa.RecordBatch.from_arrays([pa.array(split.deal(word, doc)), _signed(word), data, _signed(doc), _signed(place)], ["range", "word", "bytes", "doc_id", "place"])

    return run


def _joined(doc: np.ndarray, start: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows as few places: neighbours of a document become one, of 255 windows at most."""
    order = np.lexsort([start, tag, doc])
    doc, start, tag = doc[order], start[order], tag[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > start[:-1] + 1)
    begin = np.flatnonzero(new)
    base = np.repeat(start[begin], np.diff(np.append(begin, len(doc))))
    begin = np.flatnonzero(new | (((start - base) % 255 == 0) & ~np.concatenate([[False], start[1:] == start[:-1]])))
    n = start[np.append(begin, len(doc))[1:] - 1] - start[begin] + 1
    return doc[begin], (start[begin] << (TAG + 8)) | (n << TAG) | tag[begin]


def _sort_windows(split: Splitters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        word, doc, place = (np.concatenate([b.column(c).to_numpy() for b in got]) for c in ("word", "doc_id", "place"))
        data = np.concatenate([utf8_of(b.column("bytes"))[0] for b in got])
        del got
        n = (place >> TAG) & 255
        each, before = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        inner = np.arange(n.sum()) - before[each]
        sizes = n + WIDTH - 1
        rows = windows(data, (np.cumsum(sizes) - sizes)[each] + inner)
        words, doc = as_words(rows), doc[each]
        order = multikey_order([*words, doc])
        alike = starts_of([w[order] for w in words])
        first = np.repeat(doc[order][alike], np.diff(np.append(alike, len(doc))))
        had = np.empty(len(doc), bool)
        had[order] = doc[order] > first
        start, tag = (place >> (TAG + 8))[each] + inner, (place & ((1 << TAG) - 1))[each]
        docs, places = _joined(doc[had], start[had], tag[had])
        yield pa.RecordBatch.from_arrays([_signed(docs), _signed(places), pa.nulls(len(docs), pa.binary())], ["doc_id", "place", "bytes"])
        across = ~had & split.across(word.view(np.uint64))[each]
        left = np.ascontiguousarray(rows[across])
        yield pa.RecordBatch.from_arrays([_signed(doc[across]), _signed((start[across] << (TAG + 8)) | (1 << TAG) | tag[across]), _binary(left.ravel(), np.arange(len(left) + 1) * WIDTH)], ["doc_id", "place", "bytes"])

    return run


def _ranged(rows: DataFrame, ranges: int, sort, schema: str) -> DataFrame:
    return arrow_map(rows.repartitionById(ranges, F.col("range")), sort, schema)


def repeats(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``docs(doc_id long, text string, ...)`` -> ``doc_id, tag, places``: the windows to be cut out, by document.

    A place holds a first window, a number of windows and the tag. Null texts count as empty; texts shorter than a window
    have none. Rows without an id lose nothing and make nobody else lose anything; of rows that share an id none is the
    earlier one. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    texts = _texts(docs).where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WIDTH))
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -int(-size * DENSITY // PER_RANGE))
    share = min(1.0, SAMPLE / max(n, 1))
    some = texts.sample(share, 1) if share < 1 else texts
    split = _splitters(arrow_map(some, _words(max(1, int(size * DENSITY * share) // SAMPLED)), "word long"), ranges)
    dealt = arrow_map(texts.select("doc_id", "tag", "text"), _deal_anchors(split), "range int, word long, whole long, doc_id long, place long")
    found = ws.keep(_ranged(dealt, split.ranges, _sort_anchors(split), "doc_id long, place long, word long, had boolean"), "stretches")

    tag = F.col("place").bitwiseAND((1 << TAG) - 1).alias("tag")
    open_ = found.where("NOT had")
    many = open_.count()
    some = open_.select("word").sample(min(1.0, SAMPLED / max(many, 1)), 2)
    split = _splitters(some, max(least, -(-many // STRETCHES)))
    wanted = ws.keep(open_.groupBy("doc_id", tag).agg(F.collect_list(F.struct("place", "word")).alias("stretches")), "pending")
    pending = texts.join(wanted, ["doc_id", "tag"]).select("doc_id", "text", "stretches")
    dealt = arrow_map(pending, _deal_stretches(split), "range int, word long, bytes binary, doc_id long, place long")
    sorted_ = ws.keep(_ranged(dealt, split.ranges, _sort_windows(split), "doc_id long, place long, bytes binary"), "windows")
    across = sorted_.where("bytes IS NOT NULL").withColumn("first", F.min("doc_id").over(Window.partitionBy("bytes")))  # a range's first documents only
    had = found.where("had").select("doc_id", "place").union(sorted_.where("bytes IS NULL").select("doc_id", "place")).union(across.where("doc_id > first").select("doc_id", "place"))
    return had.groupBy("doc_id", tag).agg(F.collect_set("place").alias("places"))


CUT = "doc_id long, tag long, spans array<struct<start: long, stop: long>>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8_of(batch.column("text"))
        lists = batch.column("places")
        for i in range(batch.num_rows):
            text, places = data[offsets[i] : offsets[i + 1]], lists[i].values.to_numpy(zero_copy_only=False)
            first, n = places >> (TAG + 8), (places >> TAG) & 255
            depth = np.zeros(len(text) + 1, np.int64)
            np.add.at(depth, first, 1)
            np.add.at(depth, first + n + WIDTH - 1, -1)
            gone = np.concatenate([[False], np.cumsum(depth[:-1]) > 0, [False]])
            edges = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)
            spans = [{"start": a, "stop": b} for a, b in edges.tolist()]
            kept = text[~gone[1:-1]].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, 1), batch.column("tag").slice(i, 1), pa.array([spans], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array([kept], pa.binary())], ["doc_id", "tag", "spans", "kept"]
            )


def without_repeats(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``doc_id, tag, spans, kept`` of the documents that lose something: runs of removed bytes, and what is left.

    ``kept`` is bytes, as a cut may fall inside a character. See ``repeats`` for odd rows.
    """
    places = ws.keep(repeats(docs, ws), "places")
    return arrow_map(_texts(docs).join(places, ["doc_id", "tag"]).select("doc_id", "tag", "text", "places"), _cut, CUT)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark)
    cut = without_repeats(docs, ws)
    lengths = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    cut = ws.keep(cut.select("doc_id", "tag", lengths.alias("cut"), F.size("spans").cast("long").alias("spans"), F.sha2("kept", 256).alias("kept")), "cut")
    cut = cut.groupBy("doc_id", "tag").agg(F.first("cut").alias("cut"), F.first("spans").alias("spans"), F.first("kept").alias("kept"))  # rows repeated whole are alike
    whole = _texts(docs).select("doc_id", "tag", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    zero = F.lit(0).cast("long")
    return whole.join(cut, ["doc_id", "tag"], "left").select(
        "doc_id", "n_bytes", F.coalesce("cut", zero).alias("n_removed"), F.coalesce("spans", zero).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256")
    )


OP12_SQL = """
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), pieces AS (
  SELECT doc_id, n, p * 500 AS base, h[p * 1000 + 1:p * 1000 + 1098] AS h FROM (SELECT *, unnest(range((n + 499) // 500)) AS p FROM t)
), windows AS (
  SELECT doc_id, base + i AS pos, h[2 * i + 1:2 * i + 100] AS w FROM (SELECT *, unnest(range(least(500, n - base - 49))) AS i FROM pieces WHERE n - base >= 50)
), firsts AS (
  SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)
), had AS (
  SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM (SELECT DISTINCT doc_id, pos FROM windows JOIN firsts USING (w) WHERE doc_id > first)
), grouped AS (
  SELECT doc_id, pos, sum(CASE WHEN before IS NULL OR pos > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM had
), spans AS (
  SELECT doc_id, min(pos) AS start, max(pos) + 50 AS stop FROM grouped GROUP BY doc_id, g
), cuts AS (
  SELECT doc_id, start, stop, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS next, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS k FROM spans
), kept AS (
  SELECT doc_id, sum(stop - start) AS n_removed, count(*) AS n_spans,
         string_agg(CASE WHEN k = 1 THEN h[1:2 * start] ELSE '' END || h[2 * stop + 1:2 * coalesce(next, n)], '' ORDER BY start) AS left_over
  FROM cuts JOIN t USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""
