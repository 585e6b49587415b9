"""Near-duplicate groups: SetSketch registers, banded, estimated jointly by likelihood, then verified on full sets.

1. One pass over the texts gives each document its shingle count, a digest of the shingle set and its registers.
2. Equal sets collapse to a class, represented by its smallest id; only representatives go on.
3. Bands of registers are keys. Each member of a bucket is paired with the bucket's smallest id alone, so a bucket of
   any size makes as many pairs as it has members. The likelihood estimate drops hopeless pairs; the rest are verified
   on full sets, and the links' components are found.
4. Pairs inside a component need no further look. Buckets that still hold several components are compared in blocks of
   bounded size, again by estimate and then on full sets; a block returns a spanning forest of its links, never pairs.
   Together 3 and 4 look at every pair that shares a bucket, so nothing is capped.

At a similarity of exactly 0.8, 40 bands of 5 registers miss a pair with probability ``(1 - 0.8**5)**40`` = 1.2e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .setsketch import SetSketch, joint_estimate
from .shared import Workspace, small_batches, utf8
from .words import jaccard_parts, shingle_set

#: Shingles that a block of a bucket holds on average; a block has at most a few MB of them.
BLOCK_SHINGLES = 1 << 20
#: Rows that a block holds on average at most; it compares all pairs of its rows.
BLOCK_ROWS = 1024
#: Standard deviations by which the estimate may fall short of the threshold before a pair is dropped unverified.
SLACK = 5.0


def _linked(shared: int, union: int, percent: int) -> bool:
    return union > 0 and 100 * shared >= percent * union


def _estimate_floor(percent: int, m: int) -> float:
    j = percent / 100
    return j - SLACK * (j * (1 - j) / m) ** 0.5


def _signatures(size: int, sketch: SetSketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x, size) for x in utf8(batch.column("text"))]
            registers = sketch.registers(sets)
            keys = sketch.band_keys(registers)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([r.tobytes() for r in registers], pa.binary()),
                    pa.array(list(keys), pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "registers", "bands"],
            )

    return run


def _estimated(percent: int, sketch: SetSketch):
    floor = _estimate_floor(percent, sketch.m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, sketch.m) for c in ("ra", "rb"))
            j = joint_estimate(batch.column("na"), batch.column("nb"), (a > b).sum(1), (a < b).sum(1), sketch.m)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(j >= floor))

    return run


def _verified(size: int, percent: int):
    """Rows come sorted by (a, salt, role): a leader, then its members; one set is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leader = None, np.empty(0, np.uint64)
        for batch in batches:
            a, salt, role, doc = (batch.column(c).to_pylist() for c in ("a", "salt", "role", "doc_id"))
            out: list[tuple[int, int]] = []
            for i, text in enumerate(utf8(batch.column("text"))):
                s = shingle_set(text, size)
                if role[i] == 0:
                    at, leader = (a[i], salt[i]), s
                elif at == (a[i], salt[i]) and _linked(*jaccard_parts(leader, s), percent):
                    out.append((a[i], doc[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


class _Block:
    """Two blocks of a bucket (or one with itself): links between different components, as a spanning forest."""

    def __init__(self, size: int, percent: int, sketch: SetSketch):
        self.size, self.percent, self.sketch, self.rows = size, percent, sketch, []

    def links(self, band: int, same: bool) -> list[tuple[int, int]]:
        rows = self.rows
        doc = np.array([r["doc_id"] for r in rows])
        comp, n, side = (np.array([r[k] for r in rows]) for k in ("component", "n_shingles", "block"))
        regs = np.frombuffer(b"".join(r["registers"] for r in rows), np.uint16).reshape(-1, self.sketch.m)
        keys = self.sketch.band_keys(regs)
        sets = [shingle_set(r["text"].encode() if r["text"] else b"", self.size) for r in rows]
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        alone = values[counts == 1]
        common = np.array([len(s) - np.count_nonzero(np.isin(s, alone, assume_unique=True)) for s in sets])
        floor, found = _estimate_floor(self.percent, self.sketch.m), []
        for i in range(len(rows) - 1):
            j = np.arange(i + 1, len(rows))
            most = np.minimum(common[i], common[j])  # shingles that no other row has can't be shared
            keep = (comp[j] != comp[i]) & (100 * most >= self.percent * (n[i] + n[j] - most))
            if not same:
                keep &= side[j] != side[i]
            j = j[keep]
            j = j[~(keys[j, :band] == keys[i, :band]).any(1)] if band else j  # taken where they first share a band
            if len(j):
                e = joint_estimate(n[i], n[j], (regs[i] > regs[j]).sum(1), (regs[i] < regs[j]).sum(1), self.sketch.m)
                found += [(-x, i, int(k)) for x, k in zip(e, j, strict=True) if x >= floor]
        root = {int(c): int(c) for c in comp}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for _, i, j in sorted(found):
            x, y = find(int(comp[i])), find(int(comp[j]))
            if x != y and _linked(*jaccard_parts(sets[i], sets[j]), self.percent):
                root[max(x, y)] = min(x, y)
                out.append((int(doc[i]), int(doc[j])))
        return out


def _blocks(size: int, percent: int, sketch: SetSketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, _Block(size, percent, sketch)

        def flush() -> pa.RecordBatch:
            out = block.links(at[3], at[1] == at[2]) if len(block.rows) > 1 else []
            block.rows = []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["key"], row["lo"], row["hi"], row["band"])
                if at is not None and key != at:
                    yield flush()
                at = key
                block.rows.append(row)
        if at is not None:
            yield flush()

    return run


def near_duplicates(docs: DataFrame, ws: Workspace, size: int = 5, percent: int = 80, registers: int = 200, band: int = 5) -> DataFrame:
    """``docs(doc_id long, text string, ...)`` -> ``doc_id, n_shingles, component_id, kept``, a row for each input row.

    Two documents are linked when 100 * |intersection| >= ``percent`` * |union| for their sets of distinct shingles of
    ``size`` words. ``component_id`` is the smallest id reachable by links, itself included. Null and wordless texts
    have no shingles and are linked with nothing. Rows with a null id are linked with nothing either: their component
    is null and they are kept. Rows that share an id are one node; each keeps its own row. Other columns are ignored.
    """
    spark = docs.sparkSession
    sketch = SetSketch(registers, band)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(spark):
        signed = ws.keep(texts.mapInArrow(_signatures(size, sketch), "doc_id long, n_shingles long, digest binary, registers binary, bands array<long>"), "signatures")
        linkable = signed.where("n_shingles > 0 and doc_id is not null")
        classes = ws.keep(linkable.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
        copies = linkable.select("doc_id", "digest").join(classes, "digest").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        reps = linkable.join(classes, (linkable["digest"] == classes["digest"]) & (linkable["doc_id"] == classes["rep"]), "left_semi")
        members = reps.select("doc_id", "n_shingles", F.posexplode("bands").alias("band", "key"))
        buckets = members.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a <> z").select("key", "a")
        members = ws.keep(members.join(buckets, "key").select("key", "band", "a", "doc_id", "n_shingles"), "members")
        wanted = members.select("doc_id").distinct()
        sets = ws.keep(reps.select("doc_id", "n_shingles", "registers").join(wanted, "doc_id", "left_semi").join(texts, "doc_id").dropDuplicates(["doc_id"]), "candidates")

        small = sets.select("doc_id", "n_shingles", "registers")
        left, right = (small.select(*(F.col(c).alias(f"{c[0]}{k}") for c in ("n_shingles", "registers")), F.col("doc_id").alias(k)) for k in "ab")
        pairs = members.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
        pairs = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        pairs = ws.keep(pairs.mapInArrow(_estimated(percent, sketch), "a long, b long"), "pairs")
        links = ws.keep(_verify(pairs, sets.select("doc_id", "text"), size, percent), "links")
        first = components(links.union(copies), ws)

        named = members.select("key", "band", "doc_id", "n_shingles").join(first.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
        named = named.withColumn("component", F.coalesce("component", "doc_id"))
        mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.sum("n_shingles").alias("total"), F.count("*").alias("rows")).where("x <> y")
        mixed = mixed.select("key", F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("int").alias("blocks"))
        open_ = named.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        open_ = open_.select("key", "band", "doc_id", "component", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        work = open_.join(sets, "doc_id").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "band")
        more = ws.keep(work.mapInArrow(_blocks(size, percent, sketch), "a long, b long"), "more-links")
        if more.limit(1).count():  # the components found first stand for all links found first
            first = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), ws)
    named = signed.select("doc_id", "n_shingles").join(first, signed["doc_id"] == first["node"], "left")
    component = F.coalesce("component", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, ws: Workspace, **how) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one of the smallest id, with all their columns.

    Rows with a null id stay. Where an id is there more than once, rows are told apart by a number of their own, and the
    one of smallest id and number stays.
    """
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if not repeated:
        dropped = ws.keep(near_duplicates(docs, ws, **how).where(~F.col("kept")).select("doc_id"), "dropped")
        return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    rows = ws.keep(docs.select(F.monotonically_increasing_id().alias("place"), whole), "numbered")
    named = rows.select(F.when(F.col("doc.doc_id").isNotNull(), F.col("place")).alias("doc_id"), F.col("doc.text").alias("text"))
    found = near_duplicates(named, ws, **how).where("doc_id is not null").select(F.col("doc_id").alias("place"), "component_id")
    found = ws.keep(found, "found")
    kept = rows.select("place", F.col("doc.doc_id").alias("id")).join(found, "place").groupBy("component_id").agg(F.min(F.struct("id", "place")).alias("k"))
    dropped = ws.keep(found.join(kept.select(F.col("k.place").alias("place")), "place", "left_anti").select("place"), "dropped")
    return rows.join(dropped, "place", "left_anti").select("doc.*")


def _verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int, each: int = 256) -> DataFrame:
    """Keeps the pairs whose full sets are linked. A leader's members are salted into groups of about ``each``."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / each).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("doc_id"))
    leaders = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("doc_id"))
    rows = members.union(leaders).join(texts, "doc_id")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(_verified(size, percent), "a long, b long")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark), size=2)


#: Exact on all rows: linked sets share one of the rarest fifth of their shingles, so only such pairs are counted out.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) = 1 THEN a ELSE list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), f AS (SELECT sh, count(*) AS df FROM s GROUP BY 1 HAVING count(*) > 1),
p AS (SELECT doc_id, sh, n, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(df, 1), sh) AS k FROM s JOIN n USING (doc_id) LEFT JOIN f USING (sh)),
c AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny FROM p a JOIN p b ON a.sh = b.sh AND a.doc_id < b.doc_id
  WHERE 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) AND a.k <= a.n - (4 * a.n + 4) // 5 + 1 AND b.k <= b.n - (4 * b.n + 4) // 5 + 1),
l AS (SELECT x, y FROM c JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y AND b.sh = a.sh GROUP BY x, y, nx, ny HAVING 100 * count(*) >= 80 * (nx + ny - count(*))),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(root) AS component_id, min(root) = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n
"""
