"""Manifests, change plans and structural differences of versioned documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json
from ..streaming.run import kept


def _array_digests(scope: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, n, names, kinds = None, None, 0, [], []
        done: list[tuple] = []
        for batch in batches:
            names, kinds = batch.schema.names[:scope], batch.schema.types[:scope]
            keys = zip(*(batch.column(i).to_pylist() for i in range(scope)))
            for key, entry in zip(keys, batch.column("entry").to_pylist(), strict=True):
                if key != now:
                    if digest is not None:
                        done.append((*now, n, digest))
                    now, digest, n = key, hashlib.sha256(b"["), 0
                digest.update((b"," if n else b"") + entry.encode())
                n += 1
        if digest is not None:
            done.append((*now, n, digest))
            columns = [pa.array([d[i] for d in done], kind) for i, kind in enumerate([*kinds, pa.int64()])]
            for *_, d in done:
                d.update(b"]")
            yield pa.RecordBatch.from_arrays([*columns, pa.array([d[-1].hexdigest() for d in done])], [*names, "entries", "manifest_hash"])

    return run


def manifest_digest(entries: DataFrame, scope: list[str], fields: list[str], order: str) -> DataFrame:
    """One digest a scope: the SHA-256 of the JSON array of its entries in the order of their keys.

    A digest of one text is serial by nature. Entries pass through a task as a sorted stream, which keeps a digest under way
    and no entries, so a scope of any size costs its time alone; ``manifest_tree`` is the form that many tasks make together.
    """
    rows = entries.withColumn("entry", F.struct(*fields))
    rows = rows.select(*scope, order, canonical_json(rows, "entry").alias("entry")).repartition(*scope).sortWithinPartitions(*scope, order, "entry")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*scope).schema.fields)
    return rows.mapInArrow(_array_digests(len(scope)), f"{kinds}, entries long, manifest_hash string")


def manifest_tree(entries: DataFrame, key: str, entry_hash: Column, digits: int = 4) -> DataFrame:
    """A digest tree: entries meet by the first ``digits`` hex digits of their key, then those digests in one.

    With 4 digits a billion entries make leaves of 15 thousand; more digits keep larger sets as flat.
    """
    leaves = entries.groupBy(F.substring(key, 1, digits).alias("prefix")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry_hash)), ","), 256).alias("digest"), F.count("*").alias("entries"))
    inner = leaves.groupBy(F.substring("prefix", 1, max(1, digits // 2)).alias("prefix")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ","), 256).alias("digest"), F.sum("entries").alias("entries"))
    return inner.agg(F.sum("entries").alias("entries"), F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ","), 256).alias("tree_hash"))


def unique_match(left: DataFrame, right: DataFrame, key: str, keep_left: list[str], keep_right: list[str]) -> DataFrame:
    """Pairs whose key isn't null and occurs once on either side. The counts are map-side aggregates, not windows."""
    once = lambda df: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in df.columns if c != key)).where("n = 1").drop("n")
    return once(left.select(key, *keep_left)).join(once(right.select(key, *keep_right)), key)


def plan_changes(manifest: DataFrame, known: DataFrame) -> DataFrame:
    """What a scan changes: ``action, path_key, source_id, preserve_quarantine, matched_by, base_version``.

    ``manifest(path_key, file_key, content_hash, error_category)``, ``known(source_id, path_key, file_key, current_hash,
    latest_hash, latest_status, eligible, current_version, latest_version)``; ``verify.plan_problems`` tells whether they may be planned. Paths that both have are UPDATED (an error, another hash, or an earlier
    parse failure) or UNCHANGED. What is left is matched by unique file key, then by unique content hash, as MOVED. The
    rest is CREATED, or DELETED where eligible. All but the new carry the version that the change is made from: the current
    one, for moves the latest where there is no current one.
    """
    hash_known = F.coalesce("latest_hash", "current_hash")
    m = manifest.select("path_key", F.col("file_key").alias("m_file"), F.col("content_hash").alias("m_hash"), "error_category")
    k = known.select("path_key", "source_id", F.col("file_key").alias("k_file"), hash_known.alias("k_hash"), "latest_status", "eligible", F.col("current_version").alias("base_version"), F.coalesce("current_version", "latest_version").alias("move_version"))
    sides = m.withColumn("in_m", F.lit(True)).join(k.withColumn("in_k", F.lit(True)), "path_key", "full_outer")
    sides = kept(sides, "sides")  # both tables are read once
    both = sides.where("in_m and in_k")
    changed = F.col("error_category").isNotNull() | F.coalesce(F.col("m_hash") != F.col("k_hash"), F.lit(True)) | F.coalesce(F.col("latest_status") == "PARSE_FAILED", F.lit(False))
    same = both.select(
        F.when(changed, "UPDATED").otherwise("UNCHANGED").alias("action"), "path_key", "source_id",
        (~changed & F.coalesce(F.col("latest_status") == "QUARANTINED", F.lit(False))).alias("preserve_quarantine"), F.lit("path").alias("matched_by"), "base_version",
    )
    new = sides.where("in_k is null").select(F.col("path_key").alias("new_path"), "m_file", "m_hash")
    old = sides.where("in_m is null").select(F.col("path_key").alias("old_path"), "source_id", "k_file", "k_hash", "eligible", "base_version", "move_version")
    moved = []
    for how, left, right in (("file", "m_file", "k_file"), ("hash", "m_hash", "k_hash")):
        pairs = unique_match(new.withColumnRenamed(left, "key"), old.withColumnRenamed(right, "key"), "key", ["new_path"], ["old_path", "source_id", "move_version"])
        pairs = kept(pairs, "pairs")
        moved.append(pairs.select(F.lit("MOVED").alias("action"), F.col("new_path").alias("path_key"), "source_id", F.lit(False).alias("preserve_quarantine"), F.lit(how).alias("matched_by"), F.col("move_version").alias("base_version")))
        new = new.join(pairs.select("new_path"), "new_path", "left_anti")
        old = old.join(pairs.select("old_path"), "old_path", "left_anti")
    created = new.select(F.lit("CREATED").alias("action"), F.col("new_path").alias("path_key"), F.lit(None).cast("long").alias("source_id"), F.lit(False).alias("preserve_quarantine"), F.lit(None).cast("string").alias("matched_by"), F.lit(None).cast("string").alias("base_version"))
    deleted = old.where("eligible").select(F.lit("DELETED").alias("action"), F.col("old_path").alias("path_key"), "source_id", F.lit(False).alias("preserve_quarantine"), F.lit(None).cast("string").alias("matched_by"), "base_version")
    return same.unionByName(moved[0]).unionByName(moved[1]).unionByName(created).unionByName(deleted)


def structural_diff(before: DataFrame, after: DataFrame, document: str = "doc_id") -> DataFrame:
    """Per document: ``kind`` unchanged, moved, modified, removed or added, with the anchors and hashes of both sides.

    Both sides have ``document, anchor, text_hash``, an anchor once a document. Equal anchor and hash: unchanged. Of the
    rest, a hash that is left once on either side, at different anchors, moved. Then equal anchors are modified.
    """
    b = before.select(document, F.col("anchor"), F.col("text_hash").alias("old_hash"))
    a = after.select(document, F.col("anchor"), F.col("text_hash").alias("new_hash"))
    at = [document, "anchor"]
    all_ = kept(b.join(a, at, "full_outer"), "sides")
    unchanged = all_.where("old_hash = new_hash").select(document, F.lit("unchanged").alias("kind"), F.col("anchor").alias("from_anchor"), F.col("anchor").alias("to_anchor"), "old_hash", "new_hash")
    rest = all_.where("not (old_hash <=> new_hash)")
    side = lambda h: rest.where(F.col(h).isNotNull()).groupBy(document, F.col(h).alias("hash")).agg(F.count("*").alias("n"), F.min("anchor").alias(f"{h}_anchor")).where("n = 1").drop("n")
    moves = side("old_hash").join(side("new_hash"), [document, "hash"]).where("old_hash_anchor <> new_hash_anchor")
    moves = kept(moves, "moves")
    moved = moves.select(document, F.lit("moved").alias("kind"), F.col("old_hash_anchor").alias("from_anchor"), F.col("new_hash_anchor").alias("to_anchor"), F.col("hash").alias("old_hash"), F.col("hash").alias("new_hash"))
    olds = rest.where("old_hash is not null").select(*at, "old_hash").join(moves.select(document, F.col("old_hash_anchor").alias("anchor")), at, "left_anti")
    news = rest.where("new_hash is not null").select(*at, "new_hash").join(moves.select(document, F.col("new_hash_anchor").alias("anchor")), at, "left_anti")
    left = olds.join(news, at, "full_outer")
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").otherwise("modified")
    others = left.select(document, kind.alias("kind"), F.when(F.col("old_hash").isNotNull(), F.col("anchor")).alias("from_anchor"), F.when(F.col("new_hash").isNotNull(), F.col("anchor")).alias("to_anchor"), "old_hash", "new_hash")
    return unchanged.unionByName(moved).unionByName(others)


def diff_counts(diff: DataFrame, document: str = "doc_id") -> DataFrame:
    kinds = ("unchanged", "moved", "modified", "removed", "added")
    return diff.groupBy(document).agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds))


def line_blocks(docs: DataFrame) -> DataFrame:
    """A block a line: ``doc_id, ordinal, anchor, text_hash, character_count``."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text")).where("text <> ''")
    return lines.select("doc_id", "ordinal", F.concat(F.lit("paragraph:"), (F.col("ordinal") + 1).cast("string")).alias("anchor"), F.sha2("text", 256).alias("text_hash"), F.length("text").cast("long").alias("character_count"))


def known_sources(locations: DataFrame, sources: DataFrame, versions: DataFrame) -> DataFrame:
    """Live locations with their source's current and latest version: what a plan compares a scan with.

    ``locations(source_id, path_key, deleted_at)``, ``sources(source_id, current_version_id, deleted_at)``,
    ``versions(version_id, source_id, version_number, content_hash, status)``.
    """
    live = locations.where("deleted_at is null").drop("deleted_at").join(sources.where("deleted_at is null").drop("deleted_at"), "source_id")
    current = versions.select(F.col("version_id").alias("current_version_id"), F.col("content_hash").alias("current_hash"))
    last = versions.groupBy("source_id").agg(F.max(F.struct("version_number", "content_hash", "status")).alias("v"))
    rows = live.join(current, "current_version_id", "left").join(last, "source_id", "left")
    return rows.select("source_id", "path_key", "current_hash", F.col("v.content_hash").alias("latest_hash"), F.col("v.status").alias("latest_status"), F.col("v.version_number").alias("latest_number"))
