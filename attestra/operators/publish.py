"""Curated notes, their chunks, and the generations of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import chunk_id, sha256
from ..functions.text import plain_title, safe_inline

# The chunker's version and sizes in characters, and the order of statuses and sensitivities.
CHUNKER, TARGET, OVERLAP, HARD_LIMIT = "markdown-v1", 900, 120, 1600
STATUS_ORDER = ("VERIFIED", "USER_ASSERTED", "OPINION")
SENSITIVITY_ORDER = ("PUBLIC", "RESTRICTED", "PRIVATE")
PUBLISHABLE = STATUS_ORDER


def rank_in(value: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(value == v, F.lit(i)) for i, v in enumerate(order)))


def publishable_claims(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("deleted_at").isNull() & F.col("status").isin(*PUBLISHABLE))


def claim_sentence(claim_id: Column, subject: Column, predicate: Column, value: Column) -> Column:
    return F.concat(F.lit("- "), safe_inline(subject), F.lit(" — "), safe_inline(predicate), F.lit(": "), safe_inline(value), F.lit(" [^"), claim_id, F.lit("]"))


def curation_groups(claims: DataFrame) -> DataFrame:
    """Per note and type of claim: heading, order of first appearance, number of claims."""
    heading = F.initcap(F.lower(F.replace("claim_type", F.lit("_"), F.lit(" "))))
    return claims.groupBy("note_id", "claim_type").agg(F.min("seq").alias("first_seq"), F.count("*").alias("claims")).select("note_id", heading.alias("heading"), "first_seq", "claims")


def curated_notes(claims: DataFrame) -> DataFrame:
    """A note's Markdown and the digest of its content: ``note_id, title, body, claims, sensitivity, content_hash``.

    Sections go by first appearance of their type, sentences by ``seq``. A note is one row and holds its own claims only.
    """
    heading = F.initcap(F.lower(F.replace("claim_type", F.lit("_"), F.lit(" "))))
    sentence = claim_sentence(F.col("claim_id"), F.col("subject"), F.col("predicate"), F.col("value"))
    parts = claims.groupBy("note_id", "claim_type").agg(
        F.min("seq").alias("first_seq"), F.first(heading).alias("heading"), F.array_sort(F.collect_list(F.struct("seq", sentence.alias("line"), "claim_id"))).alias("lines"),
        F.max(rank_in(F.col("sensitivity"), SENSITIVITY_ORDER)).alias("strictest"), F.min(F.struct("seq", "subject")).alias("opening"),
    )
    section = F.concat(F.lit("## "), F.col("heading"), F.lit("\n\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    notes = parts.withColumn("section", section).groupBy("note_id").agg(
        F.array_sort(F.collect_list(F.struct("first_seq", "section"))).alias("sections"), F.array_sort(F.flatten(F.collect_list(F.transform("lines", lambda x: x["claim_id"])))).alias("claim_ids"),
        F.max("strictest").alias("strictest"), F.min("opening").alias("opening"),
    )
    title = plain_title(F.col("opening.subject"))
    body = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.array_join(F.transform("sections", lambda x: x["section"]), "\n\n"), F.lit("\n"))
    notes = notes.withColumn("title", title).withColumn("body", body).withColumn("sensitivity", F.element_at(F.array(*(F.lit(x) for x in SENSITIVITY_ORDER)), (F.col("strictest") + 1).cast("int")))
    return notes.select("note_id", "title", "body", F.size("claim_ids").cast("long").alias("claims"), "sensitivity", content_hash(F.col("body"), F.col("claim_ids"), F.col("title")).alias("content_hash"))


def content_hash(body: Column, claim_ids: Column, title: Column) -> Column:
    return sha256(F.to_json(F.struct(body.alias("body"), claim_ids.alias("claim_ids"), title.alias("title"))))


def select_generation(generations: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each collection the generation of the wanted manifest if one is staging or active, else the next number.

    ``generations(collection, number, manifest_hash, status)``, ``wanted(collection, manifest_hash)``.
    """
    usable = generations.where(F.col("status").isin("STAGING", "ACTIVE")).groupBy("collection", "manifest_hash").agg(F.max("number").alias("found"))
    last = generations.groupBy("collection").agg(F.max("number").alias("last"))
    rows = wanted.join(usable, ["collection", "manifest_hash"], "left").join(last, "collection", "left")
    return rows.select("collection", F.coalesce("found", F.coalesce("last", F.lit(0)) + 1).alias("number"), F.col("found").isNull().alias("created"))


def overlap_tail(lines: Column, budget: int) -> Column:
    """The last lines whose cost, a line feed each included, stays within the budget."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(True).alias("open"))

    def step(acc: Column, line: Column) -> Column:
        cost = F.length(line) + 1
        take = acc["open"] & (acc["used"] + cost <= budget)
        return F.struct(
            F.when(take, F.concat(F.array(line), acc["kept"])).otherwise(acc["kept"]).alias("kept"),
            F.when(take, acc["used"] + cost).otherwise(acc["used"]).alias("used"),
            take.alias("open"),
        )

    return F.aggregate(F.reverse(lines), start, step, lambda acc: acc["kept"])


def packed_lines(lines: Column, prefix: Column, target: int = TARGET, overlap: int = OVERLAP, hard: int = HARD_LIMIT) -> Column:
    """Lines of one section as chunks of lines, by a fold inside the row: no shuffle, no window.

    A chunk closes when the next line would pass the target; the next one starts with the tail of the last. A chunk
    that passes the hard limit with its tail closes before its last line. A line that with its line feed passes the hard limit
    where it opens a chunk, or without it anywhere, raises an error.
    """
    cost = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + F.length(x) + 1)
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("cur"))

    def step(acc: Column, line: Column) -> Column:
        full = (F.size(acc["cur"]) > 0) & (prefix + cost(acc["cur"]) + F.length(line) + 1 > target)
        done = F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
        base = F.when(full, overlap_tail(acc["cur"], overlap)).otherwise(acc["cur"])
        over = (F.size(base) > 0) & (prefix + cost(base) + F.length(line) + 1 > hard)
        done = F.when(over, F.concat(done, F.array(base))).otherwise(done)
        cur = F.when(over, F.array(line)).otherwise(F.concat(base, F.array(line)))
        alone = (F.size(base) == 0) & (prefix + F.length(line) + 1 > hard)
        checked = F.when(alone | (prefix + F.length(line) > hard), F.raise_error(F.lit("a line exceeds the hard limit")).cast("array<string>")).otherwise(cur)
        return F.struct(done.alias("done"), checked.alias("cur"))

    return F.aggregate(lines, start, step, lambda acc: F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]))


def section_head() -> Column:
    return F.concat(F.lit("# "), F.col("title"), F.lit("\n## "), F.col("heading"))


def sliced(lines: Column, size: Column) -> Column:
    """Each line as slices of at most ``size`` code points, in order."""
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / size).cast("int")), lambda i: F.substr(x, i * size + 1, size))
    return F.flatten(F.transform(lines, lambda x: F.when(F.length(x) > size, cut(x)).otherwise(F.array(x))))


def fitting_lines(lines: Column) -> Column:
    """Lines of ``sections(title, heading, ...)``, those that no chunk could hold as slices of what one holds."""
    room = F.greatest(F.lit(1), F.lit(HARD_LIMIT - 1) - F.coalesce(F.length(section_head()) + 2, F.lit(0)))
    return sliced(lines, room)


def chunks(sections: DataFrame) -> DataFrame:
    """``sections(note_id, version_id, section, title, heading, lines)`` -> a row a chunk with its text and id.

    Ordinals start from 0 and run on over the sections of a version, in the order of ``section``.
    """
    rows = sections.withColumn("head", section_head()).withColumn("batches", packed_lines(F.col("lines"), F.length("head") + 2))
    rows = rows.select("note_id", "version_id", "section", "heading", "head", F.posexplode("batches").alias("place", "batch"))
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("note_id", "version_id").orderBy("section", "place")) - 1)
    text = F.concat("head", F.lit("\n\n"), F.array_join("batch", "\n"))
    rows = rows.select("note_id", "version_id", "ordinal", F.size("batch").alias("lines"), text.alias("text"))
    return rows.withColumn("chunk_id", chunk_id(F.col("version_id"), CHUNKER, F.col("ordinal"), F.col("text")))


def chunk_metadata(members: DataFrame) -> DataFrame:
    """Per chunk: worst status, strictest sensitivity, and the window in which all its claims hold.

    Claims whose windows don't overlap raise an error when the result is read.
    """
    out = members.groupBy("chunk_id").agg(
        F.max_by("status", rank_in(F.col("status"), STATUS_ORDER)).alias("quality_status"),
        F.max_by("sensitivity", rank_in(F.col("sensitivity"), SENSITIVITY_ORDER)).alias("sensitivity"),
        F.max("valid_from").alias("valid_from"), F.min("valid_to").alias("valid_to"), F.min("freshness_at").alias("freshness_at"), F.count("*").alias("claims"),
    )
    empty = F.col("valid_from") > F.col("valid_to")
    return out.withColumn("valid_from", F.when(empty, F.raise_error(F.lit("a chunk's claims have no common window")).cast("bigint")).otherwise(F.col("valid_from")))


def coverage_gaps(claims: DataFrame, members: DataFrame) -> DataFrame:
    """Claims in no chunk, and chunk members that aren't claims."""
    missing = claims.select("claim_id").join(members.select("claim_id"), "claim_id", "left_anti").select("claim_id", F.lit("missing").alias("gap"))
    unknown = members.select("claim_id").distinct().join(claims.select("claim_id"), "claim_id", "left_anti").select("claim_id", F.lit("unknown").alias("gap"))
    return missing.unionByName(unknown)


def probe_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Index rows against what should be there: ``chunk_id, drift``, missing, unexpected or changed."""
    e = expected.select("chunk_id", F.struct("version_id", "content_hash").alias("e"))
    a = actual.select("chunk_id", F.struct("version_id", "content_hash").alias("a"))
    drift = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("e") != F.col("a"), "changed")
    return e.join(a, "chunk_id", "full_outer").select("chunk_id", drift.alias("drift")).where("drift is not null")


def reconcile(notes: DataFrame, drift_by_note: DataFrame, repair: bool) -> DataFrame:
    """Per note: BLOCKED when its vault check failed, HEALTHY without drift, else REPAIRABLE with what was done."""
    rows = notes.join(drift_by_note, "note_id", "left").withColumn("drift", F.coalesce("drift", F.lit(0)))
    finding = F.when(~F.col("vault_ok"), "BLOCKED").when(F.col("drift") == 0, "HEALTHY").otherwise("REPAIRABLE")
    reason = F.when(~F.col("vault_ok"), "vault_verification_failed").when(F.col("drift") > 0, "index_repaired" if repair else "index_drift")
    return rows.select("note_id", "drift", finding.alias("finding"), reason.alias("reason"))


def reconcile_again(notes: DataFrame, expected: DataFrame, index: DataFrame, repaired: DataFrame, note_of: Column) -> DataFrame:
    """Findings after a repair, which is looked at again: ``note_id, finding, reason, drift, left``.

    ``notes(note_id, vault_ok, probed)``; ``index`` is what was found, ``repaired`` what is found after the repair, both as
    ``expected(chunk_id, version_id, content_hash)``. ``note_of`` gives a chunk's note. BLOCKED when the vault or the index couldn't
    be read, or when something is still not as expected; HEALTHY when nothing was wrong; else REPAIRABLE and repaired.
    """
    c = F.col
    count = lambda now, name: probe_drift(expected, now).groupBy(note_of.alias("note_id")).agg(F.count("*").alias(name))
    rows = notes.join(count(index, "drift"), "note_id", "left").join(count(repaired, "left"), "note_id", "left")
    rows = rows.withColumns({x: F.coalesce(x, F.lit(0)) for x in ("drift", "left")})
    reason = (
        F.when(~c("vault_ok"), "vault_verification_failed").when(~c("probed"), "index_verification_failed").when(c("drift") == 0, "publication_healthy")
        .when(c("left") > 0, "index_repair_failed").otherwise("index_repaired")
    )
    finding = F.when(reason == "publication_healthy", "HEALTHY").when(reason == "index_repaired", "REPAIRABLE").otherwise("BLOCKED")
    return rows.select("note_id", finding.alias("finding"), reason.alias("reason"), "drift", "left")


def upsert(index: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The index with ``rows`` in place of those of the same key."""
    return index.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete(index: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return index.join(ids.select(key), key, "left_anti")


def generation_switch(notes: DataFrame, jobs: DataFrame, source: int, target: int, source_status: str, target_status: str) -> DataFrame:
    """Moves all live notes of a generation to another, or none: ``note_id, ready, switched, generation``.

    A note is ready when its jobs in both generations have the wanted statuses.
    """
    live = notes.where(F.col("deleted_at").isNull() & (F.col("generation") == source))
    job = lambda g, s, name: jobs.where((F.col("generation") == g) & (F.col("status") == s)).select("note_id", F.lit(True).alias(name)).distinct()
    rows = live.join(job(source, source_status, "from_ok"), "note_id", "left").join(job(target, target_status, "to_ok"), "note_id", "left")
    rows = rows.withColumn("ready", F.coalesce(F.col("from_ok") & F.col("to_ok"), F.lit(False)))
    gate = rows.agg(F.coalesce(F.bool_and("ready"), F.lit(False)).alias("all_ready"))  # one row
    return rows.crossJoin(gate).select("note_id", "ready", F.col("all_ready").alias("switched"), F.when(F.col("all_ready"), target).otherwise(source).alias("generation"))


def snapshots_to_add(stored: DataFrame, contents: DataFrame) -> DataFrame:
    """Write-once content: what isn't stored yet, once a hash, with the folder of its first two digits."""
    new = contents.withColumn("content_hash", sha256(F.col("text"))).groupBy("content_hash").agg(F.min("text").alias("text"))
    return new.join(stored.select("content_hash"), "content_hash", "left_anti").withColumn("folder", F.substring("content_hash", 1, 2))
