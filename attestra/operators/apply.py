"""Applying plans: what becomes of items, versions, drafts, publications and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The stages of a publication and what each leaves behind when it is done.
SAGA = (("staged", "VAULT_STAGED"), ("indexed", "INDEXING"), ("verified", "INDEX_VERIFIED"), ("published", "VAULT_PUBLISHED"), ("activated", "COMPLETED"))
# Parts of names that metadata must not have, and what published files must not hold.
SENSITIVE_PARTS = ("api_key", "apikey", "authorization", "password", "secret", "token")
CONTENT_RULES = (
    ("api token", r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_-]{16,}"),
    ("repository token", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    ("bearer", r"Bearer[ \t]+[A-Za-z0-9._-]{16,}"),
    ("private key", r"BEGIN[ \t]+(?:RSA[ \t]+)?PRIVATE[ \t]+KEY"),
    ("windows user path", r"[A-Za-z]:[\\/]+Users[\\/]+[^\\/\s]+"),
    ("unix user path", r"/(?:home|Users)/[^/\s]+"),
)


def item_outcomes(plan: DataFrame, versions: DataFrame) -> DataFrame:
    """Each planned item's outcome: ``plan(action, source_id, content_hash, parse_error, unsafe, preserve_quarantine)``.

    UPDATED content that the source already has as a READY version reactivates it; other new content is a new version,
    PARSE_FAILED or QUARANTINED where it must be. Moves make no version, unchanged rows are skipped.
    """
    ready = versions.where("status = 'READY'").groupBy("source_id", "content_hash").agg(F.max("version_number").alias("had"))
    rows = plan.join(ready, ["source_id", "content_hash"], "left")
    c = F.col
    new = F.when(c("parse_error"), "PARSE_FAILED").when(c("unsafe"), "QUARANTINED").otherwise("READY")
    outcome = (
        F.when(c("action") == "DELETED", "TOMBSTONED").when(c("action") == "MOVED", "RELOCATED")
        .when(c("action") == "UNCHANGED", F.when(c("preserve_quarantine"), "QUARANTINE_KEPT").otherwise("SKIPPED"))
        .when((c("action") == "UPDATED") & c("had").isNotNull(), "REACTIVATED").otherwise(new)
    )
    return rows.select("action", "source_id", "content_hash", outcome.alias("outcome"), F.when(outcome == "REACTIVATED", c("had")).alias("version_number"))


def deduplicated_drafts(drafts: DataFrame, active: DataFrame) -> DataFrame:
    """Of drafts with one fingerprint the last one's content at the first one's place; live claims are reused."""
    merged = drafts.groupBy("run_id", "fingerprint").agg(F.min("position").alias("position"), F.max(F.struct("position", "draft_id")).alias("last"), F.count("*").alias("drafts"))
    rows = merged.join(active.groupBy("fingerprint").agg(F.min("claim_id").alias("claim_id")), "fingerprint", "left")
    return rows.select("run_id", "fingerprint", "position", F.col("last.draft_id").alias("draft_id"), "drafts", "claim_id", F.col("claim_id").isNotNull().alias("reused"))


def span_violations(origins: DataFrame, blocks: DataFrame) -> DataFrame:
    """Origins whose block isn't there or ends before their span does."""
    b = blocks.select("doc_id", "anchor", "character_count")
    rows = origins.join(b, ["doc_id", "anchor"], "left")
    problem = F.when(F.col("character_count").isNull(), "NO_BLOCK").when((F.col("start") < 0) | (F.col("start") >= F.col("stop")) | (F.col("stop") > F.col("character_count")), "SPAN")
    return rows.select("claim_id", "doc_id", "anchor", problem.alias("problem")).where("problem is not null")


def block_mismatches(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """Documents whose stored block metadata differ from a fresh parse, with the number of rows that do."""
    columns = ["doc_id", "ordinal", "anchor", "text_hash", "character_count"]
    a, b = stored.select(*columns), parsed.select(*columns)
    return a.exceptAll(b).unionAll(b.exceptAll(a)).groupBy("doc_id").agg(F.count("*").alias("rows"))


def resume_points(runs: DataFrame, artefacts: DataFrame) -> DataFrame:
    """Where each publication goes on: the first stage whose artefact isn't there. ``artefacts(run_id, kind)``."""
    have = artefacts.groupBy("run_id").agg(F.collect_set("kind").alias("kinds"))  # five kinds at most
    rows = runs.join(have, "run_id", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    stage, done = F.lit("NONE"), F.lit("CURATING")
    for kind, name in reversed(SAGA):
        stage = F.when(~F.array_contains("kinds", kind), F.lit(kind)).otherwise(stage)
    for kind, name in SAGA:
        done = F.when(F.forall(F.array(*(F.lit(k) for k, _ in SAGA[: [k for k, _ in SAGA].index(kind) + 1])), lambda k: F.array_contains("kinds", k)), F.lit(name)).otherwise(done)
    return rows.select("run_id", done.alias("status"), stage.alias("next_stage"))


def activations(bundles: DataFrame) -> DataFrame:
    """All of a bundle's rows match revision and status, or none of them changes: ``bundle_id, activated, entities``."""
    ok = (F.col("revision") == F.col("expected_revision")) & (F.col("status") == F.col("expected_status"))
    return bundles.groupBy("bundle_id").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("activated"), F.count("*").alias("entities"))


def note_lifecycle(notes: DataFrame) -> DataFrame:
    """What a request does to a note: deletion hides first and cleans later, restoring needs an indexed job."""
    c = F.col
    outcome = (
        F.when(c("request") == "DELETE", F.when(c("deleted_at").isNotNull(), "ALREADY_DELETED").when(c("job_status") == "ACTIVE_INDEXED", "DELETE_PENDING").otherwise("REFUSED"))
        .when(c("request") == "RESTORE", F.when(c("deleted_at").isNull(), "NOT_DELETED").when(c("job_status") == "INDEXED", "RESTORED").otherwise("REFUSED"))
    )
    return notes.select("note_id", "request", outcome.alias("outcome"))


def robots_verdict(status: Column) -> Column:
    """What a robots file's status means before its rules are read."""
    return F.when(status == 404, "ALLOW").when(status.isin(401, 403), "DENY").when(status.between(200, 299), "RULES").otherwise("ERROR")


def search_hits(responses: DataFrame, most: int) -> DataFrame:
    """``responses(request_id, payload)`` -> HTTPS addresses in order, the first of each, at most ``most`` a response."""
    return first_hits(responses.select("request_id", F.posexplode(F.from_json("payload", "array<string>")).alias("place", "url")), most)


def first_hits(found: DataFrame, most: int) -> DataFrame:
    """``found(request_id, place, url)`` -> the same for addresses that come as rows; the rank's limit works before the shuffle too."""
    first = found.where(F.col("url").startswith("https://")).groupBy("request_id", "url").agg(F.min("place").alias("place"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("place", "url"))
    rows = first.withColumn("row", place).where(F.col("row") <= most).withColumn("rank", F.col("row") - 1)
    candidate = F.concat(F.lit("candidate_"), F.substring(F.sha2(F.concat_ws("\n", "request_id", F.col("rank").cast("string"), "url"), 256), 1, 24))
    return rows.select("request_id", "rank", "url", candidate.alias("candidate_id"))


def redacted(metadata: Column) -> Column:
    """A map without the entries whose names hold a sensitive part."""
    sensitive = lambda k: F.exists(F.array(*(F.lit(p) for p in SENSITIVE_PARTS)), lambda p: F.contains(F.lower(k), p))
    return F.map_filter(metadata, lambda k, v: ~sensitive(k))


def privacy_findings(files: DataFrame) -> DataFrame:
    """``files(path, text)`` -> a row for each rule that a file breaks; one scan, no join."""
    found = F.array(*(F.when(F.col("text").rlike(pattern), F.lit(label)) for label, pattern in CONTENT_RULES))
    return files.select("path", F.explode(F.array_compact(found)).alias("finding"))
