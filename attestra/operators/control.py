"""Auditable state: guarded updates, transitions, leases and hash-chained logs, on immutable tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The transitions each state machine allows.
TRANSITIONS = {
    "answer_run": {"IN_PROGRESS": ("ANSWERED", "REFUSED", "FAILED")},
    "source_version": {
        "CAPTURED": ("PARSED", "PARSE_FAILED", "QUARANTINED", "DELETED"),
        "PARSED": ("READY", "PARSE_FAILED", "QUARANTINED", "DELETED"),
        "READY": ("DELETED",),
        "PARSE_FAILED": ("PARSED", "QUARANTINED", "DELETED"),
        "QUARANTINED": ("DELETED",),
    },
    "claim": {
        "PROPOSED": ("VERIFIED", "USER_ASSERTED", "OPINION", "INSUFFICIENT", "CONTESTED", "REJECTED", "QUARANTINED"),
        "VERIFIED": ("OUTDATED", "SUPERSEDED"),
        "USER_ASSERTED": ("OUTDATED", "SUPERSEDED"),
        "OPINION": ("OUTDATED", "SUPERSEDED"),
        "INSUFFICIENT": ("OUTDATED", "SUPERSEDED"),
        "CONTESTED": ("OUTDATED", "SUPERSEDED"),
    },
    "curated_version": {
        "DRAFT": ("VALIDATING",),
        "VALIDATING": ("STAGING", "QUARANTINED", "FAILED"),
        "STAGING": ("ACTIVE", "QUARANTINED", "FAILED"),
        "ACTIVE": ("STALE_PENDING_REVIEW", "SUPERSEDED"),
        "STALE_PENDING_REVIEW": ("SUPERSEDED",),
    },
    "index_generation": {"STAGING": ("ACTIVE", "FAILED"), "ACTIVE": ("SUPERSEDED",), "SUPERSEDED": ("ACTIVE",)},
    "index_job": {
        "PENDING": ("INDEXING",),
        "INDEXING": ("INDEXED", "FAILED"),
        "INDEXED": ("ACTIVE_INDEXED",),
        "ACTIVE_INDEXED": ("DELETE_PENDING",),
        "DELETE_PENDING": ("DELETED", "ACTIVE_INDEXED"),
        "DELETED": ("PENDING",),
        "FAILED": ("PENDING",),
    },
    "knowledge_change": {
        "RECEIVED": ("VALIDATING", "FAILED", "QUARANTINED"),
        "VALIDATING": ("PUBLISH_INTENT", "REVIEW_REQUIRED", "FAILED", "QUARANTINED"),
        "REVIEW_REQUIRED": ("PUBLISH_INTENT", "FAILED", "QUARANTINED"),
        "PUBLISH_INTENT": ("ACTIVE", "FAILED", "QUARANTINED"),
    },
    "model_run": {"STARTED": ("SUCCEEDED", "FAILED", "CANCELLED")},
    "idempotency": {"IN_PROGRESS": ("SUCCEEDED", "FAILED", "UNKNOWN"), "UNKNOWN": ("SUCCEEDED", "FAILED")},
    "ingestion_run": {"PLANNING": ("APPLYING", "FAILED", "ABANDONED"), "APPLYING": ("COMPLETED", "PARTIAL_FAILED", "FAILED", "ABANDONED")},
    "ingestion_item": {"PENDING": ("APPLYING",), "APPLYING": ("SUCCEEDED", "SKIPPED", "QUARANTINED", "FAILED"), "FAILED": ("PENDING",)},
    "governance_run": {
        "PLANNING": ("EXTRACTING", "FAILED", "QUARANTINED"),
        "EXTRACTING": ("EVALUATING", "FAILED", "QUARANTINED"),
        "EVALUATING": ("RECONCILING", "FAILED", "QUARANTINED"),
        "RECONCILING": ("COMPLETED", "PARTIAL_FAILED", "FAILED", "QUARANTINED"),
    },
    "governance_item": {
        "EXTRACTED": ("EVIDENCE_PENDING", "DECIDING", "FAILED"),
        "EVIDENCE_PENDING": ("VERIFYING", "FAILED"),
        "VERIFYING": ("DECIDING", "FAILED"),
        "DECIDING": ("DECIDED", "REVIEW_REQUIRED", "FAILED"),
    },
    "review_request": {"PENDING": ("APPROVED", "REJECTED", "CANCELLED")},
    "publication_run": {
        "PLANNING": ("CURATING", "FAILED"),
        "CURATING": ("VAULT_STAGED", "FAILED"),
        "VAULT_STAGED": ("INDEXING", "FAILED"),
        "INDEXING": ("INDEX_VERIFIED", "FAILED"),
        "INDEX_VERIFIED": ("VAULT_PUBLISHED", "FAILED"),
        "VAULT_PUBLISHED": ("ACTIVATING", "FAILED"),
        "ACTIVATING": ("COMPLETED", "FAILED"),
        "FAILED": ("CURATING", "VAULT_STAGED", "INDEXING", "INDEX_VERIFIED", "VAULT_PUBLISHED", "ACTIVATING"),
    },
}


def transitions(spark: SparkSession) -> DataFrame:
    """``machine, from_state, to_state``: every allowed step."""
    rows = [(m, a, b) for m, steps in TRANSITIONS.items() for a, to in steps.items() for b in to]
    return spark.createDataFrame(rows, "machine string, from_state string, to_state string")


def transition_violations(history: DataFrame, allowed: DataFrame) -> DataFrame:
    """``history(machine, entity_id, step, state)`` -> steps that no machine allows. What isn't declared is a violation."""
    window = Window.partitionBy("machine", "entity_id").orderBy("step")
    steps = history.withColumn("from_state", F.lag("state").over(window)).where("from_state is not null").withColumnRenamed("state", "to_state")
    return steps.join(allowed, ["machine", "from_state", "to_state"], "left_anti").select("machine", "entity_id", "step", "from_state", "to_state")


def compare_and_swap(current: DataFrame, updates: DataFrame) -> DataFrame:
    """``current(id, revision, state)``, ``updates(id, revision, state)`` -> each update's ``outcome`` and the revision after it.

    APPLIED when it names the present revision and is the only update of its row; CONFLICT when there are several, STALE
    for another revision, NOT_FOUND without a row.
    """
    several = updates.groupBy("id").agg(F.count("*").alias("n"))
    rows = updates.join(several, "id").join(current.select("id", F.col("revision").alias("now"), F.col("state").alias("old_state")), "id", "left")
    outcome = F.when(F.col("now").isNull(), "NOT_FOUND").when(F.col("n") > 1, "CONFLICT").when(F.col("revision") != F.col("now"), "STALE").otherwise("APPLIED")
    return rows.select("id", "revision", "state", outcome.alias("outcome")).withColumn("next_revision", F.when(F.col("outcome") == "APPLIED", F.col("revision") + 1))


def swapped(current: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The table after the applied updates."""
    new = outcomes.where("outcome = 'APPLIED'").select("id", F.col("next_revision").alias("r"), F.col("state").alias("s"))
    return current.join(new, "id", "left").select("id", F.coalesce("r", "revision").alias("revision"), F.coalesce("s", "state").alias("state"))


def entry_text(*parts: Column) -> Column:
    return F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))


def chain_breaks(log: DataFrame) -> DataFrame:
    """``log(operation_id, step, payload, previous_hash, entry_hash)`` -> entries whose step, link or hash is wrong."""
    window = Window.partitionBy("operation_id").orderBy("step")
    rows = log.withColumn("last_step", F.lag("step").over(window)).withColumn("last_hash", F.lag("entry_hash").over(window))
    gap = F.col("step") != F.coalesce("last_step", F.lit(0)) + 1
    link = ~F.col("previous_hash").eqNullSafe(F.col("last_hash"))
    own = F.col("entry_hash") != F.sha2(entry_text(F.col("operation_id"), F.col("step"), F.col("payload"), F.col("previous_hash")), 256)
    broken = F.when(gap, "STEP").when(link, "LINK").when(own, "HASH")
    return rows.select("operation_id", "step", broken.alias("broken")).where("broken is not null")


def lease_decisions(requests: DataFrame, records: DataFrame) -> DataFrame:
    """What a request for a key gets: ACQUIRED, CONFLICT, REPLAY, RECONCILE, TERMINAL, BUSY or TAKEN_OVER, and the attempt."""
    r = records.select("scope", "key", F.col("request_hash").alias("had_hash"), "status", "lease_expires_at", "attempt")
    rows = requests.join(r, ["scope", "key"], "left")
    c = F.col
    outcome = (
        F.when(c("status").isNull(), "ACQUIRED")
        .when(c("had_hash") != c("request_hash"), "CONFLICT")
        .when(c("status") == "SUCCEEDED", "REPLAY")
        .when(c("status") == "UNKNOWN", "RECONCILE")
        .when(c("status") == "FAILED", "TERMINAL")
        .when(F.coalesce(c("lease_expires_at") > c("asked_at"), F.lit(False)), "BUSY")
        .otherwise("TAKEN_OVER")
    )
    rows = rows.withColumn("outcome", outcome)
    attempt = F.when(c("outcome") == "ACQUIRED", 1).when(c("outcome") == "TAKEN_OVER", c("attempt") + 1).otherwise(c("attempt"))
    return rows.select("scope", "key", "request_hash", "outcome", attempt.cast("long").alias("attempt"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the largest ``order`` for each key, by an aggregate that combines before the shuffle."""
    rest = [x for x in rows.columns if x not in (key, order)]
    return rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("r")).select(key, "r.*")


OUTCOMES = "id long, seq long, expected long, state string, outcome string, revision long"


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Updates sorted by row and turn; only the present revision of one row is kept between them."""
    row, now = None, None
    for batch in batches:
        ids, begun, expected = (batch.column(c).to_pylist() for c in ("id", "begun", "expected"))
        outcomes, after = [], []
        for i, start, wanted in zip(ids, begun, expected, strict=True):
            if i != row:
                row, now = i, start
            if now is None:
                outcomes.append("NOT_FOUND")
            elif wanted == now:
                now += 1
                outcomes.append("APPLIED")
            else:
                outcomes.append("STALE" if wanted is not None and wanted < now else "AHEAD")
            after.append(now)
        columns = [batch.column(c) for c in ("id", "seq", "expected", "state")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(outcomes, pa.string()), pa.array(after, pa.int64())], ["id", "seq", "expected", "state", "outcome", "revision"])


def applied_in_turn(current: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Several updates of a row, one after the other: each update's outcome, and the table after all of them.

    ``current(id, revision, state)``, ``updates(id, seq, expected, state)``; ``seq`` is the order, ties go by expected revision and
    state. An update is APPLIED if it expects the revision that the row has when its turn comes, which counts it up; STALE if
    that has moved on, AHEAD if it isn't reached or null, NOT_FOUND without the row. Turns of one row follow each other by
    nature: they pass through a task as a sorted stream that keeps one number, so a row with many updates costs time, not memory.
    """
    begun = current.select("id", F.col("revision").cast("long").alias("begun"))
    rows = updates.where("id IS NOT NULL").join(begun, "id", "left").select(F.col("id").cast("long").alias("id"), "begun", F.col("seq").cast("long").alias("seq"), F.col("expected").cast("long").alias("expected"), "state")
    outcomes = rows.repartition("id").sortWithinPartitions("id", "seq", "expected", "state").mapInArrow(_in_turn, OUTCOMES)
    last = outcomes.where("outcome = 'APPLIED'").groupBy("id").agg(F.max(F.struct("revision", "state")).alias("new"))
    after = current.join(last, "id", "left").select("id", F.coalesce("new.revision", F.col("revision").cast("long")).alias("revision"), F.when(F.col("new").isNotNull(), F.col("new.state")).otherwise(F.col("state")).alias("state"))
    return outcomes, after
