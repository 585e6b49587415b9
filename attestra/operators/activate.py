"""Which content is live: activating publications, and moving all notes from one index generation to another.

Six tables change together. An operator reads them as they are, decides, and gives them as they would be; ``commit``
makes that the next version of all six at once, by ``sources.versioned``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.versioned import Tables
from ..streaming.run import kept


class State(NamedTuple):
    """``runs(run_id, revision, status, note_id, version_id, change_id, generation_id)``, ``notes(note_id, revision,
    current_version_id, generation_id, deleted)``, ``versions(version_id, revision, status, note_id, change_id)``,
    ``jobs(job_id, revision, status, version_id, generation_id)``, ``changes(change_id, revision, status)`` and
    ``generations(generation_id, revision, status)``."""

    runs: DataFrame
    notes: DataFrame
    versions: DataFrame
    jobs: DataFrame
    changes: DataFrame
    generations: DataFrame


KEYS = {"runs": "run_id", "notes": "note_id", "versions": "version_id", "jobs": "job_id", "changes": "change_id", "generations": "generation_id"}


def _under(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{prefix}_{c}") for c in rows.columns))


def activation_outcomes(state: State, requests: DataFrame) -> DataFrame:
    """What becomes of each request: ``request_id, outcome`` and the ids it concerns.

    ``requests(request_id, run_id, job_id, run_revision, note_revision, version_revision, job_revision, change_revision,
    generation_revision)``. NOT_FOUND when a row is missing, STALE when a revision has moved on or the note is deleted,
    INVALID when statuses or links don't fit, MIGRATION_REQUIRED when the generation is still being staged while live
    notes are on the active one. A row changes once: of requests that want the same one, the smallest id may have it and
    the others are CONFLICT, to be asked again. What is left is ACTIVATED. Null ids match nothing. The joined tables serve the
    outcomes and the search for conflicts, so they are written once.
    """
    c = F.col
    for name in ("run", "note", "version", "job", "change", "generation"):
        requests = requests.withColumnRenamed(f"{name}_revision", f"wanted_{name}")
    rows = requests.join(_under(state.runs, "run"), c("run_id") == c("run_run_id"), "left")
    for name, table, at in (("note", state.notes, c("run_note_id")), ("version", state.versions, c("run_version_id")), ("job", state.jobs, c("job_id")), ("change", state.changes, c("run_change_id")), ("generation", state.generations, c("run_generation_id"))):
        rows = rows.join(_under(table, name), at == c(f"{name}_{name}_id"), "left")
    old = _under(state.versions.select("version_id", "revision", "status"), "old")
    rows = rows.join(old, c("note_current_version_id") == c("old_version_id"), "left")
    active = state.generations.where("status = 'ACTIVE'").agg(F.min("generation_id").alias("active_id"))  # one row
    live = state.notes.where("NOT deleted").join(active, c("generation_id") == c("active_id")).agg((F.count("*") > 0).alias("busy"))  # one row
    rows = rows.crossJoin(active).crossJoin(live)

    found, fresh = F.lit(True), ~F.coalesce("note_deleted", F.lit(False))
    for name in ("run", "note", "version", "job", "change", "generation"):
        found &= c(f"{name}_{name}_id").isNotNull()
        fresh &= c(f"{name}_revision").eqNullSafe(c(f"wanted_{name}"))
    fits = (c("run_status") == "ACTIVATING") & (c("version_status") == "STAGING") & (c("job_status") == "INDEXED") & (c("change_status") == "PUBLISH_INTENT")
    fits &= (c("version_note_id") == c("note_note_id")) & (c("version_change_id") == c("change_change_id")) & (c("job_version_id") == c("version_version_id")) & (c("job_generation_id") == c("generation_generation_id"))
    replaces = c("old_version_id").isNotNull() & (c("old_version_id") != c("version_version_id"))
    fits &= c("generation_status").isin("STAGING", "ACTIVE") & (~replaces | c("old_status").isin("ACTIVE", "STALE_PENDING_REVIEW"))
    flips = c("generation_status") == "STAGING"
    blocked = flips & c("active_id").isNotNull() & c("busy")
    outcome = F.when(~found, "NOT_FOUND").when(~fresh, "STALE").when(~F.coalesce(fits, F.lit(False)), "INVALID").when(blocked, "MIGRATION_REQUIRED").otherwise("READY")
    ids = {f"{n}_id": c(f"{n}_{n}_id") for n in ("run", "note", "version", "job", "change", "generation")}
    rows = rows.select("request_id", outcome.alias("outcome"), *(v.alias(k) for k, v in ids.items()), F.when(replaces, c("old_version_id")).alias("old_version_id"), F.when(flips, c("generation_generation_id")).alias("flips"))
    rows = kept(rows, "requests")

    ready = rows.where("outcome = 'READY'")
    wants = F.array(*(F.struct(F.lit(n).alias("kind"), c(k).cast("string").alias("id")) for n, k in (("run", "run_id"), ("note", "note_id"), ("version", "version_id"), ("version", "old_version_id"), ("job", "job_id"), ("change", "change_id"), ("generation", "flips"))))
    wanted = ready.select("request_id", F.inline(wants)).where("id IS NOT NULL")
    first = wanted.groupBy("kind", "id").agg(F.min("request_id").alias("first"))
    won = wanted.join(first, ["kind", "id"]).groupBy("request_id").agg(F.bool_and(c("first") == c("request_id")).alias("won"))
    rows = rows.join(won, "request_id", "left")
    return rows.withColumn("outcome", F.when(c("outcome") != "READY", c("outcome")).when(c("won"), "ACTIVATED").otherwise("CONFLICT")).drop("won")


def _changed(table: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """The table with the given columns of some rows replaced and their revisions counted up; ``changes`` has a row a key."""
    new = _under(changes, "new").withColumn("hit", F.lit(True))
    rows = table.join(new, F.col(key) == F.col(f"new_{key}"), "left")
    hit = F.col("hit").isNotNull()
    value: Callable[[str], Column] = lambda c: F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in changes.columns and c != key else F.col(c)
    return rows.select(*(F.when(hit, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision") if c == "revision" else value(c) for c in table.columns))


def activated(state: State, outcomes: DataFrame) -> State:
    """The six tables after the requests that came through, which are written once for all six; all other rows are as they were."""
    done = kept(outcomes.where("outcome = 'ACTIVATED'"), "activated")
    new = lambda key, status: done.select(key, F.lit(status).alias("status"))
    superseded = done.where("old_version_id IS NOT NULL").select(F.col("old_version_id").alias("version_id"), F.lit("SUPERSEDED").alias("status"))
    flips = done.where("flips IS NOT NULL").select(F.col("flips").alias("generation_id"), F.lit("ACTIVE").alias("status"))
    left = state.generations.where("status = 'ACTIVE'").join(flips.select(F.col("generation_id").alias("other")), F.lit(True)).select("generation_id", F.lit("SUPERSEDED").alias("status"))  # one row each
    return State(
        _changed(state.runs, "run_id", new("run_id", "COMPLETED")),
        _changed(state.notes, "note_id", done.select("note_id", F.col("version_id").alias("current_version_id"), "generation_id")),
        _changed(state.versions, "version_id", new("version_id", "ACTIVE").unionByName(superseded)),
        _changed(state.jobs, "job_id", new("job_id", "ACTIVE_INDEXED")),
        _changed(state.changes, "change_id", new("change_id", "ACTIVE")),
        _changed(state.generations, "generation_id", flips.unionByName(left)),
    )


#: What jobs of the generation moved to must be, and what it is itself, for either way of moving.
MOVES = {"PROMOTE": ("STAGING", "INDEXED"), "ROLLBACK": ("SUPERSEDED", "DELETE_PENDING")}


def move_outcome(state: State, action: str, generation: str, revision: int) -> DataFrame:
    """One row: whether all live notes may move to a generation: ``outcome, source, target, notes``.

    NOT_FOUND and STALE as for activations; INVALID when nothing is active, the target is active itself or isn't staged
    (to promote) or superseded (to roll back); MIXED when a live note is on neither; JOBS when a live note lacks a job in
    either generation or a job isn't done. Else MOVED. A live note isn't deleted and has a current version.
    """
    wanted_status, wanted_job = MOVES[action]
    c = F.col
    only = lambda cond, value, name: F.max(F.when(cond, value)).alias(name)
    target, active = c("generation_id") == generation, c("status") == "ACTIVE"
    head = state.generations.agg(only(target, c("revision"), "revision"), only(target, c("status"), "status"), only(active, c("generation_id"), "source"))  # one row
    live = state.notes.where("NOT deleted AND current_version_id IS NOT NULL").select("note_id", "current_version_id", c("generation_id").alias("at"))
    job = lambda name: state.jobs.select(c("version_id").alias(f"{name}_version"), c("generation_id").alias(f"{name}_generation"), c("status").alias(f"{name}_status"))
    on_source = live.crossJoin(head.select("source"))  # one row
    both = on_source.join(job("from"), (c("current_version_id") == c("from_version")) & (c("source") == c("from_generation")), "left")
    both = both.join(job("to").where(c("to_generation") == generation), c("current_version_id") == c("to_version"), "left")
    fine = (c("from_status") == "ACTIVE_INDEXED") & (c("to_status") == wanted_job)
    notes = both.agg(F.count(F.when(~c("at").eqNullSafe(c("source")), 1)).alias("mixed"), F.count(F.when(~F.coalesce(fine, F.lit(False)), 1)).alias("unready"), F.count_distinct("note_id").alias("notes"))  # one row
    rows = head.crossJoin(notes)
    outcome = (
        F.when(c("status").isNull(), "NOT_FOUND").when(c("revision") != revision, "STALE")
        .when(c("source").isNull() | (c("source") == generation) | (c("status") != wanted_status), "INVALID")
        .when(c("mixed") > 0, "MIXED").when(c("unready") > 0, "JOBS").otherwise("MOVED")
    )
    return rows.select(outcome.alias("outcome"), "source", F.lit(generation).alias("target"), F.when(outcome == "MOVED", c("notes")).otherwise(0).alias("notes"))


def moved(state: State, outcome: DataFrame) -> State:
    """The six tables after a move, or as they were if it didn't come through. ``outcome`` is one row, written or small."""
    c = F.col
    go = outcome.where("outcome = 'MOVED'").select("source", "target")  # one row or none
    live = state.notes.where("NOT deleted AND current_version_id IS NOT NULL").crossJoin(go)
    jobs = live.select(c("current_version_id").alias("version_id"), F.explode(F.array(F.struct(c("source").alias("g"), F.lit("DELETE_PENDING").alias("s")), F.struct(c("target").alias("g"), F.lit("ACTIVE_INDEXED").alias("s")))).alias("x"))
    jobs = state.jobs.join(jobs, (state.jobs["version_id"] == jobs["version_id"]) & (c("generation_id") == c("x.g")), "left_semi").crossJoin(go)
    jobs = jobs.select("job_id", F.when(c("generation_id") == c("source"), "DELETE_PENDING").otherwise("ACTIVE_INDEXED").alias("status"))
    generations = state.generations.crossJoin(go).where("generation_id IN (source, target)").select("generation_id", F.when(c("generation_id") == c("source"), "SUPERSEDED").otherwise("ACTIVE").alias("status"))
    return state._replace(
        notes=_changed(state.notes, "note_id", live.select("note_id", c("target").alias("generation_id"))), jobs=_changed(state.jobs, "job_id", jobs), generations=_changed(state.generations, "generation_id", generations)
    )


def aborted(state: State, generation: str) -> tuple[DataFrame, State]:
    """Marks a staged generation as failed while another stays active: one row ``outcome, active``, and the tables after.

    ABORTED, or ALREADY_FAILED for one that has failed before; REFUSED when nothing is active, the generation is active
    itself, or has been active; NOT_FOUND without it.
    """
    c = F.col
    only = lambda cond, value, name: F.max(F.when(cond, value)).alias(name)
    head = state.generations.agg(only(c("generation_id") == generation, c("status"), "status"), only(c("status") == "ACTIVE", c("generation_id"), "active"))  # one row
    outcome = F.when(c("status").isNull(), "NOT_FOUND").when(c("active").isNull(), "REFUSED").when(c("status") == "STAGING", "ABORTED").when(c("status") == "FAILED", "ALREADY_FAILED").otherwise("REFUSED")
    said = head.select(outcome.alias("outcome"), "active")
    failed = said.where("outcome = 'ABORTED'").select(F.lit(generation).alias("generation_id"), F.lit("FAILED").alias("status"))
    return said, state._replace(generations=_changed(state.generations, "generation_id", failed))


def read(store: Tables, version: int | None = None) -> State:
    version = store.version() if version is None else version
    return State(*(store.read(name, version) for name in State._fields))


def commit(store: Tables, operation: str, change: Callable[[State], State]) -> int:
    """Runs a change on the tables that hold and makes its result hold, all six at once or nothing.

    An operation that has been committed isn't done again; its version is given. Conflict when others were faster.
    """
    done = store.committed(operation)
    if done is not None:
        return done
    with store.transaction(operation) as transaction:
        before = State(*(transaction.read(name) for name in State._fields))
        after = change(before)
        for name, old, new in zip(State._fields, before, after, strict=True):
            if new is not old:
                transaction.write(name, new)
        return transaction.commit()
