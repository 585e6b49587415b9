"""What the log of index generations says: entries to append, operations asked for again, and the state that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import digests

# Actions of the log, and whom it names as actor and target.
REBUILT, PROMOTED, ROLLED_BACK, ABORTED = "INDEX_GENERATION_REBUILT", "INDEX_GENERATION_PROMOTED", "INDEX_GENERATION_ROLLED_BACK", "INDEX_GENERATION_ABORTED"
ACTOR, TARGET = "SYSTEM", "INDEX_GENERATION"
#: The fields whose canonical JSON an entry's hash is taken of.
ENTRY = ("action", "actor_id", "actor_type", "after", "before", "created_at", "operation_id", "previous_entry_hash", "step_number", "target_id", "target_type")


def with_entry_hash(entries: DataFrame) -> DataFrame:
    """``entries`` with ``entry_hash``, the link of the chain; ``before`` and ``after`` are structs, without their nulls."""
    whole = digests(entries.withColumn("entry", F.struct(*(F.col(c) for c in ENTRY))), "entry", "entry_hash", sparse=("before", "after"))
    return whole.drop("entry")


def chain_problems(log: DataFrame) -> DataFrame:
    """Entries of a log that can't stand: ``operation_id, step_number, problem``; steps begin at 0 and have no gaps.

    STEP for a wrong number, LINK for another hash than the entry's before it, HASH where an entry doesn't give its own.
    """
    window = Window.partitionBy("operation_id").orderBy("step_number")  # an operation has a handful of steps
    rows = log.withColumn("last_step", F.lag("step_number").over(window)).withColumn("last_hash", F.lag("entry_hash").over(window)).withColumnRenamed("entry_hash", "said")
    c = F.col
    problem = (
        F.when(c("step_number") != F.coalesce(c("last_step") + 1, F.lit(0)), "STEP").when(~c("previous_entry_hash").eqNullSafe(c("last_hash")), "LINK").when(c("said") != c("entry_hash"), "HASH")
    )
    return with_entry_hash(rows).select("operation_id", "step_number", problem.alias("problem")).where("problem IS NOT NULL")


def last_entries(log: DataFrame) -> DataFrame:
    """The entry of the highest step of each operation."""
    rest = [c for c in log.columns if c not in ("operation_id", "step_number")]
    return log.groupBy("operation_id").agg(F.max_by(F.struct("step_number", *rest), "step_number").alias("last")).select("operation_id", "last")


def appended(log: DataFrame, entries: DataFrame) -> DataFrame:
    """``entries(operation_id, action, target_id, before, after, created_at)`` -> what is appended of them.

    ``outcome`` is APPENDED with ``step_number``, ``previous_entry_hash`` and ``entry_hash`` that go on from the operation's
    last entry (steps begin at 0); KNOWN when the last entry has that action already; FOREIGN when the operation belongs to
    another target. Of several entries of one operation the earliest counts, then the smallest action; the others are LATER.
    """
    c = F.col
    first = entries.groupBy("operation_id").agg(F.min(F.struct("created_at", "action")).alias("first"))
    rows = entries.join(first, "operation_id").join(last_entries(log), "operation_id", "left")
    outcome = (
        F.when(F.struct("created_at", "action") != c("first"), "LATER").when(c("last").isNull(), "APPENDED")
        .when(c("last.target_id") != c("target_id"), "FOREIGN").when(c("last.action") == c("action"), "KNOWN").otherwise("APPENDED")
    )
    rows = rows.withColumn("outcome", outcome).withColumn("step_number", F.coalesce(c("last.step_number") + 1, F.lit(0)).cast("long")).withColumn("previous_entry_hash", c("last.entry_hash"))
    rows = rows.withColumns({"actor_type": F.lit(ACTOR), "actor_id": F.lit(None).cast("string"), "target_type": F.lit(TARGET)})
    new = c("outcome") == "APPENDED"
    out = with_entry_hash(rows)
    return out.select("operation_id", "action", "target_id", "outcome", *(F.when(new, c(x)).alias(x) for x in ("step_number", "previous_entry_hash", "entry_hash")))


def replays(requests: DataFrame, log: DataFrame, generations: DataFrame) -> DataFrame:
    """Requests for what may have been done before: ``request_id, outcome``, and of a done one its report.

    ``requests(request_id, operation_id, action, generation_id, gate_hash)``, ``generations(generation_id, status)``. NEW when
    the operation's last entry isn't of that action; MOVED_ON when it was for another generation or the generation isn't
    active any more; BROKEN when the entry lacks an id or a count; OTHER when it made another generation active or passed
    another gate (asked for only if ``gate_hash`` isn't null); else REPLAY.
    """
    c = F.col
    rows = requests.join(last_entries(log), "operation_id", "left").join(generations.select("generation_id", "status"), "generation_id", "left")
    notes, chunks = (c("last.after")[k].try_cast("long") for k in ("note_count", "chunk_count"))
    source, active = c("last.before")["active_generation_id"], c("last.after")["active_generation_id"]
    broken = source.isNull() | active.isNull() | notes.isNull() | chunks.isNull()
    other = (active != c("generation_id")) | (c("gate_hash").isNotNull() & ~c("gate_hash").eqNullSafe(c("last.after")["gate_hash"]))
    outcome = (
        F.when(~c("last.action").eqNullSafe(c("action")), "NEW")
        .when((c("last.target_id") != c("generation_id")) | ~c("status").eqNullSafe(F.lit("ACTIVE")), "MOVED_ON")
        .when(broken, "BROKEN").when(other, "OTHER").otherwise("REPLAY")
    )
    rows = rows.withColumn("outcome", outcome)
    told = c("outcome") == "REPLAY"
    return rows.select("request_id", "outcome", F.when(told, source).alias("source"), F.when(told, notes).alias("notes"), F.when(told, chunks).alias("chunks"))


def generations_of(log: DataFrame, created: DataFrame) -> DataFrame:
    """``created(generation_id, revision, status)`` and all that the log says since -> the generations as they are now.

    Entries count in the order of ``created_at, operation_id, step_number``. Promoting and rolling back make the target active
    and what was active superseded, aborting makes it failed unless it has failed, rebuilding changes nothing. Each change
    counts the revision up. An entry that repeats its operation's action isn't in a log (see ``appended``).
    """
    c = F.col
    at = F.struct("created_at", "operation_id", "step_number").alias("at")
    switched = F.array(F.struct(c("target_id").alias("generation_id"), F.lit("ACTIVE").alias("status")), F.struct(c("before")["active_generation_id"].alias("generation_id"), F.lit("SUPERSEDED").alias("status")))
    failed = F.array(F.struct(c("target_id").alias("generation_id"), F.lit("FAILED").alias("status")))
    aborts = (c("action") == ABORTED) & (c("before")["target_status"] != "FAILED")
    effects = log.select(at, F.explode(F.when(c("action").isin(PROMOTED, ROLLED_BACK), switched).when(aborts, failed)).alias("e"))
    now = effects.groupBy(c("e.generation_id").alias("generation_id")).agg(F.max_by(c("e.status"), "at").alias("now"), F.count("*").alias("steps"))
    rows = created.join(now, "generation_id", "left")
    return rows.select("generation_id", (c("revision") + F.coalesce("steps", F.lit(0))).alias("revision"), F.coalesce("now", "status").alias("status"))
