"""Whether stored things are what they claim to be: contents, excerpts, evidence, notes, plans, runs and generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from ..functions.canonical import encoded
from ..functions.hashing import sha256
from ..functions.text import BLANK, strip
from .answer import LEAST_PRECISION, LEAST_RECALL
from .control import TRANSITIONS

# What generated Markdown must not hold, and the types of claims that need public evidence.
UNSAFE_MARKDOWN = r"(?i)<(?:script|iframe|object|embed)\b|!\[[^\]]*\]\(https?://|\]\((?:javascript|data):"
PUBLIC_EVIDENCE_TYPES = ("FACT", "DEFINITION", "PROCEDURE", "CODE_BEHAVIOR")
# Headers that tell how fresh a document is.
FRESHNESS_HEADERS = ("cache-control", "content-length", "content-type", "date", "etag", "last-modified")
# The score from which each metric passes.
PASS_AT = {"evidence_coverage": 0.95, "source_reliability": 0.8, "source_independence": 1.0, "source_agreement": 1.0, "freshness": 1.0, "version_match": 1.0, "extraction_quality": 1.0, "verifier_agreement": 1.0}


def plan_problems(manifest: DataFrame, known: DataFrame, complete: DataFrame) -> DataFrame:
    """Why a scan must not be planned: ``problem, path_key``; no rows where it may.

    ``manifest(path_key)``, ``known(path_key)``, ``complete(complete)`` of one row. A scan that isn't complete would delete
    what it didn't see; a path that stands twice on a side has no one counterpart.
    """
    twice = lambda rows, name: rows.groupBy("path_key").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("problem"), "path_key")
    partial = complete.where(~F.coalesce("complete", F.lit(False))).select(F.lit("INCOMPLETE_MANIFEST").alias("problem"), F.lit(None).cast("string").alias("path_key"))
    return twice(manifest, "REPEATED_PATH").unionByName(twice(known, "REPEATED_KNOWN_PATH")).unionByName(partial)


def located_evidence(hits: DataFrame, notes: DataFrame, versions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The hits that are evidence: through a live note, its active version and the stored artifact of that version's hash.

    ``hits(query_id, chunk_id, note_id, version_id, generation, claim_ids)``, ``notes(note_id, version_id, generation,
    deleted_at, path)``, ``versions(version_id, status, content_hash)``, ``artifacts(content_hash, note_id, version_id,
    claim_ids)``. A hit with a claim that the artifact lacks is dropped too, silently as all others. Artifacts of consecutive
    claims have ``claim_runs``, an array of ``first, last``, in place of ids: they are as large as their runs then.
    """
    runs = "claim_runs" in artifacts.columns
    live = notes.where("deleted_at is null").select("note_id", "version_id", "generation", "path")
    active = versions.where("status = 'ACTIVE'").select("version_id", "content_hash")
    stored = artifacts.select("content_hash", "note_id", "version_id", F.col("claim_runs" if runs else "claim_ids").alias("stored"))
    rows = hits.join(live, ["note_id", "version_id", "generation"]).join(active, "version_id").join(stored, ["content_hash", "note_id", "version_id"])
    in_runs = F.forall("claim_ids", lambda x: F.exists("stored", lambda run: x.between(run["first"], run["last"])))
    return rows.where(in_runs if runs else F.size(F.array_except("claim_ids", "stored")) == 0).select("query_id", "chunk_id", "note_id", "version_id", "path")


def excerpt_problems(candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """``candidates(candidate_id, source_version, anchor, excerpt_hash)`` whose text is MISSING or has another HASH.

    ``blocks(source_version, anchor, text)`` are the stored texts.
    """
    rows = candidates.join(blocks.select("source_version", "anchor", sha256(F.col("text")).alias("found")), ["source_version", "anchor"], "left")
    problem = F.when(F.col("found").isNull(), "MISSING").when(F.col("found") != F.col("excerpt_hash"), "HASH")
    return rows.select("candidate_id", problem.alias("problem")).where("problem is not null")


def snapshot_problems(stored: DataFrame) -> DataFrame:
    """``stored(content_hash, text)`` -> ``content_hash, problem``: HASH where the text isn't the hash's, COLLISION where

    texts that differ are stored under one hash.
    """
    texts = stored.withColumn("own", sha256(F.col("text"))).groupBy("content_hash").agg(F.min("own").alias("a"), F.max("own").alias("b"))
    problem = F.when(~F.col("a").eqNullSafe(F.col("b")), "COLLISION").when(~F.col("a").eqNullSafe(F.col("content_hash")), "HASH")
    return texts.select("content_hash", problem.alias("problem")).where("problem is not null")


def curation_problems(planned: DataFrame, claims: DataFrame) -> DataFrame:
    """``planned(note_id, claim_id)``, ``claims(note_id, claim_id)`` -> claims that a plan misses, repeats or doesn't know."""
    key = ["note_id", "claim_id"]
    p = planned.groupBy(*key).agg(F.count("*").alias("times"))
    c = claims.select(*key).distinct().withColumn("known", F.lit(True))
    problem = F.when(F.col("known").isNull(), "UNKNOWN").when(F.col("times").isNull(), "MISSING").when(F.col("times") > 1, "REPEATED")
    return p.join(c, key, "full_outer").select(*key, problem.alias("problem")).where("problem is not null")


def note_problems(notes: DataFrame, expected: DataFrame) -> DataFrame:
    """``notes(note_id, body, own_hash, content_hash)``, ``expected(note_id, content_hash)`` -> the first thing wrong with a note.

    ``own_hash`` is computed from the note as it is read, ``content_hash`` what it says of itself.
    """
    rows = notes.join(expected.select("note_id", F.col("content_hash").alias("wanted")), "note_id", "left")
    problem = (
        F.when(F.col("content_hash").isNull(), "HASH_MISSING").when(F.col("content_hash") != F.col("own_hash"), "HASH")
        .when(F.col("wanted") != F.col("content_hash"), "EXPECTED").when(F.col("body").rlike(UNSAFE_MARKDOWN), "UNSAFE")
    )
    return rows.select("note_id", problem.alias("problem")).where("problem is not null")


def run_outcomes(items: DataFrame) -> DataFrame:
    """``items(run_id, status)`` -> each run's outcome: unfinished items keep it open, failed or quarantined ones make it partial."""
    open_ = F.bool_or(F.col("status").isin("PENDING", "APPLYING"))
    bad = F.bool_or(F.col("status").isin("FAILED", "QUARANTINED"))
    return items.groupBy("run_id").agg(F.count("*").alias("items"), F.when(open_, "UNFINISHED").when(bad, "PARTIAL_FAILED").otherwise("COMPLETED").alias("outcome"))


def quality_metrics(evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """The eight metrics of a claim with their states: ``claim_id, metric, state, score``, a row for each.

    ``evidence(claim_id, stance, tier, coverage, family, version_match, freshness_match)`` are verified results,
    ``candidates(claim_id, complete)`` what was packed. A metric without a value is UNKNOWN; the two of marks that no result
    has, NOT_APPLICABLE.
    """
    c, trusted = F.col, F.col("tier").isin("T1", "T2")
    share = lambda mark: F.avg(c(mark).cast("double"))
    stances = F.count_distinct(F.when(trusted, c("stance")))
    has = lambda stance: F.bool_or(trusted & (c("stance") == stance))
    d = evidence.groupBy("claim_id").agg(
        F.max("coverage").alias("evidence_coverage"),
        F.when(F.bool_or(trusted), 1.0).otherwise(0.4).alias("source_reliability"),
        F.least(F.count_distinct("family") / 2.0, F.lit(1.0)).cast("double").alias("source_independence"),
        F.when(F.bool_or(trusted), F.when(has("SUPPORT") & has("CONTRADICT"), 0.0).otherwise(1.0)).alias("source_agreement"),
        share("freshness_match").alias("freshness"), share("version_match").alias("version_match"),
        F.when(stances <= 1, 1.0).otherwise(0.0).alias("verifier_agreement"),
    )
    packed = candidates.groupBy("claim_id").agg(share("complete").alias("extraction_quality"))
    rows = d.join(packed, "claim_id", "full_outer")
    listed = F.array(*(F.struct(F.lit(m).alias("metric"), c(m).alias("score"), F.lit(at).alias("at")) for m, at in PASS_AT.items()))
    rows = rows.select("claim_id", F.inline(listed))
    none = F.when(c("metric").isin("freshness", "version_match"), "NOT_APPLICABLE").otherwise("UNKNOWN")
    return rows.select("claim_id", "metric", F.when(c("score").isNull(), none).when(c("score") >= c("at"), "PASS").otherwise("FAIL").alias("state"), "score")


def verification_gaps(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Ids that a verification left out or made up: ``(claim_id, candidate_id)`` on both sides must be the same sets."""
    key = ["claim_id", "candidate_id"]
    a, b = candidates.select(*key).distinct(), results.select(*key).distinct()
    left = a.join(b, key, "left_anti").withColumn("gap", F.lit("NOT_VERIFIED"))
    return left.unionByName(b.join(a, key, "left_anti").withColumn("gap", F.lit("NOT_PACKED")))


def finish_decisions(records: DataFrame, requests: DataFrame) -> DataFrame:
    """What becomes of requests to end operations: ``request_id, id, target, outcome, next_revision``.

    ``records(id, status, revision)``, ``requests(request_id, id, target, expected_revision, reconcile)``. An operation whose
    outcome is unknown ends only by a request that says so; the transition must be one that the state machine has. Of
    several requests that could end one operation the smallest ``request_id`` does; for the others the revision has moved on.
    """
    steps = F.create_map(*(x for a, to in TRANSITIONS["idempotency"].items() for x in (F.lit(a), F.array(*(F.lit(t) for t in to)))))
    rows = requests.join(records, "id", "left")
    c = F.col
    outcome = (
        F.when(c("status").isNull(), "NOT_FOUND").when(c("revision") != c("expected_revision"), "STALE")
        .when((c("status") == "UNKNOWN") & ~c("reconcile"), "NEEDS_RECONCILING")
        .when(~F.coalesce(F.array_contains(F.try_element_at(steps, c("status")), c("target")), F.lit(False)), "ILLEGAL").otherwise("APPLIED")
    )
    rows = rows.withColumn("outcome", outcome)
    first = rows.where("outcome = 'APPLIED'").groupBy("id").agg(F.min("request_id").alias("first"))
    rows = rows.join(first, "id", "left").withColumn("outcome", F.when((c("outcome") == "APPLIED") & (c("request_id") != c("first")), "STALE").otherwise(c("outcome")))
    return rows.select("request_id", "id", "target", "outcome", F.when(c("outcome") == "APPLIED", c("revision") + 1).alias("next_revision"))


def vault_decisions(files: DataFrame, publications: DataFrame) -> DataFrame:
    """What publishing does to a file: ``path, decision``; an edit that nobody published is never overwritten.

    ``files(path, version_id, content_hash)`` are those there are, ``publications(path, base_version, base_hash, version_id,
    content_hash)`` what is to be there and what it was made from. A repeat of what is there already does nothing.
    """
    rows = publications.join(files.select("path", F.col("version_id").alias("v"), F.col("content_hash").alias("h")), "path", "left")
    c = F.col
    done = (c("v") == c("version_id")) & (c("h") == c("content_hash"))
    decision = (
        F.when(c("v").isNull(), F.when(c("base_version").isNull(), "CREATE").otherwise("CONFLICT")).when(done, "NOOP")
        .when((c("v") == c("base_version")) & (c("h") == c("base_hash")), "REPLACE").otherwise("CONFLICT")
    )
    return rows.select("path", decision.alias("decision"))


def recycle_decisions(files: DataFrame, trash: DataFrame, requests: DataFrame) -> DataFrame:
    """What moving notes to the recycle area and back does: ``note_id, request, decision``; nothing is overwritten or lost.

    ``files`` and ``trash`` have ``note_id, version_id, content_hash`` of what lies at a note's path and in its recycle place;
    ``requests(note_id, request, version_id, content_hash)`` name what is to be moved, RECYCLE or RESTORE. MOVE when it is what
    lies there and its new place is free, NOOP when it lies in its new place alone, MISSING when it is in neither; else CONFLICT.
    """
    c = F.col
    side = lambda rows, name: rows.select("note_id", F.struct("version_id", "content_hash").alias(name))
    rows = requests.join(side(files, "live"), "note_id", "left").join(side(trash, "gone"), "note_id", "left")
    wanted, recycles = F.struct("version_id", "content_hash"), c("request") == "RECYCLE"
    source, target = F.when(recycles, c("live")).otherwise(c("gone")), F.when(recycles, c("gone")).otherwise(c("live"))
    decision = (
        F.when(source.isNull() & target.isNull(), "MISSING").when(source.isNull(), F.when(target == wanted, "NOOP").otherwise("CONFLICT"))
        .when(target.isNotNull() | (source != wanted), "CONFLICT").otherwise("MOVE")
    )
    return rows.select("note_id", "request", decision.alias("decision"))


def gate_problems(gates: DataFrame, generation: str) -> DataFrame:
    """``gates(gate_id, mode, generation_id, passed, precision, recall, refusal_accuracy, unsafe)`` -> ``gate_id, problem``, null if it opens.

    INVALID without one of its values or in another mode, FAILED below a threshold or by its own word, OTHER for another generation.
    """
    c = F.col
    fields = ("mode", "generation_id", "passed", "precision", "recall", "refusal_accuracy", "unsafe")
    whole = (c("mode") == "deterministic") & ~F.exists(F.array(*(c(f).isNull() for f in fields)), lambda x: x)
    good = c("passed") & (c("precision") >= LEAST_PRECISION) & (c("recall") >= LEAST_RECALL) & (c("refusal_accuracy") == 1) & (c("unsafe") == 0)
    return gates.select("gate_id", F.when(~F.coalesce(whole, F.lit(False)), "INVALID").when(~good, "FAILED").when(c("generation_id") != generation, "OTHER").alias("problem"))


def generation_problems(rows: DataFrame, dimension: int) -> DataFrame:
    """Vectors that a generation can't take: ``id, problem``, from ``rows(id, vector, model)``; the commonest model is the generation's."""
    models = rows.groupBy("model").agg(F.count("*").alias("n")).agg(F.max_by("model", F.struct("n", "model")).alias("main"))  # one row
    c = F.col
    norm = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x)
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    problem = F.when(F.size("vector") != dimension, "DIMENSION").when(~finite, "NOT_FINITE").when(norm == 0, "ZERO").when(c("model") != c("main"), "MODEL")
    return rows.crossJoin(models).select("id", problem.alias("problem")).where("problem is not null")


def find_or_create(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``existing(key, id)``, ``wanted(key)`` -> an id for each wanted key, the old one or one made from it: ``key, id, created``."""
    rows = wanted.select(key).distinct().join(existing.groupBy(key).agg(F.min("id").alias("found")), key, "left")
    made = F.concat(F.lit("new_"), F.substring(sha256(F.col(key)), 1, 24))
    return rows.select(key, F.coalesce("found", made).alias("id"), F.col("found").isNull().alias("created"))


def repaired(index: DataFrame, expected: DataFrame, drift: DataFrame) -> DataFrame:
    """The index after a repair: unexpected rows gone, missing and changed ones as expected. ``drift(chunk_id, drift)``."""
    wrong = drift.select("chunk_id")
    right = expected.join(drift.where("drift <> 'unexpected'").select("chunk_id"), "chunk_id", "left_semi")
    return index.join(wrong, "chunk_id", "left_anti").unionByName(right.select(*index.columns))


def redacted_id(identifier: Column) -> Column:
    """An id's kind and its last four characters; of an id without a kind nothing."""
    value = F.concat(F.substring_index(identifier, "_", 1), F.lit("_…"), F.right(identifier, F.lit(4)))
    return F.when(F.contains(identifier, F.lit("_")), value).otherwise(F.lit("…"))


def safe_question(text: Column) -> Column:
    """A question without blanks around it, Unicode's among them; null where nothing is left or it holds control characters."""
    plain = strip(text)
    return F.when((plain != "") & ~plain.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), plain)


def single_line(text: Column) -> Column:
    """A stripped text of one line; null where nothing is left, or it has line breaks or control characters."""
    plain = strip(text)
    return F.when((plain != "") & ~plain.rlike(r"[\x00-\x08\x0a-\x1f\x7f]"), plain)


def chunk_form(text: Column) -> Column:
    """A chunk's text with line feeds alone for line ends, without blanks before them and around it."""
    inner = BLANK.replace(r"[\t-\r", r"[\t\x0b-\r")  # all but the line feed
    return strip(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), rf"(?<!{inner}){inner}++(?=\n|\z)", ""))


def needs_public_evidence(claim_type: Column, sensitivity: Column) -> Column:
    return (sensitivity == "PUBLIC") & claim_type.isin(*PUBLIC_EVIDENCE_TYPES)


def header_digest(headers: Column) -> Column:
    """The digest of canonical JSON that has those headers of a map that tell freshness, each by its value's own digest.

    Names count in lower case; a null value counts as no header.
    """
    lower = F.map_from_entries(F.filter(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), sha256(e["value"]).alias("value"))), lambda e: e["key"].isin(*FRESHNESS_HEADERS) & e["value"].isNotNull()))
    return sha256(encoded(lower, MapType(StringType(), StringType())))


def active_notes(notes: DataFrame, generation: int | None = None) -> DataFrame:
    """Live notes with a version, of one generation or of all, in the order of their ids."""
    live = notes.where("deleted_at is null and version_id is not null and generation is not null")
    return (live if generation is None else live.where(F.col("generation") == generation)).select("note_id", "version_id").orderBy("note_id")


def token_totals(runs: DataFrame, keys: list[str]) -> DataFrame:
    """``runs(..., tokens_in, tokens_out)`` -> sums by ``keys``; a null counts as none."""
    into, out = (F.sum(F.coalesce(c, F.lit(0))) for c in ("tokens_in", "tokens_out"))
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), into.alias("tokens_in"), out.alias("tokens_out"), (into + out).alias("tokens"))


def set_digests(rows: DataFrame, key: str, member: str) -> DataFrame:
    """The digest of each key's distinct members as a sorted JSON array; a key has few of them, as a note has claims."""
    each = rows.groupBy(key, member).agg(F.count("*").alias("n")).groupBy(key).agg(F.array_sort(F.collect_list(member)).alias("all"))
    return each.select(key, F.size("all").cast("long").alias("members"), sha256(F.to_json("all")).alias("digest"))


def canonical_signal(url: Column, link: Column) -> Column:
    """Whether a page's canonical link leads to another host; relative links and no link don't."""
    host = lambda u: F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when((host(link) != "") & (host(link) != host(url)), F.lit("canonical_origin_mismatch"))
