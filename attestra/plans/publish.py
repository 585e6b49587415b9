"""Queries over curated notes, chunks and index generations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import publish, verify
from ..sources.tables import table
from .base import derived, query, twin

CLAIMS = """SELECT doc_id, 'claim_' || cast(doc_id AS string) AS claim_id, 'n' || cast(cast(floor(doc_id / 10) AS bigint) AS string) AS note_id, doc_id AS seq, source AS subject, lang AS predicate, text AS value,
  CASE doc_id % 5 WHEN 0 THEN 'FACT' WHEN 1 THEN 'CODE_BEHAVIOR' WHEN 2 THEN 'USER_EXPERIENCE' ELSE 'DEFINITION' END AS claim_type,
  CASE doc_id % 6 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'USER_ASSERTED' WHEN 2 THEN 'OPINION' WHEN 3 THEN 'REJECTED' ELSE 'VERIFIED' END AS status,
  CASE doc_id % 8 WHEN 0 THEN 'PRIVATE' WHEN 1 THEN 'RESTRICTED' ELSE 'PUBLIC' END AS sensitivity,
  CASE WHEN doc_id % 4 <> 0 THEN 100 + doc_id % 50 END AS valid_from, CASE WHEN doc_id % 3 <> 0 THEN 1000 + doc_id % 70 END AS valid_to, CASE WHEN doc_id % 7 = 0 THEN 500 + doc_id % 30 END AS freshness_at,
  CASE WHEN doc_id % 31 = 0 THEN 1 END AS deleted_at FROM {documents}"""
LIVE_SQL = f"c AS (SELECT * FROM ({twin(CLAIMS)}) WHERE deleted_at IS NULL AND status IN ('VERIFIED', 'USER_ASSERTED', 'OPINION'))"
_INLINE = r"regexp_replace(trim(regexp_replace(regexp_replace({0}, '[\x00-\x1f\x7f]+', ' ', 'g'), '\s+', ' ', 'g')), '([\\`*_{{}}\[\]<>#|])', '\\\1', 'g')"


def _live(spark, sf):
    return publish.publishable_claims(derived(spark, sf, CLAIMS))


@query("active_claims", f"WITH {LIVE_SQL} SELECT claim_id, note_id, status, sensitivity FROM c")
def active_claims(spark, sf):
    return _live(spark, sf).select("claim_id", "note_id", "status", "sensitivity")


def sentence_sql() -> str:
    return "'- ' || " + _INLINE.format("subject") + " || ' — ' || " + _INLINE.format("predicate") + " || ': ' || " + _INLINE.format("value") + " || ' [^' || claim_id || ']'"


@query("claim_sentence", f"WITH {LIVE_SQL} SELECT claim_id, {sentence_sql()} AS sentence FROM c")
def claim_sentence(spark, sf):
    return _live(spark, sf).select("claim_id", publish.claim_sentence(F.col("claim_id"), F.col("subject"), F.col("predicate"), F.col("value")).alias("sentence"))


@query("curation_groups", f"WITH {LIVE_SQL} SELECT note_id, array_to_string(list_transform(string_split(lower(replace(claim_type, '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS heading, min(seq) AS first_seq, count(*) AS claims FROM c GROUP BY note_id, claim_type")
def curation_groups(spark, sf):
    return publish.curation_groups(_live(spark, sf))


@query("plain_title", r"SELECT doc_id, coalesce(nullif(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 120), ''), 'Curated knowledge') AS title FROM documents")
def plain_title(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.plain_title(F.col("text")).alias("title"))


SECTIONS = "SELECT doc_id AS note_id, 'v' || cast(doc_id AS string) AS version_id, 0 AS section, source AS title, lang AS heading, text FROM {documents}"


def _sections(spark, sf):
    return derived(spark, sf, SECTIONS).withColumn("whole", F.filter(F.split("text", "\n"), lambda x: x != "")).withColumn("lines", publish.fitting_lines(F.col("whole")))


def _chunks(spark, sf):
    return publish.chunks(_sections(spark, sf))


#: The fold as a recursion over lines: what each line closes, then the open rest.
CHUNK_SQL = f"""RECURSIVE sec AS (SELECT doc_id AS note_id, '# ' || source || chr(10) || '## ' || lang AS head, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS whole FROM documents),
    fit AS (SELECT note_id, head, length(head) + 2 AS prefix, flatten(list_transform(whole, lambda x: list_transform(range(0, (length(x) - 1) // greatest(1, {publish.HARD_LIMIT} - 1 - length(head) - 2) + 1),
      lambda i: substr(x, (i * greatest(1, {publish.HARD_LIMIT} - 1 - length(head) - 2) + 1)::BIGINT, greatest(1, {publish.HARD_LIMIT} - 1 - length(head) - 2)::BIGINT)))) AS lines FROM sec),
    li AS (SELECT note_id, prefix, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM fit),
    fold AS (
      SELECT note_id, 0::BIGINT AS i, []::VARCHAR[] AS cur, []::VARCHAR[][] AS closed FROM fit WHERE len(lines) > 0
      UNION ALL
      SELECT note_id, i + 1, CASE WHEN over_ THEN [line] ELSE list_append(base, line) END, list_concat(CASE WHEN full_ THEN [cur] ELSE [] END, CASE WHEN over_ THEN [base] ELSE [] END) FROM (
        SELECT *, len(base) > 0 AND prefix + list_sum(list_transform(base, lambda x: length(x) + 1)) + length(line) + 1 > {publish.HARD_LIMIT} AS over_ FROM (
          SELECT *, CASE WHEN full_ THEN list_filter(cur, lambda x, k: list_sum(list_transform(cur[k:], lambda y: length(y) + 1)) <= {publish.OVERLAP}) ELSE cur END AS base FROM (
            SELECT f.note_id, f.i, f.cur, prefix, line, len(cur) > 0 AND prefix + list_sum(list_transform(cur, lambda x: length(x) + 1)) + length(line) + 1 > {publish.TARGET} AS full_
            FROM fold f JOIN li ON li.note_id = f.note_id AND li.i = f.i + 1)))
    ), parts AS (
      SELECT note_id, i, generate_subscripts(closed, 1) AS k, unnest(closed) AS batch FROM fold UNION ALL SELECT note_id, i + 1, 1, cur FROM fold WHERE len(cur) > 0 AND i = (SELECT max(l.i) FROM li l WHERE l.note_id = fold.note_id)
    ), chunk AS (
      SELECT note_id, head, batch, row_number() OVER (PARTITION BY note_id ORDER BY i, k) - 1 AS ordinal, head || chr(10) || chr(10) || array_to_string(batch, chr(10)) AS text FROM parts JOIN fit USING (note_id)
    )"""


@query("chunk_pack", f"WITH {CHUNK_SQL} SELECT note_id, ordinal::INT AS ordinal, len(batch)::INT AS lines, length(text)::INT AS chars, sha256('v' || note_id || '|{publish.CHUNKER}|' || ordinal || '|' || text) AS chunk_id FROM chunk")
def chunk_pack(spark, sf):
    """A fold in one row; brute force in the tests has further cases."""
    return _chunks(spark, sf).select("note_id", "ordinal", "lines", F.length("text").alias("chars"), "chunk_id")


@query("chunk_counts", f"WITH {CHUNK_SQL}, got AS (SELECT note_id, count(*) AS chunks, flatten(list(batch)) AS held FROM chunk GROUP BY 1) SELECT note_id, chunks, list_has_all(held, lines) AND array_to_string(lines, '') = array_to_string(whole, '') AS covered FROM fit JOIN sec USING (note_id) JOIN got USING (note_id)")
def chunk_counts(spark, sf):
    """A note's chunks, and whether they hold all its text: each line, or each slice of it where the slices make up the line."""
    hashed = lambda xs: F.transform(xs, lambda x: F.xxhash64(x))
    uncut = F.array_join("whole", "") == F.array_join("lines", "")
    source = _sections(spark, sf).where(F.size("whole") > 0).select("note_id", uncut.alias("uncut"), hashed(F.col("lines")).alias("want"))
    held = F.split("text", "\n")  # a chunk starts with title, heading and an empty line
    got = _chunks(spark, sf).groupBy("note_id").agg(F.flatten(F.collect_list(hashed(F.slice(held, F.lit(4), F.size(held))))).alias("got"), F.count("*").alias("chunks"))  # a note's own lines
    missing = F.size(F.array_except("want", F.coalesce("got", F.array().cast("array<bigint>"))))
    return source.join(got, "note_id", "left").select("note_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), (F.col("uncut") & (missing == 0)).alias("covered"))


META_SQL = f"WITH {LIVE_SQL}, m AS (SELECT sha256(note_id || '|' || claim_type) AS chunk_id, * FROM c)"


@query(
    "chunk_metadata",
    META_SQL
    + """ SELECT chunk_id, CASE max(CASE status WHEN 'VERIFIED' THEN 0 WHEN 'USER_ASSERTED' THEN 1 ELSE 2 END) WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'USER_ASSERTED' ELSE 'OPINION' END AS quality_status,
      CASE max(CASE sensitivity WHEN 'PUBLIC' THEN 0 WHEN 'RESTRICTED' THEN 1 ELSE 2 END) WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'RESTRICTED' ELSE 'PRIVATE' END AS sensitivity,
      max(valid_from)::BIGINT AS valid_from, min(valid_to)::BIGINT AS valid_to, min(freshness_at)::BIGINT AS freshness_at, count(*) AS claims FROM m GROUP BY chunk_id""",
)
def chunk_metadata(spark, sf):
    return publish.chunk_metadata(_live(spark, sf).withColumn("chunk_id", F.sha2(F.concat_ws("|", "note_id", "claim_type"), 256)))


@query("coverage_gaps", f"WITH {LIVE_SQL} SELECT claim_id, 'missing' AS gap FROM c WHERE subject = 'src7' UNION ALL SELECT DISTINCT 'ghost_' || doc_id, 'unknown' FROM documents WHERE source = 'src8'")
def coverage_gaps(spark, sf):
    live = _live(spark, sf)
    ghosts = table(spark, sf, "documents").where("source = 'src8'").select(F.concat(F.lit("ghost_"), F.col("doc_id").cast("string")).alias("claim_id"))
    return publish.coverage_gaps(live, live.where("subject <> 'src7'").select("claim_id").unionByName(ghosts))


EXPECTED = "SELECT cast(doc_id AS string) AS chunk_id, cast(floor(doc_id / 10) AS bigint) AS note_id, doc_id % 3 AS version_id, sha2(text, 256) AS content_hash FROM {documents} WHERE source <> 'src3'"
ACTUAL = "SELECT cast(doc_id AS string) AS chunk_id, cast(floor(doc_id / 10) AS bigint) AS note_id, CASE WHEN n_chars % 67 = 0 THEN 9 ELSE doc_id % 3 END AS version_id, CASE WHEN n_chars % 53 = 0 THEN sha2(source, 256) ELSE sha2(text, 256) END AS content_hash FROM {documents} WHERE source <> 'src5'"
DRIFT_SQL = f"""d AS (SELECT coalesce(e.chunk_id, a.chunk_id) AS chunk_id, coalesce(e.note_id, a.note_id) AS note_id, CASE WHEN a.chunk_id IS NULL THEN 'missing' WHEN e.chunk_id IS NULL THEN 'unexpected' ELSE 'changed' END AS drift
  FROM ({twin(EXPECTED)}) e FULL JOIN ({twin(ACTUAL)}) a ON e.chunk_id = a.chunk_id WHERE a.chunk_id IS NULL OR e.chunk_id IS NULL OR e.version_id <> a.version_id OR e.content_hash <> a.content_hash)"""


def _drift(spark, sf):
    return publish.probe_drift(derived(spark, sf, EXPECTED), derived(spark, sf, ACTUAL))


@query("probe_drift", f"WITH {DRIFT_SQL} SELECT chunk_id, drift FROM d")
def probe_drift(spark, sf):
    return _drift(spark, sf)


NOTES = "SELECT cast(floor(doc_id / 10) AS bigint) AS note_id, max(n_chars) % 11 <> 0 AS vault_ok FROM {documents} GROUP BY 1"


@query(
    "reconcile_findings",
    f"""WITH {DRIFT_SQL}, n AS (SELECT note_id, count(*) AS drift FROM d GROUP BY 1)
    SELECT note_id, coalesce(drift, 0) AS drift, CASE WHEN NOT vault_ok THEN 'BLOCKED' WHEN drift IS NULL THEN 'HEALTHY' ELSE 'REPAIRABLE' END AS finding,
      CASE WHEN NOT vault_ok THEN 'vault_verification_failed' WHEN drift IS NOT NULL THEN 'index_drift' END AS reason FROM ({twin(NOTES)}) LEFT JOIN n USING (note_id)""",
)
def reconcile_findings(spark, sf):
    by_note = _drift(spark, sf).groupBy(F.floor(F.col("chunk_id").cast("long") / 10).alias("note_id")).agg(F.count("*").alias("drift"))
    return publish.reconcile(derived(spark, sf, NOTES), by_note, repair=False)


PROBED = "SELECT cast(floor(doc_id / 10) AS bigint) AS note_id, max(n_chars) % 11 <> 0 AS vault_ok, max(n_chars) % 7 <> 0 AS probed FROM {documents} GROUP BY 1"


@query(
    "reconcile_repairs",
    f"""WITH {DRIFT_SQL}, n AS (SELECT note_id, count(*) AS drift, count(*) FILTER (chunk_id::BIGINT % 13 = 0) AS stuck FROM d GROUP BY 1),
    r AS (SELECT note_id, coalesce(drift, 0) AS drift, coalesce(stuck, 0) AS left_, CASE WHEN NOT vault_ok THEN 'vault_verification_failed' WHEN NOT probed THEN 'index_verification_failed' WHEN drift IS NULL THEN 'publication_healthy' WHEN stuck > 0 THEN 'index_repair_failed' ELSE 'index_repaired' END AS reason
      FROM ({twin(PROBED)}) LEFT JOIN n USING (note_id))
    SELECT note_id, CASE reason WHEN 'publication_healthy' THEN 'HEALTHY' WHEN 'index_repaired' THEN 'REPAIRABLE' ELSE 'BLOCKED' END AS finding, reason, drift, left_ AS left FROM r""",
)
def reconcile_repairs(spark, sf):
    """The index takes no change to every thirteenth chunk, so some repairs don't hold."""
    expected, actual = derived(spark, sf, EXPECTED), derived(spark, sf, ACTUAL)
    takes = publish.probe_drift(expected, actual).where("cast(chunk_id AS bigint) % 13 <> 0")
    note = F.floor(F.col("chunk_id").cast("long") / 10)
    return publish.reconcile_again(derived(spark, sf, PROBED), expected, actual, verify.repaired(actual, expected, takes), note)


@query("index_upsert", f"WITH e AS ({twin(EXPECTED)}), a AS ({twin(ACTUAL)}) SELECT * FROM a UNION ALL SELECT * FROM e WHERE chunk_id NOT IN (SELECT chunk_id FROM a)")
def index_upsert(spark, sf):
    return publish.upsert(derived(spark, sf, EXPECTED), derived(spark, sf, ACTUAL))


@query("index_delete", f"SELECT * FROM ({twin(EXPECTED)}) WHERE chunk_id NOT IN (SELECT doc_id::VARCHAR FROM documents WHERE lang = 'de')")
def index_delete(spark, sf):
    ids = table(spark, sf, "documents").where("lang = 'de'").select(F.col("doc_id").cast("string").alias("chunk_id"))
    return publish.delete(derived(spark, sf, EXPECTED), ids)


GEN_NOTES = "SELECT c_custkey AS note_id, c_custkey % 3 AS generation, CASE WHEN c_custkey % 20 = 0 THEN 1 END AS deleted_at FROM {customer}"
JOBS = "SELECT c_custkey AS note_id, 1 AS generation, 'ACTIVE_INDEXED' AS status FROM {customer} UNION ALL SELECT c_custkey, 2, CASE WHEN c_custkey % 20 = 0 THEN 'FAILED' ELSE 'INDEXED' END FROM {customer}"


@query(
    "generation_switch",
    f"""WITH n AS (SELECT * FROM ({twin(GEN_NOTES)}) WHERE generation = 1 AND deleted_at IS NULL), j AS ({twin(JOBS)}),
    r AS (SELECT note_id, EXISTS (SELECT 1 FROM j WHERE j.note_id = n.note_id AND generation = 1 AND status = 'ACTIVE_INDEXED') AND EXISTS (SELECT 1 FROM j WHERE j.note_id = n.note_id AND generation = 2 AND status = 'INDEXED') AS ready FROM n)
    SELECT note_id, ready, (SELECT bool_and(ready) FROM r) AS switched, CASE WHEN (SELECT bool_and(ready) FROM r) THEN 2 ELSE 1 END AS generation FROM r""",
)
def generation_switch(spark, sf):
    return publish.generation_switch(derived(spark, sf, GEN_NOTES), derived(spark, sf, JOBS), 1, 2, "ACTIVE_INDEXED", "INDEXED")


@query(
    "curated_notes",
    f"""WITH {LIVE_SQL}, s AS (SELECT *, {sentence_sql()} AS line, array_to_string(list_transform(string_split(lower(replace(claim_type, '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS heading FROM c),
    g AS (SELECT note_id, heading, min(seq) AS first_seq, string_agg(line, chr(10) ORDER BY seq) AS ls FROM s GROUP BY 1, 2),
    b AS (SELECT note_id, string_agg('## ' || heading || chr(10) || chr(10) || ls, chr(10) || chr(10) ORDER BY first_seq) AS sections FROM g GROUP BY 1),
    n AS (SELECT note_id, arg_min(subject, seq) AS title, list(claim_id ORDER BY claim_id) AS ids, count(*) AS claims, max(CASE sensitivity WHEN 'PUBLIC' THEN 0 WHEN 'RESTRICTED' THEN 1 ELSE 2 END) AS strictest FROM s GROUP BY 1),
    t AS (SELECT note_id, title, '# ' || title || chr(10) || chr(10) || sections || chr(10) AS body, ids, claims, strictest FROM n JOIN b USING (note_id))
    SELECT note_id, title, body, claims, ['PUBLIC', 'RESTRICTED', 'PRIVATE'][strictest + 1] AS sensitivity, sha256(json_object('body', body, 'claim_ids', ids, 'title', title)::VARCHAR) AS content_hash FROM t""",
)
def curated_notes(spark, sf):
    return publish.curated_notes(_live(spark, sf))


GENERATIONS = "SELECT o_custkey AS collection, o_orderkey AS number, o_orderpriority AS manifest_hash, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'STAGING' ELSE 'ACTIVE' END AS status FROM {orders}"
WANTED = "SELECT c_custkey AS collection, '1-URGENT' AS manifest_hash FROM {customer}"


@query(
    "select_generation",
    f"""WITH g AS ({twin(GENERATIONS)}), u AS (SELECT collection, max(number) AS found FROM g WHERE status <> 'FAILED' AND manifest_hash = '1-URGENT' GROUP BY 1), l AS (SELECT collection, max(number) AS last FROM g GROUP BY 1)
    SELECT c_custkey AS collection, coalesce(found, coalesce(last, 0) + 1) AS number, found IS NULL AS created FROM customer LEFT JOIN u ON u.collection = c_custkey LEFT JOIN l ON l.collection = c_custkey""",
)
def select_generation(spark, sf):
    return publish.select_generation(derived(spark, sf, GENERATIONS), derived(spark, sf, WANTED))
