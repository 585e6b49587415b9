"""Queries that check stored things: plans, evidence, excerpts, snapshots, notes, runs, generations."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import answer, publish, verify
from ..sources import html
from ..sources.tables import table
from .base import derived, query, twin
from .govern import EVIDENCE
from .publish import ACTUAL, EXPECTED

SCAN = "SELECT source || '/' || cast(n_chars AS string) AS path_key FROM {documents}"
SEEN = "SELECT lang || '/' || sha2(text, 256) AS path_key FROM {documents}"


@query(
    "plan_problems",
    f"""SELECT 'REPEATED_PATH' AS problem, path_key FROM ({twin(SCAN)}) GROUP BY path_key HAVING count(*) > 1 UNION ALL SELECT 'REPEATED_KNOWN_PATH', path_key FROM ({twin(SEEN)}) GROUP BY path_key HAVING count(*) > 1
    UNION ALL SELECT 'INCOMPLETE_MANIFEST', NULL WHERE EXISTS (SELECT 1 FROM events WHERE event_type = 'error')""",
)
def plan_problems(spark, sf):
    """A scan is complete when no error was logged."""
    complete = table(spark, sf, "events").agg((~F.bool_or(F.col("event_type") == "error")).alias("complete"))
    return verify.plan_problems(derived(spark, sf, SCAN), derived(spark, sf, SEEN), complete)


HITS = "SELECT l_orderkey AS query_id, cast(l_partkey AS string) AS chunk_id, o_custkey AS note_id, l_orderkey AS version_id, l_linenumber % 2 AS generation, array(l_suppkey, l_suppkey + 1) AS claim_ids FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey"
HIT_NOTES = "SELECT o_custkey AS note_id, o_orderkey AS version_id, 1 AS generation, CASE WHEN o_orderpriority = '5-LOW' THEN 1 END AS deleted_at, 'notes/' || cast(o_custkey AS string) || '.md' AS path FROM {orders}"
HIT_VERSIONS = "SELECT o_orderkey AS version_id, CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status, 'h' || cast(o_orderkey AS string) AS content_hash FROM {orders}"
ARTIFACTS = "SELECT 'h' || cast(o_orderkey AS string) AS content_hash, o_custkey AS note_id, o_orderkey AS version_id, min(l_suppkey) AS a, max(l_suppkey) AS b FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY 1, 2, 3"


@query(
    "evidence_lineage",
    f"""WITH h AS (SELECT *, l_suppkey AS x FROM (SELECT l_orderkey AS query_id, l_partkey::VARCHAR AS chunk_id, o_custkey AS note_id, l_orderkey AS version_id, l_linenumber % 2 AS generation, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey))
    SELECT query_id, chunk_id, h.note_id, h.version_id, path FROM h JOIN ({twin(HIT_NOTES)}) n ON n.note_id = h.note_id AND n.version_id = h.version_id AND n.generation = h.generation AND n.deleted_at IS NULL
      JOIN ({twin(HIT_VERSIONS)}) v ON v.version_id = h.version_id AND v.status = 'ACTIVE' JOIN ({twin(ARTIFACTS)}) a ON a.content_hash = v.content_hash AND a.note_id = h.note_id AND a.version_id = h.version_id
    WHERE x BETWEEN a.a AND a.b + 1 AND x + 1 BETWEEN a.a AND a.b + 1""",
)
def evidence_lineage(spark, sf):
    """Artifacts hold all claims between their least and their greatest."""
    artifacts = derived(spark, sf, ARTIFACTS).withColumn("claim_runs", F.array(F.struct(F.col("a").alias("first"), (F.col("b") + 1).alias("last")))).drop("a", "b")
    return verify.located_evidence(derived(spark, sf, HITS), derived(spark, sf, HIT_NOTES), derived(spark, sf, HIT_VERSIONS), artifacts)


CANDIDATES = "SELECT doc_id AS candidate_id, doc_id + CASE WHEN n_chars % 31 = 0 THEN 100000000 ELSE 0 END AS source_version, lang AS anchor, CASE WHEN n_chars % 17 = 0 THEN sha2(source, 256) ELSE sha2(text, 256) END AS excerpt_hash FROM {documents}"


@query("excerpt_problems", "SELECT doc_id AS candidate_id, CASE WHEN n_chars % 31 = 0 THEN 'MISSING' ELSE 'HASH' END AS problem FROM documents WHERE n_chars % 31 = 0 OR (n_chars % 17 = 0 AND sha256(source) <> sha256(text))")
def excerpt_problems(spark, sf):
    blocks = table(spark, sf, "documents").select(F.col("doc_id").alias("source_version"), F.col("lang").alias("anchor"), "text")
    return verify.excerpt_problems(derived(spark, sf, CANDIDATES), blocks)


STORED = "SELECT sha2(text, 256) AS content_hash, CASE WHEN n_chars % 19 = 0 THEN source ELSE text END AS text FROM {documents}"


@query(
    "snapshot_problems",
    f"""SELECT content_hash, CASE WHEN count(DISTINCT text) > 1 THEN 'COLLISION' ELSE 'HASH' END AS problem FROM ({twin(STORED)}) GROUP BY content_hash HAVING count(DISTINCT text) > 1 OR min(sha256(text)) <> content_hash""",
)
def snapshot_problems(spark, sf):
    return verify.snapshot_problems(derived(spark, sf, STORED))


PLANNED = "SELECT o_custkey AS note_id, l_partkey AS claim_id FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R'"
GOVERNED = "SELECT DISTINCT o_custkey AS note_id, l_partkey AS claim_id FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_linestatus = 'F'"


@query(
    "curation_problems",
    f"""WITH p AS (SELECT note_id, claim_id, count(*) AS times FROM ({twin(PLANNED)}) GROUP BY 1, 2), c AS ({twin(GOVERNED)})
    SELECT note_id, claim_id, 'MISSING' AS problem FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.note_id = c.note_id AND p.claim_id = c.claim_id)
    UNION ALL SELECT note_id, claim_id, CASE WHEN NOT EXISTS (SELECT 1 FROM c WHERE p.note_id = c.note_id AND p.claim_id = c.claim_id) THEN 'UNKNOWN' ELSE 'REPEATED' END FROM p
    WHERE times > 1 OR NOT EXISTS (SELECT 1 FROM c WHERE p.note_id = c.note_id AND p.claim_id = c.claim_id)""",
)
def curation_problems(spark, sf):
    return verify.curation_problems(derived(spark, sf, PLANNED), derived(spark, sf, GOVERNED))


BODIES = "SELECT doc_id AS note_id, text || CASE WHEN n_chars % 23 = 0 THEN ' <IFRAME src=x>' WHEN n_chars % 29 = 0 THEN ' ![a](http://b)' WHEN n_chars % 37 = 0 THEN ' [a](data:b)' WHEN n_chars % 41 = 0 THEN ' ![a](b.png) <scripts>' ELSE '' END AS body, n_chars, source FROM {documents}"


@query(
    "note_problems",
    f"""WITH b AS ({twin(BODIES)}) SELECT note_id, CASE WHEN n_chars % 43 = 0 THEN 'HASH_MISSING' WHEN n_chars % 13 = 0 THEN 'HASH' WHEN source = 'src2' THEN 'EXPECTED' ELSE 'UNSAFE' END AS problem FROM b
    WHERE n_chars % 43 = 0 OR n_chars % 13 = 0 OR source = 'src2' OR n_chars % 23 = 0 OR n_chars % 29 = 0 OR n_chars % 37 = 0""",
)
def note_problems(spark, sf):
    notes = derived(spark, sf, BODIES).withColumn("own_hash", F.sha2("body", 256))
    said = F.when(F.col("n_chars") % 43 == 0, None).when(F.col("n_chars") % 13 == 0, F.sha2("source", 256)).otherwise(F.col("own_hash"))
    notes = notes.withColumn("content_hash", said)
    expected = notes.select("note_id", F.when(F.col("source") == "src2", F.lit("other")).otherwise(F.col("content_hash")).alias("content_hash"))
    return verify.note_problems(notes, expected)


ITEMS = "SELECT l_orderkey AS run_id, CASE WHEN l_quantity > 48 THEN 'PENDING' WHEN l_returnflag = 'R' AND l_tax > 0.06 THEN 'QUARANTINED' WHEN l_discount > 0.09 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status FROM {lineitem}"


@query(
    "run_outcomes",
    f"""WITH i AS ({twin(ITEMS)}) SELECT run_id, count(*) AS items, CASE WHEN count(*) FILTER (status = 'PENDING') > 0 THEN 'UNFINISHED' WHEN count(*) FILTER (status IN ('FAILED', 'QUARANTINED')) > 0 THEN 'PARTIAL_FAILED' ELSE 'COMPLETED' END AS outcome FROM i GROUP BY run_id""",
)
def run_outcomes(spark, sf):
    return verify.run_outcomes(derived(spark, sf, ITEMS))


PACKED = "SELECT cast(floor(o_orderkey / 15) AS bigint) AS claim_id, o_orderkey AS candidate_id, o_orderpriority <> '5-LOW' AS complete FROM {orders}"
METRIC_SQL = f"""m AS (SELECT claim_id, max(coverage) AS a, CASE WHEN bool_or(tier IN ('T1', 'T2')) THEN 1.0 ELSE 0.4 END::DOUBLE AS b, least(count(DISTINCT family) / 2, 1)::DOUBLE AS c,
      CASE WHEN bool_or(tier IN ('T1', 'T2')) THEN CASE WHEN bool_or(tier IN ('T1', 'T2') AND stance = 'SUPPORT') AND bool_or(tier IN ('T1', 'T2') AND stance = 'CONTRADICT') THEN 0.0 ELSE 1.0 END END::DOUBLE AS d,
      avg(freshness_match::INT) AS e, avg(version_match::INT) AS f, CASE WHEN count(DISTINCT stance) FILTER (tier IN ('T1', 'T2')) <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS h FROM ({twin(EVIDENCE)}) GROUP BY 1),
    g AS (SELECT claim_id, avg(complete::INT) AS g FROM ({twin(PACKED)}) GROUP BY 1), r AS (SELECT coalesce(m.claim_id, g.claim_id) AS claim_id, a, b, c, d, e, f, g, h FROM m FULL JOIN g ON m.claim_id = g.claim_id)"""
_METRICS = (("a", "evidence_coverage", "0.95"), ("b", "source_reliability", "0.8"), ("c", "source_independence", "1"), ("d", "source_agreement", "1"), ("e", "freshness", "1"), ("f", "version_match", "1"), ("g", "extraction_quality", "1"), ("h", "verifier_agreement", "1"))


@query(
    "quality_metrics",
    f"WITH {METRIC_SQL} " + " UNION ALL ".join(f"SELECT claim_id, '{name}' AS metric, CASE WHEN {c} IS NULL THEN '{'NOT_APPLICABLE' if c in 'ef' else 'UNKNOWN'}' WHEN {c} >= {at} THEN 'PASS' ELSE 'FAIL' END AS state, round({c}, 9) AS score FROM r" for c, name, at in _METRICS),
)
def quality_metrics(spark, sf):
    return verify.quality_metrics(derived(spark, sf, EVIDENCE), derived(spark, sf, PACKED)).withColumn("score", F.round("score", 9))


VERIFIED = "SELECT cast(floor(o_orderkey / 15) AS bigint) AS claim_id, CASE WHEN o_orderstatus = 'P' THEN -1 - o_orderkey ELSE o_orderkey END AS candidate_id FROM {orders}"


@query("verification_gaps", "SELECT (o_orderkey // 15)::BIGINT AS claim_id, o_orderkey AS candidate_id, 'NOT_VERIFIED' AS gap FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey // 15, -1 - o_orderkey, 'NOT_PACKED' FROM orders WHERE o_orderstatus = 'P'")
def verification_gaps(spark, sf):
    return verify.verification_gaps(derived(spark, sf, PACKED), derived(spark, sf, VERIFIED))


OPERATIONS = "SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'IN_PROGRESS' WHEN 'MACHINERY' THEN 'UNKNOWN' WHEN 'AUTOMOBILE' THEN 'SUCCEEDED' WHEN 'FURNITURE' THEN 'IN_PROGRESS' ELSE 'FAILED' END AS status, c_nationkey % 3 AS revision FROM {customer}"
ENDINGS = "SELECT o_orderkey AS request_id, CASE WHEN o_totalprice > 400000 THEN -1 - o_custkey ELSE o_custkey END AS id, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'FAILED' ELSE 'UNKNOWN' END AS target, o_orderkey % 3 AS expected_revision, o_orderpriority = '1-URGENT' AS reconcile FROM {orders}"


@query(
    "finish_decisions",
    f"""WITH d AS (SELECT request_id, e.id, target, revision, CASE WHEN status IS NULL THEN 'NOT_FOUND' WHEN revision <> expected_revision THEN 'STALE' WHEN status = 'UNKNOWN' AND NOT reconcile THEN 'NEEDS_RECONCILING'
      WHEN (status = 'IN_PROGRESS') OR (status = 'UNKNOWN' AND target <> 'UNKNOWN') THEN 'APPLIED' ELSE 'ILLEGAL' END AS outcome FROM ({twin(ENDINGS)}) e LEFT JOIN ({twin(OPERATIONS)}) o ON o.id = e.id),
    k AS (SELECT *, row_number() OVER (PARTITION BY id, outcome ORDER BY request_id) AS place FROM d)
    SELECT request_id, id, target, CASE WHEN outcome = 'APPLIED' AND place > 1 THEN 'STALE' ELSE outcome END AS outcome, CASE WHEN outcome = 'APPLIED' AND place = 1 THEN revision + 1 END AS next_revision FROM k""",
)
def finish_decisions(spark, sf):
    return verify.finish_decisions(derived(spark, sf, OPERATIONS), derived(spark, sf, ENDINGS))


FILES = "SELECT 'n' || cast(doc_id AS string) AS path, doc_id % 5 AS version_id, CASE WHEN n_chars % 7 = 0 THEN sha2(source, 256) ELSE sha2(text, 256) END AS content_hash FROM {documents} WHERE source <> 'src9'"
PUBLICATIONS = "SELECT 'n' || cast(doc_id AS string) AS path, CASE WHEN lang <> 'de' THEN doc_id % 5 END AS base_version, CASE WHEN lang <> 'de' THEN sha2(text, 256) END AS base_hash, doc_id % 5 + CASE WHEN lang = 'fr' THEN 0 ELSE 1 END AS version_id, sha2(text, 256) AS content_hash FROM {documents}"


@query(
    "vault_decisions",
    f"""SELECT p.path, CASE WHEN f.path IS NULL AND base_version IS NULL THEN 'CREATE' WHEN f.path IS NULL THEN 'CONFLICT' WHEN f.version_id = p.version_id AND f.content_hash = p.content_hash THEN 'NOOP'
      WHEN f.version_id IS NOT DISTINCT FROM base_version AND f.content_hash IS NOT DISTINCT FROM base_hash THEN 'REPLACE' ELSE 'CONFLICT' END AS decision FROM ({twin(PUBLICATIONS)}) p LEFT JOIN ({twin(FILES)}) f ON f.path = p.path""",
)
def vault_decisions(spark, sf):
    return verify.vault_decisions(derived(spark, sf, FILES), derived(spark, sf, PUBLICATIONS))


@query(
    "generation_problems",
    """SELECT vec_id AS id, CASE WHEN label = 3 THEN 'DIMENSION' WHEN label = 4 THEN 'ZERO' ELSE 'MODEL' END AS problem FROM embeddings WHERE label IN (3, 4, 5)""",
)
def generation_problems(spark, sf):
    """Vectors of some labels are cut short, emptied, or come from another model."""
    e, v = table(spark, sf, "embeddings"), F.col("embedding").cast("array<double>")
    vector = F.when(F.col("label") == 3, F.slice(v, 1, 63)).when(F.col("label") == 4, F.transform(v, lambda x: F.lit(0.0))).otherwise(v)
    return verify.generation_problems(e.select(F.col("vec_id").alias("id"), vector.alias("vector"), F.when(F.col("label") == 5, "b").otherwise("a").alias("model")), 64)


KNOWN_FAMILIES = "SELECT c_name AS family, 'family_' || cast(c_custkey AS string) AS id FROM {customer} WHERE c_acctbal > 2000"
WANTED_FAMILIES = "SELECT c_name AS family FROM {customer} JOIN {orders} ON o_custkey = c_custkey"


@query(
    "find_or_create",
    f"""SELECT DISTINCT w.family, coalesce(k.id, 'new_' || substr(sha256(w.family), 1, 24)) AS id, k.id IS NULL AS created FROM ({twin(WANTED_FAMILIES)}) w LEFT JOIN ({twin(KNOWN_FAMILIES)}) k ON k.family = w.family""",
)
def find_or_create(spark, sf):
    return verify.find_or_create(derived(spark, sf, KNOWN_FAMILIES), derived(spark, sf, WANTED_FAMILIES), "family")


@query("index_repair", f"SELECT * FROM ({twin(EXPECTED)})")
def index_repair(spark, sf):
    """After the repair the index is what is expected."""
    expected, actual = derived(spark, sf, EXPECTED), derived(spark, sf, ACTUAL)
    return verify.repaired(actual, expected, publish.probe_drift(expected, actual))


@query("redacted_ids", "SELECT c_custkey, 'customer_…' || right('customer_' || lpad(c_custkey::VARCHAR, 9, '0'), 4) AS redacted, '…' AS bare FROM customer")
def redacted_ids(spark, sf):
    id_ = F.concat(F.lit("customer_"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    return table(spark, sf, "customer").select("c_custkey", verify.redacted_id(id_).alias("redacted"), verify.redacted_id(F.col("c_custkey").cast("string")).alias("bare"))


#: Blanks of many kinds around, line ends of both kinds inside, and now and then a control character.
ODD = "'\u00a0' || chr(9) || replace(text, chr(10), '\u2003 ' || chr(13) || chr(10)) || '\u3000' || chr(10) || chr(28)"
QUESTIONS = f"SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN {ODD} WHEN 1 THEN '\u202f\u0085' WHEN 2 THEN chr(32) || text || chr(7) || role ELSE text END AS q FROM {{conversations}}"
BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' ' || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"


@query("safe_questions", f"WITH q AS (SELECT conv_id, turn, trim(q, {BLANKS}) AS t FROM ({twin(QUESTIONS)})) SELECT conv_id, turn, CASE WHEN t <> '' AND NOT regexp_matches(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') THEN t END AS question, CASE WHEN t <> '' AND NOT regexp_matches(t, '[\\x00-\\x08\\x0a-\\x1f\\x7f]') THEN t END AS line FROM q")
def safe_questions(spark, sf):
    return derived(spark, sf, QUESTIONS).select("conv_id", "turn", verify.safe_question(F.col("q")).alias("question"), verify.single_line(F.col("q")).alias("line"))


@query("chunk_forms", f"WITH q AS (SELECT doc_id, {ODD} AS q FROM documents) SELECT doc_id, sha256(trim(array_to_string(list_transform(string_split(replace(q, chr(13) || chr(10), chr(10)), chr(10)), lambda l: rtrim(l, {BLANKS})), chr(10)), {BLANKS})) AS form FROM q")
def chunk_forms(spark, sf):
    rough = derived(spark, sf, f"SELECT doc_id, {ODD} AS q FROM {{documents}}")
    return rough.select("doc_id", F.sha2(verify.chunk_form(F.col("q")), 256).alias("form"))


@query("header_digest", """SELECT event_id, sha256(CASE WHEN event_id % 3 = 0 THEN '{}' ELSE '{"content-type":"' || sha256(event_type) || '"' || CASE WHEN event_id % 5 = 0 THEN '' ELSE ',"etag":"' || sha256(props) || '"' END || '}' END) AS digest FROM events""")
def header_digest(spark, sf):
    """Only the listed headers count, whatever their case and order; some rows have none of them."""
    e, text = table(spark, sf, "events"), F.lit(None).cast("string")
    headers = F.create_map(F.lit("X-Trace"), F.col("event_id").cast("string"), F.lit("ETag"), F.when((F.col("event_id") % 5 == 0) | (F.col("event_id") % 3 == 0), text).otherwise(F.col("props")), F.lit("Content-Type"), F.when(F.col("event_id") % 3 == 0, text).otherwise(F.col("event_type")))
    return e.select("event_id", verify.header_digest(headers).alias("digest"))


@query(
    "public_evidence",
    "SELECT doc_id, lang = 'en' AND source IN ('src1', 'src3') AS needed FROM documents",
)
def public_evidence(spark, sf):
    kind = F.when(F.col("source") == "src1", "FACT").when(F.col("source") == "src3", "PROCEDURE").otherwise("OPINION")
    return table(spark, sf, "documents").select("doc_id", verify.needs_public_evidence(kind, F.when(F.col("lang") == "en", "PUBLIC").otherwise("PRIVATE")).alias("needed"))


@query(
    "derived_ids",
    """SELECT doc_id, 'evidence_candidate_' || substr(sha256(doc_id || ':' || n_chars), 1, 24) AS candidate_id, 'ingop_' || sha256(source || ':' || doc_id || ':1') AS operation_id,
      CASE WHEN lang <> 'en' THEN sha256(n_chars || ':' || doc_id) END AS file_key FROM documents""",
)
def derived_ids(spark, sf):
    d, inode = table(spark, sf, "documents"), F.when(F.col("lang") != "en", F.col("doc_id"))
    ids = hashing.candidate_id(F.col("doc_id").cast("string"), F.col("n_chars")), hashing.item_operation_id(F.col("source"), F.col("doc_id").cast("string")), hashing.file_key(F.col("n_chars"), inode)
    return d.select("doc_id", *(i.alias(n) for i, n in zip(ids, ("candidate_id", "operation_id", "file_key"), strict=True)))


@query("block_forms", "SELECT doc_id, sha256(regexp_replace(regexp_replace(nfc_normalize(text), '[ \\t]+(\\n|$)', '\\1', 'g'), '^\\n+|\\n+$', '', 'g')) AS form FROM documents")
def block_forms(spark, sf):
    """Texts as they come from another system: carriage returns, blanks at line ends and empty lines around them go."""
    apart = F.col("text")
    for letter in "éüßñàö":  # letters and their accents as characters of their own
        apart = F.replace(apart, F.lit(letter), F.lit(unicodedata.normalize("NFD", letter)))
    rough = F.concat(F.lit("\r\n\n"), F.replace(apart, F.lit("\n"), F.lit(" \t\r\n")), F.lit("  \r"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.block_text(rough), 256).alias("form"))


@query("path_spellings", "SELECT doc_id, sha256(lower(path)) AS key, path AS vault FROM (SELECT doc_id, 'Bücher/' || source || '/Café ' || lang || doc_id || '.md' AS path FROM documents)")
def path_spellings(spark, sf):
    """Paths from a file system that writes accents apart have the keys of those that don't."""
    letters = F.lit("Bücher/"), F.lit("/Café ")
    path = F.concat(letters[0], "source", letters[1], "lang", F.col("doc_id").cast("string"), F.lit(".md"))
    for letter in "éü":
        path = F.when(F.col("doc_id") % 2 == 0, F.replace(path, F.lit(letter), F.lit(unicodedata.normalize("NFD", letter)))).otherwise(path)
    rows = table(spark, sf, "documents").select("doc_id", path.alias("path"))
    return rows.select("doc_id", hashing.path_key(F.col("path")).alias("key"), text.vault_path(F.col("path")).alias("vault"))


@query("citation_links", "SELECT doc_id, '[[' || source || '/a\\|' || doc_id || '#' || lang || ' / C\\#\\]]]' AS link FROM documents")
def citation_links(spark, sf):
    path = F.concat(F.col("source"), F.lit("/a|"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf, "documents").select("doc_id", answer.citation_link(path, F.array("lang", F.lit("C#]"))).alias("link"))


ACTIVE_NOTES = "SELECT o_orderkey AS note_id, o_custkey % 3 AS generation, CASE WHEN o_orderpriority = '5-LOW' THEN 1 END AS deleted_at, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS version_id FROM {orders}"


@query("active_notes", f"SELECT note_id, version_id FROM ({twin(ACTIVE_NOTES)}) WHERE deleted_at IS NULL AND version_id IS NOT NULL AND generation = 1 ORDER BY note_id")
def active_notes(spark, sf):
    return verify.active_notes(derived(spark, sf, ACTIVE_NOTES), 1)


@query("token_totals", "SELECT doc_id % 7 AS model, count(*) AS runs, sum(n_chars)::BIGINT AS tokens_in, sum(length(lang))::BIGINT AS tokens_out, sum(n_chars + length(lang))::BIGINT AS tokens FROM documents GROUP BY 1")
def token_totals(spark, sf):
    runs = table(spark, sf, "documents").select((F.col("doc_id") % 7).alias("model"), F.col("n_chars").alias("tokens_in"), F.length("lang").cast("long").alias("tokens_out"))
    return verify.token_totals(runs, ["model"])


@query("set_digests", "SELECT source, count(DISTINCT lang) AS members, sha256('[' || string_agg(DISTINCT '\"' || lang || '\"', ',' ORDER BY '\"' || lang || '\"') || ']') AS digest FROM documents GROUP BY source")
def set_digests(spark, sf):
    return verify.set_digests(table(spark, sf, "documents"), "source", "lang")


ORIGINS = "SELECT page_id, 'https://h' || cast(page_id % 9 AS string) || '.test/p' AS url, CASE page_id % 4 WHEN 0 THEN 'https://h' || cast(page_id % 9 AS string) || '.test/other' WHEN 1 THEN 'https://elsewhere.test/p' WHEN 2 THEN '/p' END AS link FROM {pages}"


@query("canonical_origins", f"SELECT page_id, CASE WHEN link LIKE 'https://elsewhere%' THEN 'canonical_origin_mismatch' END AS signal FROM ({twin(ORIGINS)})")
def canonical_origins(spark, sf):
    """Pages that name another host as their origin are no evidence of their own."""
    rows = derived(spark, sf, ORIGINS)
    page = F.concat(F.lit("<head>"), F.coalesce(F.concat(F.lit("<link rel='canonical' href='"), "link", F.lit("'>")), F.lit("")), F.lit("</head>"))
    return rows.select("page_id", verify.canonical_signal(F.col("url"), html.canonical_link(page)).alias("signal"))


LIVE = "SELECT doc_id AS note_id, 'v1' AS version_id, CASE WHEN doc_id % 7 = 0 THEN 'edited' ELSE sha2(text, 256) END AS content_hash FROM {documents} WHERE doc_id % 4 <> 0"
TRASH = "SELECT doc_id AS note_id, CASE WHEN doc_id % 11 = 0 THEN 'v0' ELSE 'v1' END AS version_id, sha2(text, 256) AS content_hash FROM {documents} WHERE doc_id % 4 = 0 AND doc_id % 5 <> 0 OR doc_id % 9 = 0"
MOVE = "SELECT doc_id AS note_id, CASE WHEN doc_id % 3 = 0 THEN 'RESTORE' ELSE 'RECYCLE' END AS request, 'v1' AS version_id, sha2(text, 256) AS content_hash FROM {documents}"


@query(
    "recycle_decisions",
    f"""WITH r AS (SELECT m.note_id, request, CASE request WHEN 'RECYCLE' THEN l.version_id || l.content_hash ELSE t.version_id || t.content_hash END AS here, CASE request WHEN 'RECYCLE' THEN t.version_id || t.content_hash ELSE l.version_id || l.content_hash END AS there, m.version_id || m.content_hash AS wanted
      FROM ({twin(MOVE)}) m LEFT JOIN ({twin(LIVE)}) l USING (note_id) LEFT JOIN ({twin(TRASH)}) t USING (note_id))
    SELECT note_id, request, CASE WHEN here IS NULL AND there IS NULL THEN 'MISSING' WHEN here IS NULL THEN CASE WHEN there = wanted THEN 'NOOP' ELSE 'CONFLICT' END WHEN there IS NOT NULL OR here <> wanted THEN 'CONFLICT' ELSE 'MOVE' END AS decision FROM r""",
)
def recycle_decisions(spark, sf):
    return verify.recycle_decisions(derived(spark, sf, LIVE), derived(spark, sf, TRASH), derived(spark, sf, MOVE))


GATES = """SELECT l_orderkey * 10 + l_linenumber AS gate_id, CASE WHEN l_linenumber = 5 THEN 'live' WHEN l_linenumber <> 6 THEN 'deterministic' END AS mode, CASE WHEN l_suppkey % 3 = 0 THEN 'g1' ELSE 'g2' END AS generation_id, l_tax < 0.08 AS passed,
  0.9 + l_tax AS precision, 0.85 + l_discount AS recall, CASE WHEN l_quantity > 45 THEN 0.5 WHEN l_quantity > 40 THEN NULL ELSE 1.0 END AS refusal_accuracy, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS unsafe FROM {lineitem}"""


@query(
    "promotion_gates",
    f"""SELECT gate_id, CASE WHEN mode IS NULL OR mode <> 'deterministic' OR refusal_accuracy IS NULL THEN 'INVALID' WHEN NOT (passed AND precision >= 0.95 AND recall >= 0.9 AND refusal_accuracy = 1 AND unsafe = 0) THEN 'FAILED' WHEN generation_id <> 'g2' THEN 'OTHER' END AS problem FROM ({twin(GATES)})""",
)
def promotion_gates(spark, sf):
    return verify.gate_problems(derived(spark, sf, GATES), "g2")
