"""Queries over applied plans, extraction, publications and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import apply, robots, ingest, markdown
from ..sources.tables import table
from .base import derived, query, twin

PLAN = """SELECT CASE doc_id % 6 WHEN 0 THEN 'CREATED' WHEN 1 THEN 'DELETED' WHEN 2 THEN 'MOVED' WHEN 3 THEN 'UNCHANGED' ELSE 'UPDATED' END AS action, cast(floor(doc_id / 4) AS bigint) AS source_id, sha2(text, 256) AS content_hash,
  doc_id % 17 = 0 AS parse_error, doc_id % 13 = 0 AS unsafe, doc_id % 9 = 0 AS preserve_quarantine FROM {documents}"""
VERSIONS = "SELECT cast(floor(doc_id / 4) AS bigint) AS source_id, sha2(text, 256) AS content_hash, doc_id AS version_number, CASE WHEN n_chars % 4 = 0 THEN 'QUARANTINED' ELSE 'READY' END AS status FROM {documents} WHERE lang <> 'fr'"


@query(
    "item_outcomes",
    f"""WITH p AS ({twin(PLAN)}), v AS (SELECT source_id, content_hash, max(version_number) AS had FROM ({twin(VERSIONS)}) WHERE status = 'READY' GROUP BY 1, 2),
    r AS (SELECT p.*, had, CASE WHEN action = 'DELETED' THEN 'TOMBSTONED' WHEN action = 'MOVED' THEN 'RELOCATED' WHEN action = 'UNCHANGED' THEN CASE WHEN preserve_quarantine THEN 'QUARANTINE_KEPT' ELSE 'SKIPPED' END
      WHEN action = 'UPDATED' AND had IS NOT NULL THEN 'REACTIVATED' WHEN parse_error THEN 'PARSE_FAILED' WHEN unsafe THEN 'QUARANTINED' ELSE 'READY' END AS outcome FROM p LEFT JOIN v USING (source_id, content_hash))
    SELECT action, source_id, content_hash, outcome, CASE WHEN outcome = 'REACTIVATED' THEN had END AS version_number FROM r""",
)
def item_outcomes(spark, sf):
    return apply.item_outcomes(derived(spark, sf, PLAN), derived(spark, sf, VERSIONS))


DRAFTS = "SELECT o_custkey AS run_id, o_orderpriority AS fingerprint, o_orderkey AS position, o_orderkey * 10 AS draft_id FROM {orders}"
ACTIVE = "SELECT l_linenumber AS claim_id, o_orderpriority AS fingerprint FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey WHERE l_linenumber > 2 AND o_orderpriority LIKE '%E%'"


@query(
    "extraction_persist",
    f"""WITH d AS (SELECT run_id, fingerprint, min(position) AS position, arg_max(draft_id, position) AS draft_id, count(*) AS drafts FROM ({twin(DRAFTS)}) GROUP BY 1, 2), a AS (SELECT fingerprint, min(claim_id) AS claim_id FROM ({twin(ACTIVE)}) GROUP BY 1)
    SELECT run_id, fingerprint, position, draft_id, drafts, claim_id, claim_id IS NOT NULL AS reused FROM d LEFT JOIN a USING (fingerprint)""",
)
def extraction_persist(spark, sf):
    return apply.deduplicated_drafts(derived(spark, sf, DRAFTS), derived(spark, sf, ACTIVE))


ORIGINS = "SELECT doc_id AS claim_id, doc_id, 'paragraph:' || cast(doc_id % 5 + 1 AS string) AS anchor, doc_id % 11 AS start, doc_id % 300 AS stop FROM {documents}"
BLOCKS_SQL = "b AS (SELECT doc_id, 'paragraph:' || i AS anchor, length(t) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE t <> '')"


@query(
    "span_violations",
    f"""WITH {BLOCKS_SQL}, o AS ({twin(ORIGINS)}), r AS (SELECT claim_id, o.doc_id, o.anchor, CASE WHEN n IS NULL THEN 'NO_BLOCK' WHEN start < 0 OR start >= stop OR stop > n THEN 'SPAN' END AS problem FROM o LEFT JOIN b ON b.doc_id = o.doc_id AND b.anchor = o.anchor)
    SELECT * FROM r WHERE problem IS NOT NULL""",
)
def span_violations(spark, sf):
    return apply.span_violations(derived(spark, sf, ORIGINS), ingest.line_blocks(table(spark, sf, "documents")))


@query("snapshot_verify", "SELECT doc_id, 2::BIGINT * len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS rows FROM documents WHERE doc_id % 14 = 3")
def snapshot_verify(spark, sf):
    """Stored metadata of some documents are off by one ordinal."""
    parsed = ingest.line_blocks(table(spark, sf, "documents"))
    stored = parsed.withColumn("ordinal", F.when(F.col("doc_id") % 14 == 3, F.col("ordinal") + 100_000).otherwise(F.col("ordinal")))
    return apply.block_mismatches(stored, parsed)


RUNS = "SELECT c_custkey AS run_id FROM {customer}"
ARTEFACTS = """SELECT o_custkey AS run_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'staged' WHEN '2-HIGH' THEN 'indexed' WHEN '3-MEDIUM' THEN 'verified' WHEN '4-NOT SPECIFIED' THEN 'published' ELSE 'activated' END AS kind FROM {orders}"""


@query(
    "saga_resume",
    f"""WITH s AS (SELECT * FROM (VALUES (1, 'staged', 'CURATING'), (2, 'indexed', 'VAULT_STAGED'), (3, 'verified', 'INDEXING'), (4, 'published', 'INDEX_VERIFIED'), (5, 'activated', 'VAULT_PUBLISHED')) v(place, kind, before)),
    m AS (SELECT c_custkey AS run_id, min(place) AS place FROM customer CROSS JOIN s WHERE NOT EXISTS (SELECT 1 FROM ({twin(ARTEFACTS)}) a WHERE a.run_id = c_custkey AND a.kind = s.kind) GROUP BY 1)
    SELECT c_custkey AS run_id, coalesce(before, 'COMPLETED') AS status, coalesce(kind, 'NONE') AS next_stage FROM customer LEFT JOIN m ON m.run_id = c_custkey LEFT JOIN s ON s.place = m.place""",
)
def saga_resume(spark, sf):
    return apply.resume_points(derived(spark, sf, RUNS), derived(spark, sf, ARTEFACTS))


BUNDLES = "SELECT l_orderkey AS bundle_id, l_linenumber AS revision, CASE WHEN l_partkey % 40 = 0 THEN 0 ELSE l_linenumber END AS expected_revision, l_linestatus AS status, CASE WHEN l_suppkey % 50 = 0 THEN NULL ELSE l_linestatus END AS expected_status FROM {lineitem}"


@query("activation", f"SELECT bundle_id, bool_and(coalesce(revision = expected_revision AND status = expected_status, false)) AS activated, count(*) AS entities FROM ({twin(BUNDLES)}) GROUP BY bundle_id")
def activation(spark, sf):
    return apply.activations(derived(spark, sf, BUNDLES))


NOTES = "SELECT o_orderkey AS note_id, CASE WHEN o_orderkey % 3 = 0 THEN 'DELETE' ELSE 'RESTORE' END AS request, CASE WHEN o_orderkey % 4 = 1 THEN 5 END AS deleted_at, CASE o_orderkey % 5 WHEN 0 THEN 'ACTIVE_INDEXED' WHEN 1 THEN 'INDEXED' ELSE 'PENDING' END AS job_status FROM {orders}"


@query(
    "note_lifecycle",
    f"""SELECT note_id, request, CASE WHEN request = 'DELETE' THEN CASE WHEN deleted_at IS NOT NULL THEN 'ALREADY_DELETED' WHEN job_status = 'ACTIVE_INDEXED' THEN 'DELETE_PENDING' ELSE 'REFUSED' END
      ELSE CASE WHEN deleted_at IS NULL THEN 'NOT_DELETED' WHEN job_status = 'INDEXED' THEN 'RESTORED' ELSE 'REFUSED' END END AS outcome FROM ({twin(NOTES)})""",
)
def note_lifecycle(spark, sf):
    return apply.note_lifecycle(derived(spark, sf, NOTES))


HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1)"
#: A file for each host, of five kinds, and for one in seven none that can be read.
ROBOTS = f"""SELECT origin, CASE n % 7 WHEN 5 THEN 404 WHEN 6 THEN 403 WHEN 4 THEN 500 ELSE 200 END AS status,
  CASE n % 4 WHEN 0 THEN concat('# nothing', chr(10), 'Disallow: /', chr(10), 'User-Agent: *', chr(13), chr(10), 'Disallow: /en/ # not these', chr(10), 'Allow: /en/7', chr(10), 'Crawl-delay: 3')
    WHEN 1 THEN concat('User-agent: other', chr(10), 'USER-AGENT: Attestra', chr(10), 'disallow: /*/1', chr(10), 'allow: /*/11$', chr(10), chr(10), 'User-agent: *', chr(10), 'Disallow: /')
    WHEN 2 THEN concat('User-agent: *', chr(10), 'Disallow: /de', chr(10), 'Allow: /de', chr(10), 'Disallow: /es/*5$', chr(10), 'User-agent: attestra', chr(10), 'Disallow:')
    ELSE concat('User-agent: other', chr(10), 'Disallow: /', chr(10), 'User-agent: *', chr(10), 'Disallow: /*.html', chr(10), 'Disallow: /fr/', chr(10), 'Allow: /fr/(x)') END AS text
  FROM (SELECT origin, row_number() OVER (ORDER BY origin) AS n FROM (SELECT DISTINCT {HOST} AS origin FROM {{pages}})) WHERE origin <> ''"""


@query(
    "robots_verdict",
    rf"""WITH f AS ({twin(ROBOTS)}), u AS (SELECT page_id AS url_id, {HOST} AS origin, CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END AS path FROM pages),
    l AS (SELECT origin, generate_subscripts(string_split(text, chr(10)), 1) AS at_, trim(regexp_replace(rtrim(unnest(string_split(text, chr(10))), chr(13)), '#.*$', '')) AS line FROM f WHERE status BETWEEN 200 AND 299),
    k AS (SELECT origin, at_, lower(trim(split_part(line, ':', 1))) AS name, trim(regexp_replace(line, '^[^:]*:', '')) AS value FROM l WHERE lower(trim(split_part(line, ':', 1))) IN ('user-agent', 'allow', 'disallow')),
    b AS (SELECT *, (name = 'user-agent' AND coalesce(lag(name) OVER w, '') <> 'user-agent')::INT AS begins FROM k WINDOW w AS (PARTITION BY origin ORDER BY at_)),
    g AS (SELECT *, sum(begins) OVER (PARTITION BY origin ORDER BY at_) AS grp FROM b),
    a AS (SELECT DISTINCT origin, grp, lower(value) AS agent FROM g WHERE name = 'user-agent' AND grp > 0 AND lower(value) IN ('attestra', '*')),
    o AS (SELECT origin, bool_or(agent = 'attestra') AS own FROM a GROUP BY 1),
    r AS (SELECT DISTINCT g.origin, value AS rule, name = 'allow' AS allow, '^' || replace(regexp_replace(regexp_replace(value, '\$$', ''), '([\\.\[\]{{}}()+?^$|])', '\\\1', 'g'), '*', '.*') || CASE WHEN value LIKE '%$' THEN '$' ELSE '' END AS pattern
      FROM g JOIN a USING (origin, grp) JOIN o ON o.origin = g.origin AND (agent = 'attestra') = own WHERE name <> 'user-agent' AND value <> ''),
    m AS (SELECT url_id, arg_max(rule, length(rule) * 2 + allow::INT) AS rule, arg_max(allow, length(rule) * 2 + allow::INT) AS allow FROM u JOIN r ON r.origin = u.origin AND regexp_matches(path, pattern) GROUP BY 1)
    SELECT u.url_id, CASE WHEN status IS NULL THEN 'ERROR' WHEN status = 404 THEN 'ALLOW' WHEN status IN (401, 403) THEN 'DENY' WHEN status NOT BETWEEN 200 AND 299 THEN 'ERROR' WHEN coalesce(allow, true) THEN 'ALLOW' ELSE 'DENY' END AS verdict,
      CASE WHEN status BETWEEN 200 AND 299 THEN rule END AS rule FROM u LEFT JOIN f ON f.origin = u.origin LEFT JOIN m ON m.url_id = u.url_id""",
)
def robots_verdict(spark, sf):
    urls = derived(spark, sf, f"SELECT page_id AS url_id, {HOST} AS origin, {PATH} AS path FROM {{pages}}")
    return robots.robots_allowed(urls, derived(spark, sf, ROBOTS), "Attestra/1.0")


@query(
    "search_hits",
    r"""WITH p AS (SELECT 'r' || page_id // 100 AS request_id, url, min(page_id) AS place FROM pages WHERE starts_with(url, 'https://') GROUP BY 1, 2),
    k AS (SELECT request_id, url, row_number() OVER (PARTITION BY request_id ORDER BY place) - 1 AS rank FROM p)
    SELECT request_id, rank::INT AS rank, url, 'candidate_' || substr(sha256(request_id || chr(10) || rank || chr(10) || url), 1, 24) AS candidate_id FROM k WHERE rank < 4""",
)
def search_hits(spark, sf):
    request = F.concat(F.lit("r"), F.floor(F.col("page_id") / 100).cast("string"))
    return apply.first_hits(table(spark, sf, "pages").select(request.alias("request_id"), F.col("page_id").alias("place"), "url"), 4)


@query("metadata_redaction", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'k,n' WHEN event_id % 3 = 1 THEN 'n' ELSE 'n,user' END AS names FROM events")
def metadata_redaction(spark, sf):
    third = F.col("event_id") % 3
    name = F.when(third == 0, "k").when(third == 1, "My_API_KEY").otherwise("user")
    kept = F.map_keys(apply.redacted(F.create_map(name, "props", F.lit("n"), "props", F.lit("accessToken"), "props")))
    return table(spark, sf, "events").select("event_id", F.array_join(F.array_sort(kept), ",").alias("names"))


LEAKS = "SELECT doc_id, text || CASE doc_id % 30 WHEN 0 THEN ' sk-abcdefghijklmnopqrst' WHEN 1 THEN ' Bearer abcdefghijklmnopq' WHEN 2 THEN ' /home/someone/x' WHEN 3 THEN ' BEGIN RSA PRIVATE KEY' WHEN 4 THEN ' ghp_abcdefghijklmnopqrstu /Users/me' ELSE '' END AS text FROM {documents}"


@query(
    "privacy_findings",
    f"""WITH t AS ({twin(LEAKS)}) SELECT doc_id::VARCHAR AS path, 'api token' AS finding FROM t WHERE regexp_matches(text, '(^|[^A-Za-z0-9])sk-[A-Za-z0-9_-]{{16,}}') UNION ALL SELECT doc_id::VARCHAR, 'repository token' FROM t WHERE regexp_matches(text, 'gh[pousr]_[A-Za-z0-9]{{20,}}')
    UNION ALL SELECT doc_id::VARCHAR, 'bearer' FROM t WHERE regexp_matches(text, 'Bearer[ \\t]+[A-Za-z0-9._-]{{16,}}') UNION ALL SELECT doc_id::VARCHAR, 'private key' FROM t WHERE regexp_matches(text, 'BEGIN[ \\t]+(?:RSA[ \\t]+)?PRIVATE[ \\t]+KEY')
    UNION ALL SELECT doc_id::VARCHAR, 'unix user path' FROM t WHERE regexp_matches(text, '/(?:home|Users)/[^/\\s]+')""",
)
def privacy_findings(spark, sf):
    return apply.privacy_findings(derived(spark, sf, LEAKS).select(F.col("doc_id").cast("string").alias("path"), "text"))


@query(
    "markdown_blocks",
    """WITH l AS (SELECT doc_id, source, list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x: 'p ' || translate(x, '|^', '/-')) AS ls FROM documents),
    b AS (SELECT doc_id, 0 AS ordinal, 'heading' AS block_type, 'h1:' || source AS anchor, '# ' || source AS t FROM l
      UNION ALL SELECT doc_id, i, 'paragraph', 'h1:' || source || '/paragraph:' || i, ls[i] FROM l, unnest(range(1, len(ls) + 1)) r(i)
      UNION ALL SELECT doc_id, len(ls) + 1, 'list', 'h1:' || source || '/list:1', '- a' || chr(10) || '- b' FROM l UNION ALL SELECT doc_id, len(ls) + 2, 'heading', 'h1:' || source || '/h2:part two', '## Part  two' FROM l
      UNION ALL SELECT doc_id, len(ls) + 3, 'code_fence', 'h1:' || source || '/h2:part two/code_fence:1', '```' || chr(10) || '# no heading' || chr(10) || '```' FROM l)
    SELECT doc_id, ordinal::INT AS ordinal, block_type, anchor, sha256(t) AS text_hash, length(t) AS character_count FROM b""",
)
def markdown_blocks(spark, sf):
    """Notes made of all lines of a document as paragraphs, with headings, a list and a fence around them."""
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: x != ""), lambda x: F.concat(F.lit("p "), F.translate(x, "|^", "/-")))
    d = table(spark, sf, "documents")
    note = F.concat(F.lit("# "), F.col("source"), F.lit("\n\n"), F.array_join(lines, "\n\n"), F.lit("\n\n- a\n- b\n\n## Part  two\n```\n# no heading\n```\n"))
    return markdown.blocks(d.select("doc_id", note.alias("text"))).drop("error")
