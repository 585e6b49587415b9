"""Queries over evidence and verdicts, on pages and documents as sources."""

from __future__ import annotations

import html as html_rules
from html import entities

from pyspark.sql import functions as F

from ..functions import hashing, urls
from ..operators import govern
from ..sources import html
from ..sources.tables import table
from .base import derived, query, twin

URLS = "SELECT page_id, CASE page_id % 9 WHEN 0 THEN replace(url, '://', '://user:pw@') WHEN 1 THEN replace(url, '.example.', '.internal.') WHEN 2 THEN replace(replace(url, '.com/', '.com:443/'), '.org/', '.org:8443/') WHEN 3 THEN upper(url) WHEN 4 THEN 'https://' || CASE page_id % 4 WHEN 0 THEN '10.1.2.3' WHEN 1 THEN '172.20.0.1' WHEN 2 THEN '8.8.4.4' ELSE '[2001:db8::1]' END || '/x' ELSE url END AS url FROM {pages}"
_HOST = "rtrim(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^[^@]*@', ''), ':[0-9]*$', '')), '.')"
_PORT = "regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':([0-9]+)$', 1)"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '^[^?#]*([?][^#]*)', 1)"
URL_SQL = f"""u AS (SELECT page_id, url, {_HOST} AS host, {_PORT} AS port, {_PATH} AS path, {_QUERY} AS q FROM ({twin(URLS)})),
  s AS (SELECT *, lower(url) LIKE 'https://%' AND host <> '' AND regexp_extract(url, '://([^/?#]*)', 1) NOT LIKE '%@%' AND port IN ('', '443')
    AND host <> 'localhost' AND host NOT LIKE '%.local' AND host NOT LIKE '%.localhost' AND host NOT LIKE '%.internal' AND NOT regexp_matches(host, '{urls.PRIVATE_QUADS}') AND host NOT LIKE '[%' AS good FROM u)"""


@query("url_normalize", f"WITH {URL_SQL} SELECT page_id, CASE WHEN good THEN 'https://' || host || CASE WHEN port <> '' THEN ':' || port ELSE '' END || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '?' THEN '' ELSE q END END AS url FROM s")
def url_normalize(spark, sf):
    return derived(spark, sf, URLS).select("page_id", urls.public_https(F.col("url")).alias("url"))


FIRST, SECOND = ("thther.example.org", "example.com"), ("example.net", "blog.thther.example.org")
_IN = lambda ds: " OR ".join(f"host = '{d}' OR host LIKE '%.{d}'" for d in ds)


@query(
    "evidence_family",
    f"WITH {URL_SQL} SELECT 'https://' || host || CASE WHEN port NOT IN ('', '443') THEN ':' || port ELSE '' END AS family, CASE WHEN {_IN(FIRST)} THEN 'T1' WHEN {_IN(SECOND)} THEN 'T2' ELSE 'T4' END AS tier, count(*) AS pages FROM s GROUP BY 1, 2",
)
def evidence_family(spark, sf):
    u = derived(spark, sf, URLS)
    return u.groupBy(urls.family_origin(F.col("url")).alias("family"), urls.trust_tier(F.col("url"), FIRST, SECOND).alias("tier")).agg(F.count("*").alias("pages"))


HITS = "SELECT CASE WHEN page_id % 2 = 0 THEN 'SUPPORT' ELSE 'CHALLENGE' END AS intent, 'https://h' || cast(page_id % 40 AS string) || '/x' AS url, page_id AS rank, page_id FROM {pages}"


@query("hit_dedup", f"SELECT intent, url, min(rank) AS rank, arg_min(page_id, rank) AS page_id FROM ({twin(HITS)}) GROUP BY 1, 2")
def hit_dedup(spark, sf):
    return govern.first_hits(derived(spark, sf, HITS))


MATERIALS = """SELECT o_custkey AS claim_id, o_orderkey AS source_version, CASE o_orderkey % 6 WHEN 0 THEN 'T0' WHEN 1 THEN 'T1' WHEN 2 THEN 'T2' WHEN 3 THEN 'T3' WHEN 4 THEN 'T4' ELSE 'T5' END AS tier,
  o_orderkey % 4 AS rank, 'f' || cast(o_orderkey % 7 AS string) AS family, 'u' || cast(o_orderkey AS string) AS url, cast(o_orderkey % 4 + 1 AS int) AS blocks FROM {orders}"""
PACK_SQL = f"""m AS (SELECT *, CASE tier WHEN 'T1' THEN 0 WHEN 'T2' THEN 1 WHEN 'T0' THEN 2 WHEN 'T3' THEN 3 WHEN 'T4' THEN 4 ELSE 5 END AS t FROM ({twin(MATERIALS)})),
  f AS (SELECT *, row_number() OVER (PARTITION BY claim_id, family ORDER BY t, rank, family, url) > 1 AS again FROM m),
  p AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY again, t, rank, family, url) AS place FROM f),
  w AS (SELECT *, max(place > 8 OR blocks > 2) OVER (PARTITION BY claim_id) AS truncated FROM p),
  b AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY place, block) AS position FROM (SELECT *, unnest(range(1, least(blocks, 2) + 1)) AS block FROM w WHERE place <= 8))"""


@query("evidence_pack", f"WITH {PACK_SQL} SELECT claim_id, position::INT AS position, source_version, tier, family, block::INT AS block, truncated FROM b WHERE position <= 16")
def evidence_pack(spark, sf):
    return govern.evidence_pack(derived(spark, sf, MATERIALS))


@query("independence", f"WITH m AS ({twin(MATERIALS)}) SELECT claim_id, source_version, round(1.0 / count(*) OVER (PARTITION BY claim_id, family), 9) AS independence FROM m")
def independence(spark, sf):
    return govern.independence(derived(spark, sf, MATERIALS)).select("claim_id", "source_version", F.round("independence", 9).alias("independence"))


CLAIMS = """SELECT doc_id AS claim_id, source, lang,
  CASE doc_id % 9 WHEN 0 THEN 'FACT' WHEN 1 THEN 'OPINION' WHEN 2 THEN 'PREFERENCE' WHEN 3 THEN 'CODE_BEHAVIOR' WHEN 4 THEN 'DECISION' WHEN 5 THEN 'PREDICTION' WHEN 6 THEN 'DEFINITION' ELSE 'FACT' END AS claim_type,
  CASE WHEN doc_id % 4 = 0 THEN 'T0' ELSE 'T4' END AS tier, CASE WHEN doc_id % 5 <> 0 THEN 'me' END AS owner,
  CASE doc_id % 8 WHEN 0 THEN ' Medical ' WHEN 1 THEN 'law' ELSE 'cooking' END AS domain, CASE WHEN doc_id % 3 = 0 THEN 'PRIVATE' ELSE 'PUBLIC' END AS sensitivity,
  CASE WHEN doc_id % 12 = 0 THEN '2.1' END AS version, CASE WHEN doc_id % 7 = 0 THEN 1000 END AS freshness_at, doc_id % 3 <> 0 AS search_available, doc_id % 53 = 0 AS unsafe FROM {documents}"""
EVIDENCE = """SELECT cast(floor(o_orderkey / 15) AS bigint) - CASE WHEN cast(floor(o_orderkey / 15) AS bigint) % 10 = 9 THEN 1 ELSE 0 END AS claim_id,
  CASE WHEN cast(floor(o_orderkey / 15) AS bigint) % 7 < 3 THEN 'SUPPORT' WHEN cast(floor(o_orderkey / 15) AS bigint) % 7 = 3 THEN 'CONTRADICT' WHEN o_orderstatus = 'P' THEN 'CONTRADICT' WHEN o_orderstatus = 'O' THEN 'NEUTRAL' ELSE 'SUPPORT' END AS stance,
  CASE o_orderkey % 3 WHEN 0 THEN 'T1' WHEN 1 THEN 'T2' ELSE 'T4' END AS tier, cast(o_orderkey % 100 AS double) / 100 AS relevance, cast(90 + o_orderkey % 11 AS double) / 100 AS coverage,
  'f' || cast(o_orderkey % 6 AS string) AS family, o_orderkey % 4 = 0 AS version_match, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS freshness_match FROM {orders}"""
DIM_SQL = f"""e AS (SELECT *, tier IN ('T1', 'T2') AND relevance >= 0.8 AS trusted FROM ({twin(EVIDENCE)})),
  d AS (SELECT claim_id, count(*) AS results, max(coverage) AS coverage, least(count(DISTINCT family) / 2.0, 1.0) AS independence,
    count(*) FILTER (trusted AND stance = 'SUPPORT') AS supports, count(*) FILTER (trusted AND stance = 'CONTRADICT') AS contradictions,
    max(coverage) FILTER (trusted AND stance = 'SUPPORT') AS sc, max(coverage) FILTER (trusted AND stance = 'CONTRADICT') AS cc,
    coalesce(bool_or(version_match) FILTER (trusted AND stance = 'SUPPORT'), false) AS vo, coalesce(bool_or(freshness_match) FILTER (trusted AND stance = 'SUPPORT'), false) AS fo FROM e GROUP BY 1)"""


@query("quality_dimensions", f"WITH {DIM_SQL} SELECT claim_id, results, coverage, independence::DOUBLE AS independence, supports, contradictions, vo AS version_ok, fo AS freshness_ok FROM d")
def quality_dimensions(spark, sf):
    return govern.dimensions(derived(spark, sf, EVIDENCE)).select("claim_id", "results", "coverage", F.col("independence").cast("double").alias("independence"), "supports", "contradictions", "version_ok", "freshness_ok")


POLICY_SQL = f"""{DIM_SQL}, c AS (SELECT c.*, coalesce(results, 0) AS results, coalesce(supports, 0) AS s, coalesce(contradictions, 0) AS n, sc, cc, vo, fo FROM ({twin(CLAIMS)}) c LEFT JOIN d USING (claim_id)),
  v AS (SELECT *, CASE WHEN unsafe THEN 'QUARANTINED' WHEN claim_type IN ('OPINION', 'PREDICTION') THEN 'OPINION'
      WHEN tier = 'T0' AND claim_type IN ('USER_EXPERIENCE', 'PREFERENCE', 'DECISION') AND owner IS NOT NULL THEN 'USER_ASSERTED'
      WHEN NOT search_available OR results = 0 THEN 'INSUFFICIENT' WHEN s > 0 AND n > 0 THEN 'CONTESTED'
      WHEN s > 0 AND sc >= 0.95 AND (vo OR NOT (claim_type = 'CODE_BEHAVIOR' OR coalesce(version, '') <> '')) AND (fo OR freshness_at IS NULL) THEN 'VERIFIED'
      WHEN n > 0 AND s = 0 AND cc >= 0.95 THEN 'REJECTED' ELSE 'INSUFFICIENT' END AS verdict,
    CASE WHEN unsafe OR lower(trim(domain)) IN ('medical', 'medicine', 'health', 'legal', 'law', 'financial', 'finance', 'security') THEN 'HIGH'
      WHEN claim_type IN ('OPINION', 'PREDICTION', 'USER_EXPERIENCE', 'PREFERENCE', 'DECISION') OR sensitivity = 'PUBLIC' THEN 'LOW' ELSE 'MEDIUM' END AS risk FROM c),
  p AS (SELECT *, CASE verdict WHEN 'QUARANTINED' THEN 'SAFETY_SIGNAL' WHEN 'OPINION' THEN 'SUBJECTIVE_CLAIM' WHEN 'USER_ASSERTED' THEN 'USER_OWNED_CLAIM' WHEN 'CONTESTED' THEN 'TRUSTED_CONFLICT'
      WHEN 'VERIFIED' THEN 'TRUSTED_SUPPORT' WHEN 'REJECTED' THEN 'TRUSTED_CONTRADICTION' ELSE CASE WHEN NOT search_available THEN 'SEARCH_CAPABILITY_UNAVAILABLE' WHEN results = 0 THEN 'EVIDENCE_MISSING' ELSE 'EVIDENCE_COVERAGE_INSUFFICIENT' END END AS reason,
    CASE WHEN verdict IN ('CONTESTED', 'INSUFFICIENT') THEN true WHEN verdict = 'QUARANTINED' THEN false ELSE risk <> 'LOW' END AS review_required,
    verdict IN ('OPINION', 'USER_ASSERTED', 'VERIFIED') AND risk = 'LOW' AS publishable FROM v)"""


def _verdicts(spark, sf):
    return govern.verdicts(derived(spark, sf, CLAIMS), derived(spark, sf, EVIDENCE))


@query("quality_policy", f"WITH {POLICY_SQL} SELECT claim_id, verdict, reason, risk, review_required, publishable FROM p")
def quality_policy(spark, sf):
    return _verdicts(spark, sf)


@query(
    "governance_rollup",
    f"""WITH {POLICY_SQL}, i AS (SELECT claim_id % 37 AS change_id, verdict, CASE WHEN claim_id % 101 = 0 THEN 'FAILED' WHEN review_required THEN 'REVIEW_REQUIRED' ELSE 'DECIDED' END AS stage FROM p),
    r AS (SELECT change_id, count(*) AS items, count(*) FILTER (stage = 'DECIDED' AND verdict <> 'QUARANTINED') AS decided, count(*) FILTER (verdict = 'QUARANTINED') AS quarantined, count(*) FILTER (stage = 'REVIEW_REQUIRED') AS review, count(*) FILTER (stage = 'FAILED') AS failed FROM i GROUP BY 1)
    SELECT *, CASE WHEN failed > 0 THEN 'FAILED' WHEN quarantined > 0 THEN 'QUARANTINED' WHEN review > 0 THEN 'REVIEW_REQUIRED' ELSE 'PUBLISH_INTENT' END AS change_status FROM r""",
)
def governance_rollup(spark, sf):
    stage = F.when(F.col("claim_id") % 101 == 0, "FAILED").when(F.col("review_required"), "REVIEW_REQUIRED").otherwise("DECIDED")
    return govern.rollup(_verdicts(spark, sf).select((F.col("claim_id") % 37).alias("change_id"), "verdict", stage.alias("stage")))


REVIEWS = "SELECT o_orderkey AS review_id, o_custkey AS change_id, CASE o_orderkey % 9 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'CANCELLED' ELSE 'APPROVED' END AS status FROM {orders}"


@query(
    "review_gate",
    f"WITH r AS (SELECT *, count(*) FILTER (status = 'PENDING') OVER (PARTITION BY change_id) AS pending FROM ({twin(REVIEWS)})) SELECT *, CASE WHEN status IN ('REJECTED', 'CANCELLED') THEN 'FAILED' WHEN status = 'APPROVED' AND pending = 0 THEN 'PUBLISH_INTENT' ELSE 'REVIEW_REQUIRED' END AS outcome FROM r",
)
def review_gate(spark, sf):
    return govern.review_gate(derived(spark, sf, REVIEWS))


PRINTS = "SELECT conv_id, turn, role, text AS value, CASE WHEN turn % 3 = 0 THEN NULL ELSE cast(turn AS string) END AS version FROM {conversations}"
_J = "replace(replace(replace(value, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n')"
FAMILY_JSON = "'{\"claim_type\":\"FACT\",\"predicate\":\"' || role || '\",\"scope\":{\"conditions\":[],\"exceptions\":[],\"polarity\":\"AFFIRMED\"' || CASE WHEN version IS NOT NULL THEN ',\"version\":\"' || version || '\"' ELSE '' END || '},\"subject\":\"c' || conv_id % 100 || '\"}'"


def _typed(spark, sf):
    p = derived(spark, sf, PRINTS)
    none, text = F.array().cast("array<string>"), F.lit(None).cast("string")
    scope = F.struct(none.alias("conditions"), none.alias("exceptions"), F.lit("AFFIRMED").alias("polarity"), F.col("version"))
    subject = F.concat(F.lit("c"), (F.col("conv_id") % 100).cast("string"))
    claims = p.select("conv_id", "turn", F.lit("FACT").alias("claim_type"), subject.alias("subject"), F.col("role").alias("predicate"), scope.alias("scope"), F.struct("value", F.lit("TEXT").alias("value_type")).alias("object"), F.lit("PUBLIC").alias("sensitivity"), *(text.alias(c) for c in ("valid_from", "valid_to", "freshness_at")))
    return claims


def _fingerprints(spark, sf):
    """Family: type, subject, predicate and scope without its nulls; the fingerprint adds the object and the times."""
    return govern.fingerprints(_typed(spark, sf)).select("conv_id", "turn", "family_key", "fingerprint")


PRINTS_SQL = f"""f AS (SELECT conv_id, turn, sha256({FAMILY_JSON}) AS family_key,
  sha256('{{"claim_type":"FACT","freshness_at":null,"object":{{"value":"' || {_J} || '","value_type":"TEXT"}},"predicate":"' || role || '","scope":{{"conditions":[],"exceptions":[],"polarity":"AFFIRMED"' || CASE WHEN version IS NOT NULL THEN ',"version":"' || version || '"' ELSE '' END || '}},"sensitivity":"PUBLIC","subject":"c' || conv_id % 100 || '","valid_from":null,"valid_to":null}}') AS fingerprint
  FROM ({twin(PRINTS)}))"""


@query(
    "public_claims",
    f"""SELECT conv_id * 1000 + turn AS claim_id, '{{"claim_type":"FACT","object":{{"value":"' || {_J} || '","value_type":"TEXT"}},"predicate":"' || role || '","scope":{{"conditions":[],"exceptions":[],"polarity":"AFFIRMED"' || CASE WHEN version IS NOT NULL THEN ',"version":"' || version || '"' ELSE '' END || '}},"subject":"c' || conv_id % 100 || '"}}' AS payload FROM ({twin(PRINTS)})""",
)
def public_claims(spark, sf):
    return govern.public_claims(_typed(spark, sf).withColumn("claim_id", F.col("conv_id") * 1000 + F.col("turn")))


@query("claim_fingerprint", f"WITH {PRINTS_SQL} SELECT * FROM f")
def claim_fingerprint(spark, sf):
    return _fingerprints(spark, sf)


@query("family_groups", f"WITH {PRINTS_SQL} SELECT family_key, count(*) AS claims, count(DISTINCT fingerprint) AS fingerprints FROM f GROUP BY 1")
def family_groups(spark, sf):
    return _fingerprints(spark, sf).groupBy("family_key").agg(F.count("*").alias("claims"), F.count_distinct("fingerprint").alias("fingerprints"))


def visible_sql() -> str:
    text = "coalesce(html, '')"
    for pattern, put in (*((p, "") for p in html.REMOVED), *html.TAGS):
        quoted = pattern.replace("'", "''")
        text = f"regexp_replace({text}, '{quoted}', {'chr(10)' if put else repr('')}, 'g')"
    return text


#: What stands for a character in HTML: a number or a name; some names need no semicolon, and may be the start of a longer word.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def unescaped_sql(text: str) -> str:
    """References replaced as HTML 5 has it: the whole name if it is known, else its longest known start, else nothing is done."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'" if x.isprintable() else "concat(" + ", ".join(f"chr({ord(c)})" for c in x) + ")"
    map_ = lambda pairs: "MAP {" + ", ".join(f"{k}: {quoted(v)}" for k, v in pairs) + "}"
    names, numbers = map_((quoted(k), v) for k, v in entities.html5.items()), map_(html_rules._invalid_charrefs.items())
    number = "coalesce(CASE WHEN r[3] IN ('x', 'X') THEN try_cast('0x' || rtrim(r[4:], ';') AS BIGINT) ELSE try_cast(rtrim(r[3:], ';') AS BIGINT) END, 1114112)"
    known = f"CASE WHEN {number} IN ({', '.join(map(str, sorted(html_rules._invalid_codepoints)))}) THEN '' WHEN {number} BETWEEN 55296 AND 57343 OR {number} > 1114111 THEN chr(65533) ELSE chr({number}::INT) END"
    start = f"list_filter(list_transform(range(length(r) - 1, 2, -1), lambda x: {names}[r[2:x]] || r[x + 1:]), lambda x: x IS NOT NULL)[1]"
    one = f"CASE WHEN r[2] = '#' THEN coalesce({numbers}[{number}], {known}) ELSE coalesce({names}[r[2:]], {start}, r) END"
    between, found = f"regexp_split_to_array({text}, '{REFERENCE}')", f"regexp_extract_all({text}, '{REFERENCE}')"
    return f"list_aggregate(flatten(list_transform(list_zip({between}, list_transform({found}, lambda r: {one})), lambda z: [z[1], coalesce(z[2], '')])), 'string_agg', '')"


@query(
    "html_blocks",
    rf"""WITH v AS (SELECT page_id, {unescaped_sql('h')} AS t FROM (SELECT page_id, {visible_sql()} AS h FROM pages)),
    l AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ls FROM v),
    s AS (SELECT page_id, list_filter(flatten(list_transform(ls, lambda x: list_transform(range(0, (length(x) - 1) // {html.BLOCK_CHARS} + 1), lambda i: trim(substr(x, (i * {html.BLOCK_CHARS} + 1)::BIGINT, {html.BLOCK_CHARS}))))), lambda x: x <> '')[1:{html.MOST_BLOCKS}] AS bs FROM l),
    b AS (SELECT page_id, generate_subscripts(bs, 1) - 1 AS ordinal, unnest(bs) AS t FROM s)
    SELECT page_id, ordinal::INT AS ordinal, 'text:block:' || ordinal AS anchor, sha256(t) AS text_hash, length(t) AS character_count FROM b""",
)
def html_blocks(spark, sf):
    return html.text_blocks(html.html_text(table(spark, sf, "pages")))
