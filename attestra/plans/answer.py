"""Queries over answers: citations, refusals, golden metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answer
from ..sources.tables import table
from ..streaming.run import kept
from .base import derived, query, twin

CLAIMS = """SELECT conv_id AS answer_id, turn AS position, text,
  CASE turn % 4 WHEN 0 THEN array('c' || cast(conv_id % 7 AS string), 'c' || cast(turn AS string)) WHEN 1 THEN array('c' || cast(turn + 3 AS string)) WHEN 2 THEN array('c1', 'c1') ELSE array('x9', 'c' || cast(turn - 1 AS string)) END AS cited,
  CASE WHEN turn % 5 = 0 THEN array('c' || cast(turn AS string)) WHEN turn % 5 = 1 THEN array('c8') WHEN turn % 5 = 2 THEN array_remove(array('z'), 'z') ELSE array('c' || cast(turn - 1 AS string)) END AS supporting,
  (conv_id + turn) % 6 <> 0 AS supported FROM {conversations}"""
CLAIMS_SQL = """cl AS (SELECT conv_id AS answer_id, turn AS position, text,
  CASE turn % 4 WHEN 0 THEN ['c' || conv_id % 7, 'c' || turn] WHEN 1 THEN ['c' || (turn + 3)] WHEN 2 THEN ['c1', 'c1'] ELSE ['x9', 'c' || (turn - 1)] END AS cited,
  CASE WHEN turn % 5 = 0 THEN ['c' || turn] WHEN turn % 5 = 1 THEN ['c8'] WHEN turn % 5 = 2 THEN [] ELSE ['c' || (turn - 1)] END AS supporting,
  (conv_id + turn) % 6 <> 0 AS supported FROM conversations), ev AS (SELECT DISTINCT conv_id AS answer_id, 'c' || turn AS chunk_id FROM conversations)"""
EVIDENCE = "SELECT DISTINCT conv_id AS answer_id, 'c' || cast(turn AS string) AS chunk_id FROM {conversations}"


@query(
    "citation_validation",
    f"""WITH {CLAIMS_SQL}, u AS (SELECT DISTINCT answer_id, position FROM (SELECT answer_id, position, unnest(cited) AS chunk_id FROM cl) ANTI JOIN ev USING (answer_id, chunk_id)),
    r AS (SELECT cl.*, CASE WHEN u.answer_id IS NOT NULL THEN 'UNKNOWN_CITATION'
      WHEN len(list_distinct(cited)) <> len(cited) THEN 'REPEATED_CITATION' WHEN NOT supported THEN 'UNSUPPORTED' WHEN len(supporting) = 0 THEN 'NO_SUPPORT'
      WHEN len(list_intersect(supporting, cited)) < len(list_distinct(supporting)) THEN 'SUPPORT_NOT_CITED' END AS reason FROM cl LEFT JOIN u ON u.answer_id = cl.answer_id AND u.position = cl.position)
    SELECT answer_id, position, reason IS NULL AS valid, reason FROM r""",
)
def citation_validation(spark, sf):
    return answer.citation_checks(derived(spark, sf, CLAIMS), derived(spark, sf, EVIDENCE))


NUMBERS_SQL = f"""{CLAIMS_SQL}, e AS (SELECT answer_id, position, unnest(cited) AS chunk_id, generate_subscripts(cited, 1) AS place FROM cl),
  m AS (SELECT answer_id, chunk_id, min(position * 1000 + place) AS first_ FROM e GROUP BY 1, 2), n AS (SELECT answer_id, chunk_id, row_number() OVER (PARTITION BY answer_id ORDER BY first_) AS number FROM m)"""


@query("citation_numbers", f"WITH {NUMBERS_SQL} SELECT answer_id, chunk_id, number::INT AS number FROM n")
def citation_numbers(spark, sf):
    return answer.citation_numbers(derived(spark, sf, CLAIMS))


@query("render_answers", f"WITH {NUMBERS_SQL} SELECT cl.answer_id, cl.position, text || ' ' || (SELECT string_agg('[' || number || ']', '' ORDER BY number) FROM e JOIN n USING (answer_id, chunk_id) WHERE e.answer_id = cl.answer_id AND e.position = cl.position) AS line FROM cl")
def render_answers(spark, sf):
    return answer.rendered(derived(spark, sf, CLAIMS))


REQUESTS = """SELECT o_orderkey AS request_id, o_orderkey % 41 <> 0 AS planned, o_orderkey % 37 <> 0 AS has_generation, o_orderkey % 31 <> 0 AS retrieved, o_orderkey % 5 AS hits, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey % 5 END AS located,
  o_orderkey % 4 AS evidence, 1 AS least_evidence, o_orderkey % 2 = 0 AS needs_current, CASE WHEN o_orderkey % 7 = 0 THEN 'V2' END AS wanted_version, CASE WHEN o_orderkey % 14 = 0 THEN 'about v2.1' ELSE 'about it' END AS evidence_text,
  o_orderkey % 29 <> 0 AS generated, o_orderkey % 23 <> 0 AS citations_valid FROM {orders}"""


@query(
    "refusal_code",
    f"""SELECT request_id, CASE WHEN NOT planned THEN 'PLANNING_FAILED' WHEN NOT has_generation THEN 'NO_ACTIVE_GENERATION' WHEN NOT retrieved THEN 'RETRIEVAL_UNAVAILABLE' WHEN hits > 0 AND located = 0 THEN 'EVIDENCE_NOT_LOCATABLE'
      WHEN evidence < 1 AND needs_current AND hits > 0 THEN 'STALE_EVIDENCE' WHEN evidence < 1 THEN 'NO_TRUSTED_EVIDENCE' WHEN wanted_version IS NOT NULL AND NOT contains(lower(evidence_text), lower(wanted_version)) THEN 'VERSION_MISMATCH'
      WHEN NOT generated THEN 'GENERATION_FAILED' WHEN NOT citations_valid THEN 'CITATION_VALIDATION_FAILED' END AS refusal_code FROM ({twin(REQUESTS)})""",
)
def refusal_code(spark, sf):
    return answer.refusal(derived(spark, sf, REQUESTS))


def _golden(spark, sf):
    """Benchmark items as cases: expected are the documents that hold the passage, whole and verbatim."""
    items, docs = table(spark, sf, "benchmark"), table(spark, sf, "documents").select("doc_id", "text")
    held = kept(answer.passages_held(items, docs), "held")
    forbidden = F.lit(-1).cast("long").alias("id")
    expected = held.select(F.col("item_id").alias("case_id"), F.col("doc_id").alias("id"))
    known = expected.select("case_id").distinct().withColumn("known", F.lit(True))
    cases = items.select(F.col("item_id").alias("case_id")).join(known, "case_id", "left").select("case_id", F.col("known").isNull().alias("should_refuse"))
    seen = cases.select("case_id", (F.col("should_refuse") | (F.col("case_id") % 11 == 0)).alias("refused"))
    wrong = cases.select("case_id", (F.col("case_id") % 17 == 3).alias("wrong"))
    cited = expected.join(wrong, "case_id").where("not wrong and id % 5 <> 0").select("case_id", "id").unionByName(wrong.where("wrong").select("case_id", forbidden))
    return cases, seen, expected, expected.where("false"), cases.select("case_id", forbidden), expected.where("id % 13 <> 0"), cited


@query(
    "golden_metrics",
    r"""
    WITH h AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    c AS (SELECT b.item_id, count(doc_id) AS expected, count(doc_id) FILTER (doc_id % 13 <> 0) AS found, CASE WHEN b.item_id % 17 = 3 THEN 1 ELSE count(doc_id) FILTER (doc_id % 5 <> 0) END AS cited,
      CASE WHEN b.item_id % 17 = 3 THEN 0 ELSE count(doc_id) FILTER (doc_id % 5 <> 0) END AS good FROM benchmark b LEFT JOIN h ON h.item_id = b.item_id GROUP BY b.item_id),
    m AS (SELECT count(*) AS cases, 0::BIGINT AS gaps, coalesce(sum(good) / nullif(sum(cited)::DOUBLE, 0), 1.0) AS precision, coalesce(sum(found) / nullif(sum(expected)::DOUBLE, 0), 1.0) AS recall,
      count(*) FILTER ((expected = 0) = (expected = 0 OR item_id % 11 = 0)) / count(*)::DOUBLE AS refusal_accuracy, count(*) FILTER (item_id % 17 = 3) AS unsafe FROM c)
    SELECT cases, gaps, round(precision, 9) AS precision, round(recall, 9) AS recall, round(refusal_accuracy, 9) AS refusal_accuracy, unsafe::BIGINT AS unsafe, precision >= 0.95 AND recall >= 0.9 AND refusal_accuracy = 1 AND unsafe = 0 AS passed FROM m""",
)
def golden_metrics(spark, sf):
    m = answer.golden_metrics(*_golden(spark, sf))
    return m.select("cases", "gaps", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "refusal_accuracy")), "unsafe", "passed")


@query("purge_answers", f"WITH {CLAIMS_SQL} SELECT answer_id, position FROM cl WHERE answer_id NOT IN (SELECT answer_id FROM cl WHERE list_contains(cited, 'c5') OR list_contains(cited, 'x9'))")
def purge_answers(spark, sf):
    answers = derived(spark, sf, CLAIMS)
    bad = table(spark, sf, "region").select(F.when(F.col("r_regionkey") % 2 == 0, "c5").otherwise("x9").alias("chunk_id")).distinct()
    return answer.purge(answers, bad).select("answer_id", "position")


@query("sse_frames", "SELECT conv_id, turn, 'id: ' || (turn + 1) || chr(10) || 'event: ' || role || chr(10) || 'data: {\"n\":' || length(text) || '}' || chr(10) || chr(10) AS frame FROM conversations")
def sse_frames(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", answer.sse_frame(F.col("turn") + 1, F.col("role"), F.to_json(F.struct(F.length("text").alias("n")))).alias("frame"))


PLANS = "SELECT o_orderkey AS request_id, CASE o_orderkey % 3 WHEN 0 THEN 'PERSONAL' WHEN 1 THEN 'MIXED' ELSE 'PUBLIC' END AS scope, CASE WHEN o_orderkey % 5 = 0 THEN 'PUBLIC' END AS asked_scope, o_orderstatus AS version, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS asked_version, o_orderkey % 120 + 1 AS top_k, o_orderkey % 2 = 0 AS current FROM {orders}"


@query(
    "query_plan",
    f"""WITH p AS (SELECT *, coalesce(asked_scope, scope) AS s FROM ({twin(PLANS)}))
    SELECT request_id, s AS scope, coalesce(asked_version, version) AS version, CASE s WHEN 'PERSONAL' THEN 'OPINION,USER_ASSERTED,VERIFIED' WHEN 'MIXED' THEN 'USER_ASSERTED,VERIFIED' ELSE 'VERIFIED' END AS statuses, least(500, greatest(6 * top_k, 30)) AS candidates, NOT current AS allow_stale FROM p""",
)
def query_plan(spark, sf):
    return answer.planned(derived(spark, sf, PLANS))
