"""Queries over state: guarded updates, transitions, logs, leases, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..operators import checks, control, lineage
from ..sources.tables import table
from .base import derived, query, twin

CURRENT = "SELECT o_orderkey AS id, o_custkey % 3 + 1 AS revision, o_orderstatus AS state FROM {orders}"
UPDATES = "SELECT CASE WHEN l_quantity > 48 THEN -1 - l_orderkey ELSE l_orderkey END AS id, cast(l_linenumber AS bigint) AS revision, l_linestatus AS state FROM {lineitem}"
CAS_SQL = f"""c AS ({twin(CURRENT)}), u AS ({twin(UPDATES)}), k AS (SELECT u.*, count(*) OVER (PARTITION BY u.id) AS n FROM u),
  o AS (SELECT k.id, k.revision, k.state, CASE WHEN c.id IS NULL THEN 'NOT_FOUND' WHEN n > 1 THEN 'CONFLICT' WHEN k.revision <> c.revision THEN 'STALE' ELSE 'APPLIED' END AS outcome FROM k LEFT JOIN c ON c.id = k.id)"""


@query("cas_apply", f"WITH {CAS_SQL} SELECT *, CASE WHEN outcome = 'APPLIED' THEN revision + 1 END AS next_revision FROM o")
def cas_apply(spark, sf):
    return control.compare_and_swap(derived(spark, sf, CURRENT), derived(spark, sf, UPDATES))


@query("cas_result", f"WITH {CAS_SQL} SELECT c.id, coalesce(o.revision + 1, c.revision) AS revision, coalesce(o.state, c.state) AS state FROM c LEFT JOIN o ON o.id = c.id AND outcome = 'APPLIED'")
def cas_result(spark, sf):
    current = derived(spark, sf, CURRENT)
    return control.swapped(current, control.compare_and_swap(current, derived(spark, sf, UPDATES)))


HISTORY = """SELECT 'ingestion_item' AS machine, user_id AS entity_id, event_id AS step, CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'APPLYING' WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' ELSE 'SKIPPED' END AS state FROM {events}"""
_ALLOWED_VALUES = ", ".join(f"('{m}', '{a}', '{b}')" for m, steps in control.TRANSITIONS.items() for a, to in steps.items() for b in to)


@query(
    "transition_violations",
    f"""WITH h AS (SELECT *, lag(state) OVER (PARTITION BY machine, entity_id ORDER BY step) AS from_state FROM ({twin(HISTORY)})), t AS (SELECT * FROM (VALUES {_ALLOWED_VALUES}) v(machine, f, t))
    SELECT machine, entity_id, step, from_state, state AS to_state FROM h WHERE from_state IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.machine = h.machine AND t.f = from_state AND t.t = state)""",
)
def transition_violations(spark, sf):
    return control.transition_violations(derived(spark, sf, HISTORY), control.transitions(spark))


LOG = "SELECT user_id AS operation_id, event_id, event_type AS payload, value FROM {events}"


def _log(spark, sf):
    """A chain a user: a stand-in hash for each entry, then some entries spoilt."""
    from pyspark.sql import Window

    w = Window.partitionBy("operation_id").orderBy("event_id")
    rows = derived(spark, sf, LOG).withColumn("step", F.row_number().over(w).cast("long")).withColumn("entry_hash", F.sha2(F.concat(F.lit("e"), F.col("event_id").cast("string")), 256)).withColumn("previous_hash", F.lag("entry_hash").over(w))
    rows = rows.withColumn("previous_hash", F.when(F.col("event_id") % 97 == 0, F.lit("wrong")).otherwise(F.col("previous_hash")))
    own = F.sha2(control.entry_text(F.col("operation_id"), F.col("step"), F.col("payload"), F.col("previous_hash")), 256)
    return rows.withColumn("entry_hash", F.when(F.col("event_id") % 89 == 0, own).otherwise(F.col("entry_hash"))).where("not (payload = 'error' and value > 20)")


@query(
    "chain_verify",
    f"""WITH r AS (SELECT *, row_number() OVER w AS step, lag(event_id) OVER w AS before FROM ({twin(LOG)}) WINDOW w AS (PARTITION BY operation_id ORDER BY event_id)),
    p AS (SELECT operation_id, event_id, payload, step, CASE WHEN event_id % 97 = 0 THEN 'wrong' WHEN before IS NOT NULL THEN sha256('e' || before) END AS previous_hash FROM r),
    g AS (SELECT *, sha256('["' || operation_id || '","' || step || '","' || payload || '","' || coalesce(previous_hash, 'null') || '"]') AS own FROM p),
    h AS (SELECT *, CASE WHEN event_id % 89 = 0 THEN own ELSE sha256('e' || event_id) END AS entry_hash FROM g JOIN (SELECT event_id, value FROM events) USING (event_id) WHERE NOT (payload = 'error' AND value > 20)),
    k AS (SELECT *, lag(step) OVER w AS ls, lag(entry_hash) OVER w AS lh FROM h WINDOW w AS (PARTITION BY operation_id ORDER BY step))
    SELECT operation_id, step, CASE WHEN step <> coalesce(ls, 0) + 1 THEN 'STEP' WHEN previous_hash IS DISTINCT FROM lh THEN 'LINK' WHEN entry_hash <> own THEN 'HASH' END AS broken FROM k
    WHERE step <> coalesce(ls, 0) + 1 OR previous_hash IS DISTINCT FROM lh OR entry_hash <> own""",
)
def chain_verify(spark, sf):
    return control.chain_breaks(_log(spark, sf))


REQUESTS = "SELECT 'answer' AS scope, c_custkey AS key, CASE WHEN c_custkey % 6 = 0 THEN 'other' ELSE 'same' END AS request_hash, 1000 AS asked_at FROM {customer}"
RECORDS = "SELECT 'answer' AS scope, c_custkey AS key, 'same' AS request_hash, CASE c_custkey % 5 WHEN 0 THEN 'SUCCEEDED' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'FAILED' ELSE 'IN_PROGRESS' END AS status, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 900 + c_custkey % 200 END AS lease_expires_at, cast(c_custkey % 3 + 1 AS bigint) AS attempt FROM {customer} WHERE c_acctbal > 0"


@query(
    "lease_decision",
    f"""WITH d AS (SELECT q.scope, q.key, q.request_hash, attempt, CASE WHEN status IS NULL THEN 'ACQUIRED' WHEN r.request_hash <> q.request_hash THEN 'CONFLICT' WHEN status = 'SUCCEEDED' THEN 'REPLAY' WHEN status = 'UNKNOWN' THEN 'RECONCILE' WHEN status = 'FAILED' THEN 'TERMINAL'
      WHEN coalesce(lease_expires_at > asked_at, false) THEN 'BUSY' ELSE 'TAKEN_OVER' END AS outcome FROM ({twin(REQUESTS)}) q LEFT JOIN ({twin(RECORDS)}) r ON r.scope = q.scope AND r.key = q.key)
    SELECT scope, key, request_hash, outcome, CASE outcome WHEN 'ACQUIRED' THEN 1 WHEN 'TAKEN_OVER' THEN attempt + 1 ELSE attempt END::BIGINT AS attempt FROM d""",
)
def lease_decision(spark, sf):
    return control.lease_decisions(derived(spark, sf, REQUESTS), derived(spark, sf, RECORDS))


@query("claims_for_version", "SELECT DISTINCT c_custkey AS claim_id, c_mktsegment AS segment FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity > 45")
def claims_for_version(spark, sf):
    c, o, line = (table(spark, sf, t) for t in ("customer", "orders", "lineitem"))
    keys = line.where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    owners = o.join(keys, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(owners, "c_custkey", "left_semi").select(F.col("c_custkey").alias("claim_id"), F.col("c_mktsegment").alias("segment"))


EDGES = """SELECT 'region:' || cast(n_regionkey AS string) AS src, 'nation:' || cast(n_nationkey AS string) AS dst FROM {nation}
  UNION ALL SELECT 'nation:' || cast(c_nationkey AS string), 'customer:' || cast(c_custkey AS string) FROM {customer}
  UNION ALL SELECT 'customer:' || cast(o_custkey AS string), 'order:' || cast(o_orderkey AS string) FROM {orders}"""


@query(
    "lineage_reach",
    f"""WITH RECURSIVE e AS ({twin(EDGES)}), r AS (SELECT 'region:1' AS node, 0 AS depth UNION ALL SELECT dst, depth + 1 FROM r JOIN e ON src = node)
    SELECT string_split(node, ':')[1] AS kind, depth::INT AS depth, count(*) AS nodes FROM r GROUP BY 1, 2""",
)
def lineage_reach(spark, sf):
    """Everything below one region."""
    roots = spark.range(1).select(F.lit("region:1").alias("node"))
    found = lineage.reached(derived(spark, sf, EDGES), roots)
    return found.groupBy(F.split("node", ":")[0].alias("kind"), "depth").agg(F.count("*").alias("nodes"))


@query("unique_violations", "SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 50 AND user_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, sf):
    return checks.repeated_keys(table(spark, sf, "events"), ["user_id", "event_type"], F.col("value") > 50)


@query("foreign_key_violations", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1")
def foreign_key_violations(spark, sf):
    return checks.orphans(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "customer").where("c_acctbal > 0"), "c_custkey")


@query(
    "check_violations",
    """SELECT 'positive' AS "check", count(*) FILTER (l_quantity <= 10) AS n FROM lineitem UNION ALL SELECT 'unit_score', count(*) FILTER (NOT l_discount * 12 BETWEEN 0 AND 1) FROM lineitem
    UNION ALL SELECT 'digest', count(*) FILTER (l_orderkey % 3 = 0) FROM lineitem UNION ALL SELECT 'typed_id', count(*) FILTER (l_orderkey % 2 = 0) FROM lineitem""",
)
def check_violations(spark, sf):
    line = table(spark, sf, "lineitem")
    digest = F.concat(F.sha2(F.col("l_orderkey").cast("string"), 256), F.when(F.col("l_orderkey") % 3 == 0, "x").otherwise(""))
    id_ = F.concat(F.lit("claim_"), F.repeat(F.lit("0"), 26), F.when(F.col("l_orderkey") % 2 == 0, "U").otherwise(""))
    return checks.broken(line, {"positive": F.col("l_quantity") > 10, "unit_score": (F.col("l_discount") * 12).between(0, 1), "digest": checks.is_sha256(digest), "typed_id": checks.is_typed_id(id_, "claim")})


REFERENCES = "SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'part' ELSE 'supplier' END AS type, cast(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey * 2 ELSE l_suppkey * 3 END AS string) AS id FROM {lineitem}"


@query("entity_exists", f"SELECT type, id FROM ({twin(REFERENCES)}) r WHERE (type = 'part' AND id IN (SELECT p_partkey::VARCHAR FROM part)) OR (type = 'supplier' AND id IN (SELECT s_suppkey::VARCHAR FROM supplier))")
def entity_exists(spark, sf):
    return checks.entity_exists(derived(spark, sf, REFERENCES), {"part": (table(spark, sf, "part"), "p_partkey"), "supplier": (table(spark, sf, "supplier"), "s_suppkey")})


@query("next_numbers", "SELECT o_custkey, max(o_orderkey) + 1 AS next_number FROM orders GROUP BY 1")
def next_numbers(spark, sf):
    return checks.next_numbers(table(spark, sf, "orders"), "o_custkey", "o_orderkey")


@query("event_times", "SELECT event_id, epoch_us(ts) // 1000 AS millis, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS utc_text FROM events")
def event_times(spark, sf):
    return table(spark, sf, "events").select("event_id", times.utc_millis(F.col("ts")).alias("millis"), times.utc_text(F.col("ts")).alias("utc_text"))


ROWS_NOW = "SELECT c_custkey AS id, cast(c_nationkey % 3 AS bigint) AS revision, c_mktsegment AS state FROM {customer} WHERE c_custkey % 10 <> 0"
IN_TURN = "SELECT o_custkey AS id, o_orderkey AS seq, cast(o_orderkey % 5 AS bigint) AS expected, concat(o_orderstatus, cast(o_orderkey AS string)) AS state FROM {orders}"
TURNS_SQL = f"""WITH RECURSIVE u AS (SELECT u.*, n.revision AS begun, row_number() OVER (PARTITION BY u.id ORDER BY seq) AS i FROM ({twin(IN_TURN)}) u LEFT JOIN ({twin(ROWS_NOW)}) n ON n.id = u.id),
  f AS (SELECT *, CASE WHEN begun IS NULL THEN 'NOT_FOUND' WHEN expected = begun THEN 'APPLIED' WHEN expected < begun THEN 'STALE' ELSE 'AHEAD' END AS outcome, begun + (expected = begun)::INT AS revision FROM u WHERE i = 1
    UNION ALL SELECT u.*, CASE WHEN u.begun IS NULL THEN 'NOT_FOUND' WHEN u.expected = f.revision THEN 'APPLIED' WHEN u.expected < f.revision THEN 'STALE' ELSE 'AHEAD' END, f.revision + (u.expected = f.revision)::INT FROM f JOIN u ON u.id = f.id AND u.i = f.i + 1)"""


@query("updates_in_turn", TURNS_SQL + " SELECT id, seq, expected, state, outcome, revision::BIGINT AS revision FROM f")
def updates_in_turn(spark, sf):
    return control.applied_in_turn(derived(spark, sf, ROWS_NOW), derived(spark, sf, IN_TURN))[0]


@query("rows_after_turns", TURNS_SQL + f", l AS (SELECT id, max(revision) AS revision, arg_max(state, revision) AS state FROM f WHERE outcome = 'APPLIED' GROUP BY 1) SELECT n.id, coalesce(l.revision, n.revision)::BIGINT AS revision, coalesce(l.state, n.state) AS state FROM ({twin(ROWS_NOW)}) n LEFT JOIN l ON l.id = n.id")
def rows_after_turns(spark, sf):
    return control.applied_in_turn(derived(spark, sf, ROWS_NOW), derived(spark, sf, IN_TURN))[1]
