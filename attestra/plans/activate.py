"""Queries over live content: activations, moves between generations, and the log that both leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import activate, replay
from ..operators.activate import State
from ..sources.versioned import Tables
from ..streaming.run import shared_folder
from .base import derived, query, twin

NOTE_OF = "'n' || cast(CASE WHEN c_custkey % 10 = 1 THEN c_custkey - 1 ELSE c_custkey END AS string)"
GENERATION_OF = "CASE WHEN c_custkey % 7 = 0 THEN 'g2' WHEN c_custkey % 23 = 0 THEN 'g4' ELSE 'g1' END"
#: Two runs want the note of each tenth customer; every rule is broken by some row.
STATE = {
    "runs": f"""SELECT 'r' || cast(c_custkey AS string) AS run_id, 3 AS revision, CASE WHEN c_custkey % 17 = 0 THEN 'VAULT_PUBLISHED' ELSE 'ACTIVATING' END AS status, {NOTE_OF} AS note_id,
      'v' || cast(c_custkey AS string) AS version_id, 'c' || cast(c_custkey AS string) AS change_id, {GENERATION_OF} AS generation_id FROM {{customer}}""",
    "notes": """SELECT 'n' || cast(c_custkey AS string) AS note_id, 2 AS revision, CASE WHEN c_custkey % 3 = 0 THEN 'o' || cast(c_custkey AS string) END AS current_version_id,
      CASE WHEN c_custkey % 3 = 0 THEN 'LIVE' END AS generation_id, c_custkey % 29 = 0 AS deleted FROM {customer}""",
    "versions": f"""SELECT 'v' || cast(c_custkey AS string) AS version_id, 4 AS revision, 'STAGING' AS status, CASE WHEN c_custkey % 19 = 0 THEN 'n0' ELSE {NOTE_OF} END AS note_id, 'c' || cast(c_custkey AS string) AS change_id FROM {{customer}}
      UNION ALL SELECT 'o' || cast(c_custkey AS string), 6, CASE WHEN c_custkey % 9 = 0 THEN 'QUARANTINED' ELSE 'ACTIVE' END, 'n' || cast(c_custkey AS string), 'd' || cast(c_custkey AS string) FROM {{customer}} WHERE c_custkey % 3 = 0""",
    "jobs": f"SELECT 'j' || cast(c_custkey AS string) AS job_id, 1 AS revision, CASE WHEN c_custkey % 13 = 0 THEN 'INDEXING' ELSE 'INDEXED' END AS status, 'v' || cast(c_custkey AS string) AS version_id, {GENERATION_OF} AS generation_id FROM {{customer}}",
    "changes": "SELECT 'c' || cast(c_custkey AS string) AS change_id, 5 AS revision, CASE WHEN c_custkey % 31 = 0 THEN 'RECEIVED' ELSE 'PUBLISH_INTENT' END AS status FROM {customer}",
    "generations": "SELECT 'g' || cast(r_regionkey AS string) AS generation_id, r_regionkey + 1 AS revision, CASE r_regionkey WHEN 1 THEN 'ACTIVE' WHEN 2 THEN 'STAGING' WHEN 3 THEN 'SUPERSEDED' ELSE 'FAILED' END AS status FROM {region} WHERE r_regionkey > 0",
}
REQUESTS = """SELECT c_custkey AS request_id, CASE WHEN c_custkey % 37 = 0 THEN 'none' ELSE 'r' || cast(c_custkey AS string) END AS run_id, 'j' || cast(c_custkey AS string) AS job_id, 3 AS run_revision, CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 2 END AS note_revision,
  4 AS version_revision, 1 AS job_revision, 5 AS change_revision, CASE WHEN c_custkey % 41 = 0 THEN 0 WHEN c_custkey % 7 = 0 THEN 3 WHEN c_custkey % 23 = 0 THEN 5 ELSE 2 END AS generation_revision FROM {customer}"""


def listed(state: State) -> DataFrame:
    """All six tables as rows of one: ``entity, id, revision, status, points_to``."""
    status = {"notes": F.when(F.col("deleted"), "DELETED").otherwise("LIVE")}
    points = {"notes": F.concat_ws("/", F.coalesce("current_version_id", F.lit("-")), F.coalesce("generation_id", F.lit("-")))}
    rows = None
    for name in State._fields:
        part = getattr(state, name).select(F.lit(name).alias("entity"), F.col(activate.KEYS[name]).alias("id"), F.col("revision").cast("long").alias("revision"), status.get(name, F.col("status")).alias("status"), points.get(name, F.lit(None).cast("string")).alias("points_to"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _state(spark, sf, live: str | None) -> State:
    return State(*(derived(spark, sf, sql.replace("'LIVE'", f"'{live}'" if live else "NULL")) for sql in STATE.values()))


def _stored(spark, state: State) -> Tables:
    store = Tables(spark, shared_folder(spark, "tables"))
    with store.transaction("first") as t:
        for name, rows in zip(State._fields, state, strict=True):
            t.write(name, rows)
        t.commit()
    return store


def _after_activation(spark, sf, live: str | None) -> DataFrame:
    store = _stored(spark, _state(spark, sf, live))
    with store.transaction("half") as t:  # writes a table and never commits: nobody sees it
        t.write("runs", t.read("runs").limit(0))
    activate.commit(store, "activate", lambda s: activate.activated(s, activate.activation_outcomes(s, derived(spark, sf, REQUESTS))))
    activate.commit(store, "activate", lambda s: s)  # asked again: done already
    return listed(activate.read(store)).withColumn("version", F.lit(store.version()).cast("long"))


def activation_sql(live: str | None) -> str:
    tables = ", ".join(f"{n} AS ({twin(sql).replace(chr(39) + 'LIVE' + chr(39), f'{chr(39)}{live}{chr(39)}' if live else 'NULL::VARCHAR')})" for n, sql in STATE.items())
    return f"""WITH {tables}, requests AS ({twin(REQUESTS)}),
    a AS (SELECT max(generation_id) AS id, (SELECT count(*) > 0 FROM notes WHERE NOT deleted AND generation_id IN (SELECT generation_id FROM generations WHERE status = 'ACTIVE')) AS busy FROM generations WHERE status = 'ACTIVE'),
    j AS (SELECT q.request_id, r.run_id, n.note_id, v.version_id, jo.job_id, c.change_id, g.generation_id, CASE WHEN o.version_id <> v.version_id THEN o.version_id END AS old_id, CASE WHEN g.status = 'STAGING' THEN g.generation_id END AS flip,
      CASE WHEN r.run_id IS NULL OR n.note_id IS NULL OR v.version_id IS NULL OR jo.job_id IS NULL OR c.change_id IS NULL OR g.generation_id IS NULL THEN 'NOT_FOUND'
        WHEN (r.revision, n.revision, v.revision, jo.revision, c.revision, g.revision) IS DISTINCT FROM (run_revision, note_revision, version_revision, job_revision, change_revision, generation_revision) OR n.deleted THEN 'STALE'
        WHEN r.status <> 'ACTIVATING' OR v.status <> 'STAGING' OR jo.status <> 'INDEXED' OR c.status <> 'PUBLISH_INTENT' OR v.note_id <> n.note_id OR v.change_id <> c.change_id OR jo.version_id <> v.version_id OR jo.generation_id <> g.generation_id
          OR g.status NOT IN ('STAGING', 'ACTIVE') OR (o.version_id <> v.version_id AND o.status NOT IN ('ACTIVE', 'STALE_PENDING_REVIEW')) THEN 'INVALID'
        WHEN g.status = 'STAGING' AND a.id IS NOT NULL AND a.busy THEN 'MIGRATION_REQUIRED' ELSE 'READY' END AS outcome
      FROM requests q LEFT JOIN runs r ON r.run_id = q.run_id LEFT JOIN notes n ON n.note_id = r.note_id LEFT JOIN versions v ON v.version_id = r.version_id LEFT JOIN jobs jo ON jo.job_id = q.job_id
      LEFT JOIN changes c ON c.change_id = r.change_id LEFT JOIN generations g ON g.generation_id = r.generation_id LEFT JOIN versions o ON o.version_id = n.current_version_id, a),
    w AS (SELECT request_id, unnest(['r' || run_id, 'n' || note_id, 'v' || version_id, 'v' || old_id, 'j' || job_id, 'c' || change_id, 'g' || flip]) AS what FROM j WHERE outcome = 'READY'),
    f AS (SELECT what, min(request_id) AS first_ FROM w WHERE what IS NOT NULL GROUP BY 1),
    lost AS (SELECT DISTINCT request_id FROM w JOIN f USING (what) WHERE request_id <> first_),
    o AS (SELECT * REPLACE (CASE WHEN outcome = 'READY' THEN CASE WHEN request_id IN (SELECT request_id FROM lost) THEN 'CONFLICT' ELSE 'ACTIVATED' END ELSE outcome END AS outcome) FROM j),
    d AS (SELECT * FROM o WHERE outcome = 'ACTIVATED')"""


def after_sql(live: str | None) -> str:
    return f"""{activation_sql(live)}
    SELECT 'runs' AS entity, r.run_id AS id, revision + (d.run_id IS NOT NULL)::INT AS revision, CASE WHEN d.run_id IS NOT NULL THEN 'COMPLETED' ELSE status END AS status, NULL AS points_to, 2::BIGINT AS version FROM runs r LEFT JOIN d ON d.run_id = r.run_id
    UNION ALL SELECT 'notes', n.note_id, revision + (d.note_id IS NOT NULL)::INT, CASE WHEN deleted THEN 'DELETED' ELSE 'LIVE' END, coalesce(d.version_id, current_version_id, '-') || '/' || coalesce(d.generation_id, n.generation_id, '-'), 2 FROM notes n LEFT JOIN d ON d.note_id = n.note_id
    UNION ALL SELECT 'versions', v.version_id, revision + (d.version_id IS NOT NULL OR x.old_id IS NOT NULL)::INT, CASE WHEN d.version_id IS NOT NULL THEN 'ACTIVE' WHEN x.old_id IS NOT NULL THEN 'SUPERSEDED' ELSE status END, NULL, 2 FROM versions v LEFT JOIN d ON d.version_id = v.version_id LEFT JOIN d x ON x.old_id = v.version_id
    UNION ALL SELECT 'jobs', j.job_id, revision + (d.job_id IS NOT NULL)::INT, CASE WHEN d.job_id IS NOT NULL THEN 'ACTIVE_INDEXED' ELSE status END, NULL, 2 FROM jobs j LEFT JOIN d ON d.job_id = j.job_id
    UNION ALL SELECT 'changes', c.change_id, revision + (d.change_id IS NOT NULL)::INT, CASE WHEN d.change_id IS NOT NULL THEN 'ACTIVE' ELSE status END, NULL, 2 FROM changes c LEFT JOIN d ON d.change_id = c.change_id
    UNION ALL SELECT 'generations', generation_id, revision + hit::INT, CASE WHEN NOT hit THEN status WHEN status = 'STAGING' THEN 'ACTIVE' ELSE 'SUPERSEDED' END, NULL, 2
      FROM (SELECT *, generation_id IN (SELECT flip FROM d WHERE flip IS NOT NULL) OR (status = 'ACTIVE' AND EXISTS (SELECT 1 FROM d WHERE flip IS NOT NULL)) AS hit FROM generations)"""


@query("activation_outcomes", activation_sql("g1") + " SELECT request_id, outcome FROM o")
def activation_outcomes(spark, sf):
    return activate.activation_outcomes(_state(spark, sf, "g1"), derived(spark, sf, REQUESTS)).select("request_id", "outcome")


@query("activation_tables", after_sql("g1"))
def activation_tables(spark, sf):
    """Live notes are on the active generation: what waits for the staged one is refused."""
    return _after_activation(spark, sf, "g1")


@query("activation_first", after_sql(None))
def activation_first(spark, sf):
    """No note is live yet: the first request takes its staged generation live, the others of that generation have to ask again."""
    return _after_activation(spark, sf, None)


MOVE_STATE = STATE | {
    "notes": """SELECT 'n' || cast(c_custkey AS string) AS note_id, 2 AS revision, CASE WHEN c_custkey % 6 <> 0 THEN 'v' || cast(c_custkey AS string) END AS current_version_id,
      CASE WHEN c_custkey % 6 <> 0 THEN CASE WHEN c_custkey = 8 THEN 'STRAY' ELSE 'g1' END END AS generation_id, c_custkey % 20 = 0 AS deleted FROM {customer}""",
    "jobs": """SELECT 'a' || cast(c_custkey AS string) AS job_id, 1 AS revision, 'ACTIVE_INDEXED' AS status, 'v' || cast(c_custkey AS string) AS version_id, 'g1' AS generation_id FROM {customer}
      UNION ALL SELECT 'b' || cast(c_custkey AS string), 1, CASE WHEN c_custkey % 20 = 0 OR c_custkey % 6 = 0 THEN 'FAILED' WHEN c_custkey = 9 THEN 'BEHIND' ELSE 'INDEXED' END, 'v' || cast(c_custkey AS string), 'g2' FROM {customer}
      UNION ALL SELECT 'd' || cast(c_custkey AS string), 1, 'DELETE_PENDING', 'v' || cast(c_custkey AS string), 'g3' FROM {customer}""",
}
MOVES = [("PROMOTE", "g2", 3), ("PROMOTE", "g2", 4), ("PROMOTE", "g1", 2), ("PROMOTE", "g3", 4), ("PROMOTE", "g9", 1), ("ROLLBACK", "g3", 4), ("ROLLBACK", "g2", 3)]
FAULTS = {"none": ("g1", "INDEXED"), "stray": ("g3", "INDEXED"), "behind": ("g1", "INDEXING")}


def _move_state(spark, sf, fault: str) -> State:
    stray, behind = FAULTS[fault]
    return State(*(derived(spark, sf, sql.replace("'STRAY'", f"'{stray}'").replace("'BEHIND'", f"'{behind}'")) for sql in MOVE_STATE.values()))


def moves_sql() -> str:
    out = []
    for fault, (stray, behind) in FAULTS.items():
        notes, jobs = (twin(MOVE_STATE[n]).replace("'STRAY'", f"'{stray}'").replace("'BEHIND'", f"'{behind}'") for n in ("notes", "jobs"))
        values = ", ".join(f"('{a}', '{g}', {r})" for a, g, r in MOVES)
        out.append(f"""SELECT * FROM (WITH n AS (SELECT * FROM ({notes}) WHERE NOT deleted AND current_version_id IS NOT NULL), jobs AS ({jobs}), g AS ({twin(MOVE_STATE["generations"])}), s AS (SELECT generation_id AS source FROM g WHERE status = 'ACTIVE'),
        q AS (SELECT *, CASE action WHEN 'PROMOTE' THEN 'STAGING' ELSE 'SUPERSEDED' END AS must, CASE action WHEN 'PROMOTE' THEN 'INDEXED' ELSE 'DELETE_PENDING' END AS job FROM (VALUES {values}) v(action, target, rev))
        SELECT '{fault}' AS fault, action, target, rev, source, CASE WHEN g.status IS NULL THEN 'NOT_FOUND' WHEN g.revision <> rev THEN 'STALE' WHEN g.status <> must OR source = target THEN 'INVALID'
          WHEN (SELECT count(*) FROM n WHERE generation_id <> source) > 0 THEN 'MIXED'
          WHEN (SELECT count(*) FROM n WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.version_id = current_version_id AND j.generation_id = source AND j.status = 'ACTIVE_INDEXED')
            OR NOT EXISTS (SELECT 1 FROM jobs j WHERE j.version_id = current_version_id AND j.generation_id = target AND j.status = job)) > 0 THEN 'JOBS' ELSE 'MOVED' END AS outcome, (SELECT count(*) FROM n) AS live
        FROM q LEFT JOIN g ON g.generation_id = target, s)""")
    return "SELECT fault, action, target, rev AS revision, source, outcome, CASE WHEN outcome = 'MOVED' THEN live ELSE 0 END AS notes FROM (" + " UNION ALL ".join(out) + ")"


@query("generation_moves", moves_sql())
def generation_moves(spark, sf):
    """Promotions and rollbacks that may be done and that may not, with sound tables, a stray note, and a job that is behind."""
    rows = None
    for fault in FAULTS:
        state = _move_state(spark, sf, fault)
        for action, target, revision in MOVES:
            one = activate.move_outcome(state, action, target, revision).select(F.lit(fault).alias("fault"), F.lit(action).alias("action"), "target", F.lit(revision).alias("revision"), "source", "outcome", "notes")
            rows = one if rows is None else rows.unionByName(one)
    return rows


def _moved(store: Tables, operation: str, action: str, target: str, revision: int) -> int:
    return activate.commit(store, operation, lambda s: activate.moved(s, activate.move_outcome(s, action, target, revision)))


def promoted_sql() -> str:
    notes, jobs = (twin(MOVE_STATE[n]).replace("'STRAY'", "'g1'").replace("'BEHIND'", "'INDEXED'") for n in ("notes", "jobs"))
    runs, versions, changes, generations = (twin(MOVE_STATE[n]) for n in ("runs", "versions", "changes", "generations"))
    def step(k: int, active: str, up: int) -> str:
        old = "g1" if active == "g2" else "g2"
        gens = f"CASE generation_id WHEN '{active}' THEN 'ACTIVE' WHEN '{old}' THEN 'SUPERSEDED' ELSE status END"
        job = f"CASE WHEN NOT moves THEN status WHEN generation_id = '{active}' THEN 'ACTIVE_INDEXED' ELSE 'DELETE_PENDING' END"
        return f"""SELECT {k}::BIGINT AS version, 'notes' AS entity, note_id AS id, revision + CASE WHEN live THEN {up} ELSE 0 END AS revision, CASE WHEN deleted THEN 'DELETED' ELSE 'LIVE' END AS status, coalesce(current_version_id, '-') || '/' || CASE WHEN live THEN '{active}' ELSE coalesce(generation_id, '-') END AS points_to FROM n
        UNION ALL SELECT {k}, 'jobs', job_id, revision + CASE WHEN moves THEN {up} ELSE 0 END, {job}, NULL FROM j
        UNION ALL SELECT {k}, 'generations', generation_id, revision + CASE WHEN generation_id IN ('g1', 'g2') THEN {up} ELSE 0 END, {gens}, NULL FROM g
        UNION ALL SELECT {k}, 'runs', run_id, revision, status, NULL FROM r UNION ALL SELECT {k}, 'versions', version_id, revision, status, NULL FROM v UNION ALL SELECT {k}, 'changes', change_id, revision, status, NULL FROM c"""
    return f"""WITH n AS (SELECT *, NOT deleted AND current_version_id IS NOT NULL AS live FROM ({notes})), g AS ({generations}), r AS ({runs}), v AS ({versions}), c AS ({changes}),
    j AS (SELECT *, generation_id IN ('g1', 'g2') AND version_id IN (SELECT current_version_id FROM n WHERE live) AS moves FROM ({jobs})) {step(2, "g2", 1)} UNION ALL {step(3, "g1", 2)} UNION ALL {step(4, "g2", 1)}"""


@query("generation_versions", promoted_sql())
def generation_versions(spark, sf):
    """The six tables after a promotion, after its rollback by the rules, and after going back to the snapshot before that."""
    store = _stored(spark, _move_state(spark, sf, "none"))
    two = _moved(store, "promote", "PROMOTE", "g2", 3)
    three = _moved(store, "roll back", "ROLLBACK", "g1", 3)
    four = store.go_back(two, "undo")
    rows = None
    for version in (two, three, four):
        part = listed(activate.read(store, version)).withColumn("version", F.lit(version).cast("long"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


ENTRIES = """SELECT 'op' || cast(c_custkey AS string) AS operation_id, 'g' || cast(c_custkey % 5 AS string) AS target_id, 'g' || cast(c_custkey % 4 + 7 AS string) AS old, cast(c_custkey % 50 AS bigint) AS notes, cast(c_custkey % 900 AS bigint) AS chunks, c_custkey AS k FROM {customer}"""


def _entry(rows: DataFrame, action: str, step: int, previous: str | None) -> DataFrame:
    c = F.col
    promoted = action == replay.PROMOTED
    text = lambda x: F.lit(x).cast("string")
    before = F.struct(c("old").alias("active_generation_id"), text("STAGING" if promoted else None).alias("target_status"))
    after = F.struct((c("target_id") if promoted else c("old")).alias("active_generation_id"), c("chunks").alias("chunk_count"), text("a\"b" if promoted else None).alias("gate_hash"), F.when(c("k") % 6 != 0, c("notes")).alias("note_count"), text(None if promoted else "STAGING").alias("target_status"))
    at = F.timestamp_seconds(F.lit(1_700_000_000 + step) + c("k")) + F.make_dt_interval(secs=F.lit(0.000250))
    return rows.select(
        "operation_id", F.lit(step).cast("long").alias("step_number"), F.lit(action).alias("action"), "target_id", before.alias("before"), after.alias("after"), at.alias("created_at"),
        text(None).alias("actor_id"), F.lit(replay.ACTOR).alias("actor_type"), F.lit(replay.TARGET).alias("target_type"), (c(previous) if previous else text(None)).alias("previous_entry_hash"), "old", "notes", "chunks", "k",
    )


def _log(spark, sf) -> DataFrame:
    """Two of three operations have been rebuilt, half of these promoted."""
    rows = derived(spark, sf, ENTRIES)
    rebuilt = replay.with_entry_hash(_entry(rows.where("k % 3 <> 0"), replay.REBUILT, 0, None))
    promoted = replay.with_entry_hash(_entry(rebuilt.where("k % 2 = 0").withColumnRenamed("entry_hash", "previous"), replay.PROMOTED, 1, "previous"))
    return rebuilt.unionByName(promoted)


_AT = "strftime(make_timestamp(({s} + k) * 1000000 + 250), '%Y-%m-%dT%H:%M:%S.%fZ')"
_COUNT = "CASE WHEN k % 6 <> 0 THEN ',\"note_count\":' || notes ELSE '' END"


def entry_sql(promoted: bool, step: str, seconds: int, previous: str) -> str:
    action, active = (replay.PROMOTED, "target_id") if promoted else (replay.REBUILT, "old")
    after = f"""'{{"active_generation_id":"' || {active} || '","chunk_count":' || chunks || '{',"gate_hash":"a' + chr(92) + '"b"' if promoted else ''}' || {_COUNT} || '{'' if promoted else ',"target_status":"STAGING"'}}}'"""
    before = f"""'{{"active_generation_id":"' || old || '"{',"target_status":"STAGING"' if promoted else ''}}}'"""
    return f"""sha256('{{"action":"{action}","actor_id":null,"actor_type":"SYSTEM","after":' || {after} || ',"before":' || {before} || ',"created_at":"' || {_AT.format(s=seconds)} || '","operation_id":"' || operation_id
      || '","previous_entry_hash":' || coalesce('"' || {previous} || '"', 'null') || ',"step_number":' || {step} || ',"target_id":"' || target_id || '","target_type":"INDEX_GENERATION"}}')"""


LOG_SQL = f"""e AS ({twin(ENTRIES)}), zero AS (SELECT *, {entry_sql(False, "0", 1_700_000_000, "NULL")} AS h0 FROM e WHERE k % 3 <> 0), one AS (SELECT *, {entry_sql(True, "1", 1_700_000_001, "h0")} AS h1 FROM zero WHERE k % 2 = 0)"""


@query("audit_entries", f"WITH {LOG_SQL} SELECT operation_id, 0::BIGINT AS step_number, NULL AS previous_entry_hash, h0 AS entry_hash FROM zero UNION ALL SELECT operation_id, 1, h0, h1 FROM one")
def audit_entries(spark, sf):
    return _log(spark, sf).select("operation_id", "step_number", "previous_entry_hash", "entry_hash")


@query(
    "audit_chain",
    f"""WITH {LOG_SQL}, l AS (SELECT k, operation_id, 0 AS step, h0 AS own, NULL AS prev, CASE WHEN k % 8 = 1 THEN 'spoilt' ELSE h0 END AS said FROM zero WHERE k % 14 <> 2 UNION ALL SELECT k, operation_id, 1, h1, h0, CASE WHEN k % 16 = 4 THEN 'spoilt' ELSE h1 END FROM one),
    w AS (SELECT *, lag(step) OVER o AS ls, lag(said) OVER o AS lh FROM l WINDOW o AS (PARTITION BY operation_id ORDER BY step)),
    p AS (SELECT operation_id, step::BIGINT AS step_number, CASE WHEN step <> coalesce(ls + 1, 0) THEN 'STEP' WHEN prev IS DISTINCT FROM lh THEN 'LINK' WHEN said <> own THEN 'HASH' END AS problem FROM w) SELECT * FROM p WHERE problem IS NOT NULL""",
)
def audit_chain(spark, sf):
    """Logs with entries that are missing or spoilt."""
    log = _log(spark, sf).where("NOT (step_number = 0 AND k % 14 = 2)")
    spoilt = ((F.col("step_number") == 0) & (F.col("k") % 8 == 1)) | ((F.col("step_number") == 1) & (F.col("k") % 16 == 4))
    return replay.chain_problems(log.withColumn("entry_hash", F.when(spoilt, "spoilt").otherwise(F.col("entry_hash"))))


@query(
    "audit_append",
    f"""WITH {LOG_SQL}, last AS (SELECT e.*, zero.h0, h1, zero.k IS NOT NULL AS rebuilt, one.k IS NOT NULL AS promoted FROM e LEFT JOIN zero USING (k) LEFT JOIN one USING (k)),
    n AS (SELECT * REPLACE (CASE WHEN k % 9 = 4 THEN 'gx' ELSE target_id END AS target_id), target_id AS had, CASE WHEN promoted THEN 2 WHEN rebuilt THEN 1 ELSE 0 END AS step, coalesce(h1, h0) AS prev FROM last),
    o AS (SELECT *, CASE WHEN NOT rebuilt THEN 'APPENDED' WHEN had <> target_id THEN 'FOREIGN' WHEN promoted THEN 'KNOWN' ELSE 'APPENDED' END AS outcome FROM n),
    a AS (SELECT operation_id, '{replay.PROMOTED}' AS action, target_id, outcome, step, prev, {entry_sql(True, "step", 1_700_000_005, "prev")} AS h FROM o)
    SELECT operation_id, action, target_id, outcome, CASE WHEN outcome = 'APPENDED' THEN step::BIGINT END AS step_number, CASE WHEN outcome = 'APPENDED' THEN prev END AS previous_entry_hash, CASE WHEN outcome = 'APPENDED' THEN h END AS entry_hash FROM a
    UNION ALL SELECT operation_id, '{replay.ABORTED}', target_id, 'LATER', NULL, NULL, NULL FROM n WHERE k % 7 = 0""",
)
def audit_append(spark, sf):
    """A promotion of every operation, some asked for another generation, some with an abort after it."""
    rows = derived(spark, sf, ENTRIES).withColumn("target_id", F.when(F.col("k") % 9 == 4, "gx").otherwise(F.col("target_id")))
    new = _entry(rows, replay.PROMOTED, 5, None)
    late = new.where("k % 7 = 0").withColumn("action", F.lit(replay.ABORTED)).withColumn("created_at", F.col("created_at") + F.make_dt_interval(hours=F.lit(1)))
    keep = ["operation_id", "action", "target_id", "before", "after", "created_at"]
    return replay.appended(_log(spark, sf), new.unionByName(late).select(*keep))


AGAIN = "SELECT c_custkey AS request_id, 'op' || cast(c_custkey AS string) AS operation_id, 'INDEX_GENERATION_PROMOTED' AS action, CASE WHEN c_custkey % 11 = 4 THEN 'g9' ELSE 'g' || cast(c_custkey % 5 AS string) END AS generation_id, CASE WHEN c_custkey % 5 = 1 THEN 'other' WHEN c_custkey % 5 = 2 THEN NULL ELSE 'a\"b' END AS gate_hash FROM {customer}"
ONES = "SELECT 'g' || cast(n_nationkey AS string) AS generation_id, n_nationkey + 1 AS revision, CASE WHEN n_nationkey = 3 THEN 'SUPERSEDED' WHEN n_nationkey > 6 THEN 'STAGING' ELSE 'ACTIVE' END AS status FROM {nation}"


@query(
    "audit_replay",
    f"""WITH {LOG_SQL}, q AS ({twin(AGAIN)}), g AS ({twin(ONES)}),
    r AS (SELECT request_id, one.*, CASE WHEN one.k IS NULL THEN 'NEW' WHEN target_id <> q.generation_id OR g.status IS DISTINCT FROM 'ACTIVE' THEN 'MOVED_ON' WHEN one.k % 6 = 0 THEN 'BROKEN' WHEN gate_hash <> 'a"b' THEN 'OTHER' ELSE 'REPLAY' END AS outcome
      FROM q LEFT JOIN one ON one.operation_id = q.operation_id LEFT JOIN g ON g.generation_id = q.generation_id)
    SELECT request_id, outcome, CASE WHEN outcome = 'REPLAY' THEN old END AS source, CASE WHEN outcome = 'REPLAY' THEN notes END AS notes, CASE WHEN outcome = 'REPLAY' THEN chunks END AS chunks FROM r""",
)
def audit_replay(spark, sf):
    return replay.replays(derived(spark, sf, AGAIN), _log(spark, sf), derived(spark, sf, ONES))


HISTORY = """SELECT 'op' || cast(o_orderkey AS string) AS operation_id, cast(o_orderkey % 3 AS bigint) AS step_number, o_orderdate AS created_at, 'g' || cast(o_custkey AS string) AS target_id, 'g' || cast(o_custkey + 1 AS string) AS old,
  CASE o_orderkey % 5 WHEN 0 THEN 'INDEX_GENERATION_ROLLED_BACK' WHEN 1 THEN 'INDEX_GENERATION_ABORTED' WHEN 2 THEN 'INDEX_GENERATION_REBUILT' ELSE 'INDEX_GENERATION_PROMOTED' END AS action, CASE WHEN o_custkey % 4 = 0 THEN 'FAILED' ELSE 'STAGING' END AS was FROM {orders}"""
CREATED = "SELECT 'g' || cast(c_custkey AS string) AS generation_id, 1 AS revision, 'STAGING' AS status FROM {customer}"


@query(
    "log_state",
    f"""WITH h AS ({twin(HISTORY)}), x AS (SELECT target_id AS generation_id, CASE WHEN action LIKE '%ABORTED' THEN 'FAILED' ELSE 'ACTIVE' END AS s, created_at, operation_id, step_number FROM h WHERE action IN ('{replay.PROMOTED}', '{replay.ROLLED_BACK}') OR (action = '{replay.ABORTED}' AND was <> 'FAILED')
      UNION ALL SELECT old, 'SUPERSEDED', created_at, operation_id, step_number FROM h WHERE action IN ('{replay.PROMOTED}', '{replay.ROLLED_BACK}')),
    n AS (SELECT generation_id, arg_max(s, (created_at, operation_id, step_number)) AS now_, count(*) AS steps FROM x GROUP BY 1)
    SELECT generation_id, revision + coalesce(steps, 0) AS revision, coalesce(now_, status) AS status FROM ({twin(CREATED)}) LEFT JOIN n USING (generation_id)""",
)
def log_state(spark, sf):
    log = derived(spark, sf, HISTORY).select("operation_id", "step_number", "created_at", "target_id", "action", F.struct(F.col("old").alias("active_generation_id"), F.col("was").alias("target_status")).alias("before"))
    return replay.generations_of(log, derived(spark, sf, CREATED))
