"""Versioned tables, activation with all its outcomes, and the log as the other account of the same state."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from attestra.functions import canonical
from attestra.operators import activate, replay
from attestra.operators.activate import State
from attestra.sources.versioned import Conflict, Tables


@pytest.fixture
def store(spark, tmp_path):
    return Tables(spark, str(tmp_path / "tables"))


def test_a_commit_shows_all_tables_or_none(spark, store, tmp_path):
    assert store.version() == 0 and store.manifest()["tables"] == {}
    with store.transaction("one") as t:
        t.write("a", spark.range(3))
        t.write("b", spark.range(4))
        assert store.version() == 0 and t.read("a").count() == 3  # its own writes, seen by nobody else
        assert t.commit() == 1
        with pytest.raises(RuntimeError):
            t.commit()
    with pytest.raises(ZeroDivisionError), store.transaction("broken") as t:
        t.write("a", spark.range(99))
        1 / 0
    assert store.version() == 1 and store.read("a").count() == 3
    assert len(list((tmp_path / "tables" / "data").iterdir())) == 1  # what the broken one wrote is gone


def test_of_two_transactions_one_has_to_begin_again(spark, store):
    first, second = store.transaction("x"), store.transaction("y")
    first.write("a", spark.range(1))
    second.write("a", spark.range(2))
    assert second.commit() == 1
    with pytest.raises(Conflict):
        first.commit()
    assert store.read("a").count() == 2 and store.committed("x") is None and store.committed("y") == 1


def test_going_back_names_older_snapshots_and_sweeping_spares_named_ones(spark, store):
    for n in (1, 2, 3):
        with store.transaction(f"t{n}") as t:
            t.write("a", spark.range(n))
            t.commit()
    assert store.go_back(1, "back") == 4 and store.read("a").count() == 1 and store.read("a", 3).count() == 3
    assert store.sweep(1) == 2 and store.read("a").count() == 1


def state(spark, **changes):
    """One publication ready to go, on a staged generation, with an old version; each argument replaces a table's rows."""
    rows = {
        "runs": ([("r", 1, "ACTIVATING", "n", "v", "c", "g2")], "run_id string, revision int, status string, note_id string, version_id string, change_id string, generation_id string"),
        "notes": ([("n", 1, "o", None, False)], "note_id string, revision int, current_version_id string, generation_id string, deleted boolean"),
        "versions": ([("v", 1, "STAGING", "n", "c"), ("o", 7, "ACTIVE", "n", "d")], "version_id string, revision int, status string, note_id string, change_id string"),
        "jobs": ([("j", 1, "INDEXED", "v", "g2")], "job_id string, revision int, status string, version_id string, generation_id string"),
        "changes": ([("c", 1, "PUBLISH_INTENT")], "change_id string, revision int, status string"),
        "generations": ([("g1", 5, "ACTIVE"), ("g2", 1, "STAGING")], "generation_id string, revision int, status string"),
    }
    return State(*(spark.createDataFrame(changes.get(k, v), schema) for k, (v, schema) in rows.items()))


def asked(spark, *rows):
    return spark.createDataFrame(rows or [(1, "r", "j", 1, 1, 1, 1, 1, 1)], "request_id long, run_id string, job_id string, run_revision int, note_revision int, version_revision int, job_revision int, change_revision int, generation_revision int")


def table(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_an_activation_changes_all_six(spark):
    s = state(spark)
    out = activate.activation_outcomes(s, asked(spark))
    assert [r.outcome for r in out.collect()] == ["ACTIVATED"]
    a = activate.activated(s, out)
    assert table(a.runs)["r"][:2] == (2, "COMPLETED") and table(a.notes)["n"] == (2, "v", "g2", False)
    assert table(a.versions) == {"v": (2, "ACTIVE", "n", "c"), "o": (8, "SUPERSEDED", "n", "d")}
    assert table(a.jobs)["j"][:2] == (2, "ACTIVE_INDEXED") and table(a.changes)["c"] == (2, "ACTIVE")
    assert table(a.generations) == {"g1": (6, "SUPERSEDED"), "g2": (2, "ACTIVE")}


@pytest.mark.parametrize(
    "changes,request_,outcome",
    [
        ({}, (1, "none", "j", 1, 1, 1, 1, 1, 1), "NOT_FOUND"), ({}, (1, None, None, 1, 1, 1, 1, 1, 1), "NOT_FOUND"), ({}, (1, "r", "j", 1, 2, 1, 1, 1, 1), "STALE"), ({}, (1, "r", "j", 1, 1, 1, 1, 1, None), "STALE"),
        ({"notes": [("n", 1, "o", None, True)]}, None, "STALE"), ({"jobs": [("j", 1, "INDEXING", "v", "g2")]}, None, "INVALID"), ({"jobs": [("j", 1, "INDEXED", "v", "g1")]}, None, "INVALID"),
        ({"versions": [("v", 1, "STAGING", "m", "c"), ("o", 7, "ACTIVE", "n", "d")]}, None, "INVALID"), ({"versions": [("v", 1, "STAGING", "n", "c"), ("o", 7, "DRAFT", "n", "d")]}, None, "INVALID"),
        ({"generations": [("g1", 5, "ACTIVE"), ("g2", 1, "FAILED")]}, None, "INVALID"), ({"notes": [("n", 1, "o", None, False), ("m", 1, "w", "g1", False)]}, None, "MIGRATION_REQUIRED"),
        ({"notes": [("n", 1, "o", None, False), ("m", 1, "w", "g1", True)]}, None, "ACTIVATED"), ({"notes": [("n", 1, None, None, False)]}, None, "ACTIVATED"),
    ],
)
def test_what_doesnt_fit_changes_nothing(spark, changes, request_, outcome):
    s = state(spark, **changes)
    out = activate.activation_outcomes(s, asked(spark, request_) if request_ else asked(spark))
    assert [r.outcome for r in out.collect()] == [outcome]
    if outcome != "ACTIVATED":
        for before, after in zip(s, activate.activated(s, out)):
            assert sorted(map(tuple, before.collect())) == sorted(map(tuple, after.collect()))


def test_the_log_and_the_tables_tell_the_same(spark, store):
    """Generations after promoting, rolling back and aborting, once as tables and once from the log alone."""
    notes = [(f"n{i}", 1, f"v{i}", "g1", False) for i in range(5)] + [("gone", 1, "v0", "g1", True), ("new", 1, None, None, False)]
    jobs = [(f"{g}{i}", 1, s, f"v{i}", g) for i in range(5) for g, s in (("g1", "ACTIVE_INDEXED"), ("g2", "INDEXED"))]
    begun = state(spark, notes=notes, jobs=jobs, generations=[("g1", 1, "ACTIVE"), ("g2", 1, "STAGING"), ("g3", 1, "STAGING"), ("g4", 1, "FAILED")])
    with store.transaction("begin") as t:
        for name, rows in zip(State._fields, begun):
            t.write(name, rows)
        t.commit()
    log = spark.createDataFrame([], "operation_id string, step_number long, action string, target_id string, before struct<active_generation_id: string, target_status: string>, created_at timestamp")

    def note(action, target, active, was):
        nonlocal log
        step = log.count()
        row = spark.createDataFrame([(f"op{step}", 0, action, target, (active, was), datetime.datetime(2024, 1, 1, 0, step))], log.schema)
        log = log.unionByName(row)

    def move(action, target, revision):
        outcome = activate.move_outcome(activate.read(store), action, target, revision).first()
        activate.commit(store, f"{action} {target} {revision}", lambda s: activate.moved(s, activate.move_outcome(s, action, target, revision)))
        if outcome.outcome == "MOVED":
            note(replay.PROMOTED if action == "PROMOTE" else replay.ROLLED_BACK, target, outcome.source, None)
        return outcome.outcome, outcome.notes

    assert move("PROMOTE", "g2", 9) == ("STALE", 0) and move("PROMOTE", "g3", 1) == ("JOBS", 0)
    assert move("PROMOTE", "g2", 1) == ("MOVED", 5)
    assert {r.generation_id for r in store.read("notes").where("note_id LIKE 'n_'").collect()} == {"g2"}
    assert move("ROLLBACK", "g1", 2) == ("MOVED", 5)
    for target, wanted in (("g3", "ABORTED"), ("g4", "ALREADY_FAILED"), ("g1", "REFUSED"), ("g9", "NOT_FOUND")):
        said = activate.aborted(activate.read(store), target)[0].first()
        assert (said.outcome, said.active) == (wanted, "g1")
        activate.commit(store, f"abort {target}", lambda s: activate.aborted(s, target)[1])
        if wanted in ("ABORTED", "ALREADY_FAILED"):
            note(replay.ABORTED, target, "g1", "STAGING" if wanted == "ABORTED" else "FAILED")
    assert table(replay.generations_of(log, begun.generations)) == table(store.read("generations")) == {"g1": (3, "ACTIVE"), "g2": (3, "SUPERSEDED"), "g3": (2, "FAILED"), "g4": (1, "FAILED")}
    assert all(r.status == ("ACTIVE_INDEXED" if r.generation_id == "g1" else "DELETE_PENDING") and r.revision == 3 for r in store.read("jobs").collect())


def test_canonical_json_is_that_of_json_dumps(spark):
    texts = ["", "plain", 'q"b\\s/', "".join(map(chr, range(32))) + "\x7f é中\U0001f600"]
    numbers = [0.0, -0.0, 1.0, 100.0, 12345678.9, 1e7, 1e15, 9999999999999998.0, 1e16, 1.5e-5, 0.0001, 0.00012345, 1e-7, 3.14, 1e22, 5e-324, -5e-324, 1.7976931348623157e308, -2.5e-10]
    rows = [(t, x, {"ä": t, "a": None, "B": "c"}, [[1, None], None, []], True, (None, 2)) for t in texts for x in numbers]
    df = spark.createDataFrame(rows, "t string, x double, m map<string, string>, a array<array<int>>, z boolean, s struct<q: string, p: int>").select(F.struct("z", "t", "x", "m", "a", "s").alias("v"))
    got = [r.j for r in df.select(canonical.canonical_json(df, "v").alias("j")).collect()]
    dump = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got == [dump({"t": t, "x": x, "m": m, "a": a, "z": z, "s": {"q": s[0], "p": s[1]}}) for t, x, m, a, z, s in rows]
    sparse = df.select(canonical.canonical_json(df, "v", sparse=("s",)).alias("j")).first().j
    assert '"s":{"p":2}' in sparse and '"a":null' in sparse
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(F.struct("x").alias("v"))
    assert [r.j for r in odd.select(canonical.canonical_json(odd, "v").alias("j")).collect()] == [None, None, '{"x":null}']


def test_outcomes_are_worked_out_once_for_all_tables(spark):
    s = state(spark)
    out = activate.activation_outcomes(s, asked(spark))
    for name, rows in zip(State._fields, activate.activated(s, out)):
        joins = rows._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        assert joins <= (3 if name == "generations" else 1), name  # the table with what came through, no joins of the outcomes again
