"""Notes written, read back and tampered with."""

import hashlib
import json

from pyspark.sql import functions as F

from attestra.operators import notes

ROWS = [(1, "# A\n\nbody é\n", 'T "q" \\ #1', 3, ["c1", "c\n2"]), (2, "", "", 0, []), (3, "x\n---\ny", "key: value", -7, ["- a"]), (4, "<script>", "t", 1, ["c"])]


def digest(title, n, ids, body):
    return hashlib.sha256(json.dumps({"frontmatter": {"title": title, "n": n, "ids": ids}, "body": body}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_a_note_reads_back_as_written(spark):
    df = spark.createDataFrame(ROWS, "note_id long, body string, title string, n int, ids array<string>")
    files = notes.rendered(df, ["title", "n"], ["ids"])
    back = {r.note_id: r for r in notes.read_back(files).collect()}
    for i, body, title, n, ids in ROWS:
        assert back[i].body == body and back[i].content_hash == back[i].own_hash == digest(title, n, ids, body)
        assert {p.key: json.loads(p.json) for p in back[i].fields if p.key != "content_hash"} == {"title": title, "n": n, "ids": ids}
    expected = df.select("note_id", F.when(F.col("note_id") == 2, "other").alias("content_hash"))
    assert {r.note_id: r.problem for r in notes.file_problems(files, expected).collect()} == {1: None, 2: "EXPECTED", 3: None, 4: "UNSAFE"}
    tampered = files.withColumn("markdown", F.concat("markdown", F.lit(" ")))
    assert {r.problem for r in notes.file_problems(tampered, expected).collect()} == {"HASH"}


def test_front_matter_of_all_kinds(spark):
    blocks = {
        "a: 1\nb: -3\nc: true\nd: ~\ne:\nf: plain text # note\n": {"a": 1, "b": -3, "c": True, "d": None, "e": None, "f": "plain text"},
        "a: 'it''s'\nb: \"x\\ty\"\nlist:\n- one\n  - 2\n\n# done\n": {"a": "it's", "b": "x\ty", "list": ["one", 2]},
        "a: 01\nb: http://x\nc: []\n": {"a": "01", "b": "http://x", "c": []}, "": {},
        "- a\n": None, "a: {b: c}\n": None, "a: 1\na: 2\n": None, "no colon\n": None, "a: x: y\n": None, "a: 1\n- b\n": None, "a: |\n": None, "a: [1]\n": None,
    }
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i long, b string").select("i", notes.front_matter(F.col("b")).alias("f"))
    got = [None if r.f is None else {p.key: json.loads(p.json) for p in r.f} for r in df.orderBy("i").collect()]
    assert got == list(blocks.values())


def test_files_that_are_no_notes(spark):
    rows = [(1, "no front"), (2, "---\na: 1\nnever closed"), (3, "---\na: 1\n---\nbody"), (4, "---\ncontent_hash: 12\n---\n"), (5, "---\r\ncontent_hash: x\r\n---\r\nb"), (6, None)]
    got = notes.file_problems(spark.createDataFrame(rows, "note_id long, markdown string"), spark.createDataFrame([], "note_id long, content_hash string"))
    assert {r.note_id: r.problem for r in got.collect()} == {1: "FRONT_MATTER", 2: "FRONT_MATTER", 3: "HASH_MISSING", 4: "HASH_MISSING", 5: "HASH", 6: "FRONT_MATTER"}
