"""Normal forms of texts, headers and pages, and endings under concurrency."""

import hashlib
import json

from pyspark.sql import functions as F

from attestra.operators import govern, verify
from attestra.sources import html


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    return [r.o for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


TEXTS = ["a \r\n b\t\r\n\r\n", "\xa0 a \nb\x0b\n", "　", "", "x\ry \x1f", "a" + " " * 5000 + "b  \n" + "\x85c ", "one\n\n\n two"]


def test_chunk_forms_and_questions_strip_what_python_strips(spark):
    plain = lambda v: "\n".join(line.rstrip() for line in v.replace("\r\n", "\n").split("\n")).strip()
    assert column(spark, TEXTS, verify.chunk_form) == [plain(t) for t in TEXTS]
    assert column(spark, [" why\xa0", " 　 ", "a\x07b", "two\nlines", "tab\tin"], verify.safe_question) == ["why", None, None, "two\nlines", "tab\tin"]
    assert column(spark, [" v1 ", "two\nlines", "a\rb", "", None], verify.single_line) == ["v1", None, None, None, None]


def test_header_digests(spark):
    rows = [({"ETag": "e", "Date": "d", "Cookie": "c"},), ({},), ({"date": None},), (None,)]
    df = spark.createDataFrame(rows, "h map<string, string>").select(verify.header_digest(F.col("h")).alias("d"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    wanted = sha(json.dumps({"date": sha("d"), "etag": sha("e")}, sort_keys=True, separators=(",", ":")))
    assert [r.d for r in df.collect()] == [wanted, sha("{}"), sha("{}"), sha("null")]


def test_quoted_values_hide_brackets_and_links_are_canonical_alone(spark):
    pages = ['<p title="a>b">x</p>', "<div data-x='1>2' class=\"c\">y<br/>z</div>", '<p title="open>q</p>', "<a href=x>l</a> 1 < 2", '<script src="a>b">no</script>yes']
    assert column(spark, pages, html.visible) == ["\nx\n", "\ny\nz\n", "\nq\n", "l 1 < 2", "yes"]
    links = ['<link rel="canonical x" href="https://a">', "<link rel='canonical' href='https://b'>", "<link rel=canonical href=https://c >", '<link title="a>b" rel="canonical" href="https://d">']
    assert column(spark, links, html.canonical_link) == [None, "https://b", "https://c", "https://d"]


def test_one_of_two_endings_is_applied(spark):
    records = spark.createDataFrame([(1, "IN_PROGRESS", 1), (2, "UNKNOWN", 4)], "id long, status string, revision long")
    asked = [(10, 1, "FAILED", 1, False), (11, 1, "SUCCEEDED", 1, False), (12, 1, "SUCCEEDED", 0, False), (20, 2, "SUCCEEDED", 4, False), (21, 2, "FAILED", 4, True), (22, 2, "SUCCEEDED", 4, True), (30, 9, "FAILED", 1, False)]
    got = verify.finish_decisions(records, spark.createDataFrame(asked, "request_id long, id long, target string, expected_revision long, reconcile boolean"))
    assert {r.request_id: (r.outcome, r.next_revision) for r in got.collect()} == {10: ("APPLIED", 2), 11: ("STALE", None), 12: ("STALE", None), 20: ("NEEDS_RECONCILING", None), 21: ("APPLIED", 5), 22: ("STALE", None), 30: ("NOT_FOUND", None)}


def test_domains_are_stripped(spark):
    assert column(spark, [" Medical ", "cooking"], lambda d: govern.risk_level(F.lit("FACT"), d, F.lit("PUBLIC"))) == ["HIGH", "LOW"]
