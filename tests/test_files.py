"""Markdown blocks, files and JSON lines."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from attestra.operators import markdown
from attestra.operators.publish import snapshots_to_add
from attestra.sources import files, html


def anchors(spark, text):
    rows = markdown.blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("ordinal").collect()
    return [(r.block_type, r.anchor) for r in rows]


def plain_anchors(text):
    """The rule, block by block."""
    out, above, seen = [], [], {}
    for kind, level, title, body in markdown.scan(text):
        above = [h for h in above if not level or h[0] < level]
        found = re.search(r"(?:^|\s)\^([A-Za-z0-9-]+)\s*$", body)
        name = f"h{level}:{' '.join(title.split()).lower() or 'untitled'}" if level else "^" + found[1].lower() if found else kind
        n = seen[tuple(above), name] = seen.get((tuple(above), name), 0) + 1
        label = f"{name}:{n}" if name == kind else name + (f"~{n}" if n > 1 else "")
        out.append((kind, "/".join([h for _, h in above] + [label])))
        above += [(level, label)] * bool(level)
    return out


def test_anchors_are_those_of_the_rule(spark):
    random = np.random.default_rng(5)
    lines = ["# A", "## B", "## B", "### C", "###### D", "#", "text", "more ^id", "x ^id", "- a", "> q", "***", "", "", "```\n# no\n```", "    code"]
    texts = ["\n".join(random.choice(lines, int(random.integers(1, 40)))) for _ in range(40)]
    rows = markdown.blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "ordinal").collect()
    for i, text in enumerate(texts):
        assert [(r.block_type, r.anchor) for r in rows if r.doc_id == i] == plain_anchors(text), text


def test_anchors_follow_headings(spark):
    text = "---\na: 1\n---\n# One\ntext\nmore\n\nnext ^here\n## Two\n- a\n  - b\n- c\n\n> quote\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n***\n# One\n    code\n\nlast\n"
    assert anchors(spark, text) == [
        ("frontmatter", "frontmatter:1"), ("heading", "h1:one"), ("paragraph", "h1:one/paragraph:1"), ("paragraph", "h1:one/^here"), ("heading", "h1:one/h2:two"), ("list", "h1:one/h2:two/list:1"),
        ("blockquote", "h1:one/h2:two/blockquote:1"), ("table", "h1:one/h2:two/table:1"), ("thematic_break", "h1:one/h2:two/thematic_break:1"), ("heading", "h1:one~2"), ("paragraph", "h1:one~2/paragraph:1"),
    ]


def test_fences_hide_headings_and_must_close(spark):
    assert anchors(spark, "~~~\n# no\n```\n~~~\n#\n") == [("code_fence", "code_fence:1"), ("heading", "h1:untitled")]
    assert anchors(spark, "") == [] and anchors(spark, "\n \n") == []
    for bad in ("```\nx", "---\nx: 1\n"):
        with pytest.raises(ValueError):
            markdown.scan(bad)


def test_blocks_report_errors_and_take_nulls(spark):
    docs = spark.createDataFrame([(1, "```"), (2, None), (3, "a")], "doc_id long, text string")
    got = [(r.doc_id, r.block_type, r.error) for r in markdown.blocks(docs).collect()]
    assert got == [(1, None, "a code fence stays open"), (3, "paragraph", None)]


def test_stable_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbfhello")
    (tmp_path / "sub" / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_text("no")
    first = spark.createDataFrame(files.markdown_listing(spark, str(tmp_path)).collect(), "path string, modificationTime timestamp, length long, content binary")
    (tmp_path / "d.md").write_text("new")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.stable_documents(first, files.markdown_listing(spark, str(tmp_path)), 100).collect()}
    assert got == {"a.md": ("hello", None), "b.md": (None, "DECODE"), "d.md": (None, "UNSTABLE_FILE")}


def test_json_lines_are_strict(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    good = tmp_path / "good.jsonl"
    good.write_text("\n".join(json.dumps({"id": i, "n": 1}) for i in "ab") + "\n")
    assert files.strict_json_lines(spark, str(good), schema, "id").count() == 2
    for name, text in (("twice", '{"id":"a","n":1}\n{"id":"a","n":2}\n'), ("broken", '{"id":"a","n":1}\n{"id":\n')):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="repeated key|[Mm]alformed|FAILFAST"):
            files.strict_json_lines(spark, str(tmp_path / name), schema, "id").collect()


def test_export_and_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1)], "b string, a int")
    files.export_json_lines(rows, str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":1,"b":"x"}']
    contents = spark.createDataFrame([("t1",), ("t2",), ("t1",)], "text string")
    empty = spark.createDataFrame([], "content_hash string")
    files.write_snapshots(snapshots_to_add(empty, contents), str(tmp_path / "store"))
    stored = spark.read.parquet(str(tmp_path / "store"))
    assert stored.count() == 2 and snapshots_to_add(stored, contents).count() == 0


def test_html_text(spark):
    page = '<html><head><link rel="canonical" href="https://x/y"><script>no("<p>")</script><style>p{}</style></head><body><!-- <p>no</p> --><p class="a">One &amp; <b>two</b></p><svg>no<p>no</p></svg><div>  three   four </div>&eacute;<BR>5 < 6<template>no'
    rows = [(1, "u", page), (2, "u", None), (3, "u", "<LINK href='a' REL=canonical><link rel=stylesheet href=b>"), (4, "u", "<pre>x</pre>&lt;p&gt;"), (5, "u", "")]
    df = html.html_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert [(r.text, r.canonical) for r in df.orderBy("page_id").collect()] == [("One & two\nthree four\né\n5 < 6", "https://x/y"), ("", None), ("", "a"), ("x<p>", None), ("", None)]
    assert [r.anchor for r in html.text_blocks(df.where("page_id = 1")).orderBy("ordinal").collect()] == [f"text:block:{i}" for i in range(4)]
