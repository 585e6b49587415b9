"""Notes as files: written, tampered with, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import notes
from .base import derived, query, twin

NOTES = "SELECT doc_id AS note_id, coalesce(text, '') AS body, concat(source, ' \"', lang, '\"') AS title, doc_id % 100 AS n, array(concat('c', cast(doc_id AS string)), lang) AS ids FROM {documents}"
_SQL = twin(NOTES).replace("array(concat('c', cast(doc_id AS string)), lang)", "['c' || doc_id, lang]")


def digest_sql(body: str, title: str, ids: str = """'["c' || note_id || '",' || to_json(ids[2])::VARCHAR || ']'""") -> str:
    return f"""sha256('{{"body":' || to_json({body})::VARCHAR || ',"frontmatter":{{"ids":' || {ids} || ',"n":' || n || ',"title":' || to_json({title})::VARCHAR || '}}}}')"""


@query(
    "note_files",
    f"""WITH s AS ({_SQL}), d AS (SELECT *, {digest_sql("body", "title")} AS said FROM s)
    SELECT note_id, CASE note_id % 8 WHEN 1 THEN {digest_sql("body || ' '", "title")} WHEN 2 THEN {digest_sql("body", "title || 'x'")} WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 6 THEN {digest_sql("body || '<iframe src=x>'", "title")} ELSE said END AS own_hash,
      CASE note_id % 8 WHEN 1 THEN 'HASH' WHEN 2 THEN 'HASH' WHEN 3 THEN 'FRONT_MATTER' WHEN 4 THEN 'FRONT_MATTER' WHEN 5 THEN 'EXPECTED' WHEN 6 THEN 'UNSAFE' END AS problem FROM d""",
)
def note_files(spark, sf):
    """Of eight notes two are sound; the others have a changed body or title, no front matter or a broken one, another digest, unsafe text."""
    made = derived(spark, sf, NOTES)
    kind = F.col("note_id") % 8
    files = notes.rendered(made.withColumn("body", F.when(kind == 6, F.concat("body", F.lit("<iframe src=x>"))).otherwise(F.col("body"))), ["title", "n"], ["ids"])
    text = F.col("markdown")
    tampered = (
        F.when(kind == 1, F.concat(text, F.lit(" "))).when(kind == 2, F.regexp_replace(text, r"\A---\ntitle: (.*)\"\n", '---\ntitle: $1x"\n'))
        .when(kind == 3, F.regexp_replace(text, r"\A---\n", "--\n")).when(kind == 4, F.regexp_replace(text, r"\A---\n", "---\nnot a mapping\n")).otherwise(text)
    )
    expected = made.where("note_id % 8 = 5").select("note_id", F.lit("another").alias("content_hash"))
    return notes.file_problems(files.withColumn("markdown", tampered), expected)
