"""Notes as files: written with their own digest in front, read back and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import quoted
from ..functions.hashing import sha256
from ..functions.text import bound, strip
from .verify import UNSAFE_MARKDOWN

FRONT = r"(?s)\A---\n(.*?\n)?---\n(.*)\z"
_ENTRY = "array<struct<key: string, json: string, items: array<string>>>"


def _object(pairs: Column) -> Column:
    """``array<struct<key, json>>`` as an object, keys in order."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(quoted(p["key"]), F.lit(":"), p["json"])), ","), F.lit("}"))


def note_digest(pairs: Column, body: Column) -> Column:
    """The digest of body and front matter as canonical JSON; the front matter's own digest is no part of it."""
    rest = F.transform(F.filter(pairs, lambda p: p["key"] != "content_hash"), lambda p: F.struct(p["key"].alias("key"), p["json"].alias("json")))
    return sha256(F.concat(F.lit('{"body":'), quoted(body), F.lit(',"frontmatter":'), _object(rest), F.lit("}")))


def rendered(notes: DataFrame, scalars: list[str], lists: list[str]) -> DataFrame:
    """``note_id, markdown`` of ``notes(note_id, body, ...)``: columns as front matter, texts quoted, and the digest last."""
    text = lambda c: quoted(F.col(c)) if dict(notes.dtypes)[c] == "string" else F.col(c).cast("string")
    json = lambda c: F.coalesce(text(c), F.lit("null"))
    items = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, quoted), ","), F.lit("]"))
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), (json(c) if c in scalars else items(c)).alias("json")) for c in (*scalars, *lists)))
    lines = [F.concat(F.lit(f"{c}: "), json(c), F.lit("\n")) for c in scalars]
    lines += [F.when(F.size(c) == 0, F.lit(f"{c}: []\n")).otherwise(F.concat(F.lit(f"{c}:\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), quoted(x), F.lit("\n"))), ""))) for c in lists]
    front = F.concat(F.lit("---\n"), *lines, F.lit("content_hash: "), note_digest(pairs, F.col("body")), F.lit("\n---\n"))
    return notes.select("note_id", F.concat(front, "body").alias("markdown"))


def _scalar(text: Column) -> Column:
    """A value of front matter as JSON; null where it is of a kind that isn't read."""
    plain = strip(F.regexp_replace(text, r"(?:^|\s)#.*$", ""))
    double, single = text.rlike(r'^"(?:[^"\\]|\\.)*"$'), text.rlike(r"^'(?:[^']|'')*'$")
    return (
        F.when(double, quoted(F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), F.lit(0))))
        .when(single, quoted(F.replace(F.substr(text, F.lit(2), F.length(text) - 2), F.lit("''"), F.lit("'"))))
        .when(plain.isin("", "~", "null"), "null").when(plain.isin("true", "false", "[]"), plain).when(plain.rlike("^-?(?:0|[1-9][0-9]*)$"), plain)
        .when(plain.rlike(r"""^[\[\]{}"'|>&*!%@`,?-]|: |:$"""), None).otherwise(quoted(plain))
    )


def front_matter(text: Column) -> Column:
    """The entries of a block of ``key: value`` lines and of lists of ``- value`` lines; null where it is anything else.

    A fold over the lines: an item goes to the entry before it. Values are plain, quoted in either way, whole numbers, true,
    false or null. Keys stand once. Empty lines and comments are passed over.
    """
    start = F.struct(F.array().cast(_ENTRY).alias("all"), F.lit(True).alias("good"))

    def step(acc: Column, line: Column) -> Column:
        key, value = F.regexp_extract(line, r"^([A-Za-z_][A-Za-z0-9_-]*):(?:\s|$)", 1), strip(F.regexp_replace(line, r"^[A-Za-z_][A-Za-z0-9_-]*:", ""))
        item = F.regexp_extract(line, r"^\s*-\s+(.*)$", 1)
        is_item, is_key, empty = line.rlike(r"^\s*-\s"), key != "", line.rlike(r"^\s*(?:#.*)?$")
        last = F.try_element_at(acc["all"], F.lit(-1))
        opened = value.rlike(r"^(?:#.*)?$")
        entry = F.struct(key.alias("key"), F.when(~opened, _scalar(value)).alias("json"), F.when(opened, F.array().cast("array<string>")).alias("items"))
        longer = F.concat(F.slice(acc["all"], 1, F.greatest(F.size(acc["all"]) - 1, F.lit(0))), F.array(F.struct(last["key"].alias("key"), last["json"].alias("json"), F.concat(last["items"], F.array(_scalar(strip(item)))).alias("items"))))
        good = empty | (is_item & last.isNotNull() & last["items"].isNotNull() & _scalar(strip(item)).isNotNull()) | (~is_item & is_key & (opened | _scalar(value).isNotNull()) & ~F.exists(acc["all"], lambda e: e["key"] == key))
        return F.struct(F.when(empty, acc["all"]).when(is_item & last.isNotNull(), longer).otherwise(F.concat(acc["all"], F.array(entry))).cast(_ENTRY).alias("all"), (acc["good"] & F.coalesce(good, F.lit(False))).alias("good"))

    done = F.aggregate(F.split(text, "\n"), start, step)
    listed = lambda e: F.when(e["items"].isNull(), e["json"]).when(F.size(e["items"]) == 0, "null").otherwise(F.concat(F.lit("["), F.array_join(e["items"], ","), F.lit("]")))
    return bound(done, lambda d: F.when(d["good"], F.transform(d["all"], lambda e: F.struct(e["key"].alias("key"), listed(e).alias("json")))))


def read_back(files: DataFrame) -> DataFrame:
    """``files(note_id, markdown)`` -> ``note_id, fields, body, content_hash, own_hash``; fields are null without readable front matter.

    ``fields`` has each key with its value as JSON. ``content_hash`` is what the note says of itself, ``own_hash`` what it is.
    """
    whole = F.regexp_replace("markdown", "\r\n?", "\n")
    rows = files.select("note_id", whole.alias("markdown")).withColumn("there", F.col("markdown").rlike(FRONT))
    rows = rows.withColumn("body", F.when(F.col("there"), F.regexp_extract("markdown", FRONT, 2))).withColumn("fields", F.when(F.col("there"), front_matter(F.regexp_extract("markdown", FRONT, 1))))
    said = F.get(F.filter("fields", lambda p: (p["key"] == "content_hash") & p["json"].startswith('"')), F.lit(0))["json"]
    return rows.select("note_id", "fields", "body", F.regexp_replace(said, '^"|"$', "").alias("content_hash"), note_digest(F.col("fields"), F.col("body")).alias("own_hash"))


def file_problems(files: DataFrame, expected: DataFrame) -> DataFrame:
    """``note_id, own_hash, problem``: the first thing wrong with each file, null where nothing is.

    FRONT_MATTER that is missing or can't be read, HASH_MISSING, HASH that isn't the note's own, EXPECTED where
    ``expected(note_id, content_hash)`` has another one, UNSAFE Markdown.
    """
    c = F.col
    rows = read_back(files).join(expected.select("note_id", c("content_hash").alias("wanted")), "note_id", "left")
    problem = (
        F.when(c("fields").isNull(), "FRONT_MATTER").when(c("content_hash").isNull(), "HASH_MISSING").when(c("content_hash") != c("own_hash"), "HASH")
        .when(c("wanted") != c("content_hash"), "EXPECTED").when(c("body").rlike(UNSAFE_MARKDOWN), "UNSAFE")
    )
    return rows.select("note_id", "own_hash", problem.alias("problem"))
