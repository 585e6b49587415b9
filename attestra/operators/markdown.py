"""Markdown documents as anchored blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import explicit_block_id, slug

LEVELS = 6

# The lines that open each kind of block.
_OPENERS = (
    ("heading", re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")),
    ("thematic_break", re.compile(r" {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")),
    ("code_fence", re.compile(r" {0,3}(`{3,}|~{3,})")),
    ("blockquote", re.compile(r" {0,3}>")),
    ("list", re.compile(r" {0,3}(?:[-+*]|[0-9]{1,9}[.)])(?:[ \t]+|$)")),
)
_TABLE_RULE = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_INDENTED = re.compile(r"(?: {4}|\t)")


def _kind(lines: list[str], i: int) -> tuple[str, re.Match | None]:
    for kind, pattern in _OPENERS:
        if found := pattern.match(lines[i]):
            return kind, found
    if "|" in lines[i] and i + 1 < len(lines) and "-" in lines[i + 1] and _TABLE_RULE.match(lines[i + 1]):
        return "table", None
    return ("indented_code" if _INDENTED.match(lines[i]) else "paragraph"), None


def _end(lines: list[str], i: int, kind: str, found: re.Match | None) -> int:
    """The line after the block that starts at ``i``."""
    j = i + 1
    if kind in ("heading", "thematic_break"):
        return j
    if kind == "code_fence":
        close = re.compile(rf" {{0,3}}{re.escape(found[1][0])}{{{len(found[1])},}}[ \t]*$")
        while j < len(lines) and not close.match(lines[j]):
            j += 1
        if j == len(lines):
            raise ValueError("a code fence stays open")
        return j + 1
    while j < len(lines):
        blank = not lines[j].strip()
        if kind == "list":
            inner = lines[j].startswith(("  ", "\t")) or _OPENERS[4][1].match(lines[j])
            if blank and not (j + 1 < len(lines) and (lines[j + 1].startswith(("  ", "\t")) or _OPENERS[4][1].match(lines[j + 1]))):
                return j
            if not blank and not inner and (not lines[j - 1].strip() or _kind(lines, j)[0] != "paragraph"):
                return j
        elif kind == "indented_code":
            if not blank and not _INDENTED.match(lines[j]):
                return j
        elif blank:
            return j
        elif kind == "table" and "|" not in lines[j]:
            return j
        elif kind in ("paragraph", "blockquote") and _kind(lines, j)[0] not in ("paragraph", "indented_code", kind):
            return j
        j += 1
    return j


def scan(text: str) -> list[tuple[str, int, str, str]]:
    """Type, level and title (of headings) and text of each top-level block, in order.

    A ValueError where a fence or the front matter stays open. Indented code is no block of its own.
    """
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out, at = [], 0
    if lines[0] == "---":
        if "---" not in lines[1:]:
            raise ValueError("the front matter stays open")
        at = lines.index("---", 1) + 1
        out.append(("frontmatter", 0, "", "\n".join(lines[:at])))
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        kind, found = _kind(lines, at)
        to = _end(lines, at, kind, found)
        if kind == "heading":
            out.append((kind, len(found[1]), found[2] or "", lines[at]))
        elif kind != "indented_code":
            out.append((kind, 0, "", "\n".join(lines[at:to]).strip("\n")))
        at = to
    return out


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for docs in batches:
        out = []
        for doc, text in zip(docs["doc_id"], docs["text"], strict=True):
            try:
                out += [(doc, i, *block, None) for i, block in enumerate(scan(text or ""))]
            except ValueError as problem:
                out.append((doc, 0, None, 0, None, None, str(problem)))
        yield pd.DataFrame(out, columns=["doc_id", "ordinal", "block_type", "level", "title", "text", "error"])


def anchored(rows: DataFrame) -> DataFrame:
    """Adds ``anchor`` to ``rows(doc_id, ordinal, block_type, level, title, text, ...)``.

    An anchor is the path of headings above a block and the block's own label. A heading's label is its level and slug,
    another block's its type and number under its heading, or its explicit ``^id``; repeats of a slug or id under one
    heading get a number behind ``~``. All windows are of one document, so its rows move once.
    """
    reading = Window.partitionBy("doc_id").orderBy("ordinal")
    own = F.when(F.col("level") > 0, F.col("level")).otherwise(LEVELS + 1)
    at = {j: F.col(f"at{j}") for j in range(1, LEVELS + 1)}  # where the last heading of a level stands
    rows = rows.select("*", *(F.max(F.when(F.col("level") == j, F.col("ordinal"))).over(reading).alias(f"at{j}") for j in at))
    rows = rows.withColumn("under", F.coalesce(F.greatest(*(F.when(own > j, o) for j, o in at.items())), F.lit(-1)))
    id_ = explicit_block_id(F.col("text"))
    name = F.when(F.col("level") > 0, F.concat(F.lit("h"), F.col("level").cast("string"), F.lit(":"), slug(F.col("title")))).otherwise(F.coalesce(F.concat(F.lit("^"), F.lower(id_)), F.col("block_type")))
    rows = rows.withColumn("name", name).withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "under", "name").orderBy("ordinal")))
    numbered = F.concat("name", F.lit(":"), F.col("n").cast("string"))
    again = F.concat("name", F.when(F.col("n") > 1, F.concat(F.lit("~"), F.col("n").cast("string"))).otherwise(F.lit("")))
    rows = rows.withColumn("label", F.when(F.col("name") == F.col("block_type"), numbered).otherwise(again))
    rows = rows.select("*", *(F.last(F.when(F.col("level") == j, F.col("label")), True).over(reading).alias(f"label{j}") for j in at))
    open_ = lambda j: (own > j) & (at[j] > F.coalesce(F.greatest(*(at[i] for i in range(1, j)), F.lit(-1)), F.lit(-1)) if j > 1 else own > j)
    path = F.concat_ws("/", *(F.when(open_(j), F.col(f"label{j}")) for j in at), "label")
    return rows.withColumn("anchor", F.when(F.col("block_type").isNotNull(), path))


def blocks(docs: DataFrame) -> DataFrame:
    """``doc_id, ordinal, block_type, anchor, text_hash, character_count, error`` of each block; an id is one document.

    Telling blocks apart reads a document line by line in a small helper on Arrow batches; the rest is columns and windows.
    """
    found = docs.select("doc_id", "text").mapInPandas(_rows, "doc_id long, ordinal int, block_type string, level int, title string, text string, error string")
    return anchored(found).select("doc_id", "ordinal", "block_type", "anchor", F.sha2("text", 256).alias("text_hash"), F.length("text").cast("long").alias("character_count"), "error")
