"""String columns: normal forms, tokens, anchors, Markdown escapes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as part of a token.
TOKEN = r"[\p{L}\p{N}_]+"
# What counts as blank at the ends of a text.
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Characters that Markdown gives a meaning, in the order in which they are escaped.
MARKDOWN_SPECIAL = "\\`*_{}[]<>#|"


def fold(text: Column) -> Column:
    """Case folding for Latin scripts: lower case, and sharp s as two letters."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_counts(text: Column) -> Column:
    """The distinct tokens of a text with their numbers and that of all, as an array: sorted, then cut where the token changes."""

    def runs(words: Column) -> Column:
        changes = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: (i == 1) | (F.get(words, i - 1) != F.get(words, i - 2)))
        counted = lambda at: F.transform(at, lambda x, k: F.struct(F.get(words, x - 1).alias("token"), (F.coalesce(F.get(at, k + 1), F.size(words) + 1) - x).cast("long").alias("tf"), F.size(words).cast("long").alias("length")))
        return F.when(F.size(words) > 0, bound(changes, counted)).otherwise(F.array().cast("array<struct<token: string, tf: bigint, length: bigint>>"))

    return bound(F.sort_array(tokens(text)), runs)


def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Normal form C. Nothing below U+0300 combines, so texts without such characters are in it already; only the others leave the engine."""
    open_ = text.rlike(r"[^\x{0}-\x{2ff}]")
    return F.when(open_, F.pandas_udf(_composed, "string")(F.when(open_, text))).otherwise(text)


def strip(text: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(text, rf"\A{BLANK}+|{BLANK}+\z", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(heading: Column) -> Column:
    """A heading's anchor: folded, single blanks; ``untitled`` when nothing is left."""
    short = F.lower(collapse(heading))
    return F.when(short == "", F.lit("untitled")).otherwise(short)


def explicit_block_id(text: Column) -> Column:
    """The id after a caret at the end of a block; null without one."""
    found = F.regexp_extract(text, r"(?:^|\s)\^([A-Za-z0-9-]+)\s*$", 1)
    return F.when(found != "", found)


def block_text(text: Column) -> Column:
    """Normal form C, line feeds only, no blanks at line ends, no empty lines around."""
    lines = F.regexp_replace(F.regexp_replace(nfc(text), r"\r\n?", "\n"), r"(?m)[ \t]+$", "")
    return F.regexp_replace(lines, r"\A\n+|\n+\z", "")


def web_text(text: Column) -> Column:
    """Each line with single blanks, empty ones dropped."""
    lines = F.transform(F.split(text, "\n"), collapse)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def safe_inline(text: Column) -> Column:
    """One line without control characters, Markdown's own characters escaped."""
    out = collapse(F.regexp_replace(text, r"[\x00-\x1f\x7f]+", " "))
    for c in MARKDOWN_SPECIAL:
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return out


def plain_title(text: Column, fallback: str = "Curated knowledge") -> Column:
    short = F.substring(collapse(text), 1, 120)
    return F.when(short == "", F.lit(fallback)).otherwise(short)


def in_scope(path: Column, allowed: list[str], excluded: list[str]) -> Column:
    """Whether a folded path lies under an allowed prefix, on segment bounds, and under no excluded one."""
    under = lambda roots: F.exists(F.array(*(F.lit(r) for r in roots)), lambda r: (fold(path) == fold(r)) | fold(path).startswith(F.concat(fold(r), F.lit("/")))) if roots else F.lit(False)
    return (under(allowed) if allowed else F.lit(True)) & ~under(excluded)


def vault_path(path: Column) -> Column:
    """A relative Markdown path in normal form C with forward slashes; null where the path isn't acceptable."""
    p = F.replace(nfc(path), F.lit("\\"), F.lit("/"))
    parts = F.split(p, "/")
    # Device names that no path segment may have.
    devices = ["con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))]
    bad = F.exists(parts, lambda s: s.isin("", ".", "..") | s.endswith(" ") | s.endswith(".") | s.contains(":") | F.lower(F.split(s, r"\.")[0]).isin(devices))
    return F.when(~bad & ~p.startswith("/") & F.lower(p).endswith(".md"), p)


def source_uri(base: Column, path: Column) -> Column:
    """The path's segments percent-encoded, blanks included, behind a base."""
    return F.concat(base, F.array_join(F.transform(F.split(path, "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/"))
