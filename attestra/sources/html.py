"""Visible text of web pages, as column expressions."""

from __future__ import annotations

import html as entities

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import web_text

# Elements that hide their text, and elements that end a line; block size and number.
HIDDEN = ("script", "style", "noscript", "template", "svg")
BREAKS = ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6")
BLOCK_CHARS, MOST_BLOCKS = 2000, 128

_VALUES = r"(?:\"[^\"]*\"|'[^']*'|[^>\"'])*"
_INSIDE, _LOOSE = rf"(?:[\s/]{_VALUES})?", r"(?:[\s/][^>]*)?"
#: A hidden element goes with all that it holds, up to its end tag or the page's end; then comments and declarations.
REMOVED = (
    *(rf"(?is)<{tag}(?:\s[^>]*)?/>|<{tag}{_INSIDE}>.*?(?:</{tag}\s*>|\z)" for tag in HIDDEN),
    r"(?s)<!--.*?-->",
    r"<[!?][^>]*>",
)
#: Breaks and tags, with quoted values that may hold any character; then those whose quotes don't close, which end at their first ``>``.
TAGS = (
    (rf"(?i)</?(?:{'|'.join(BREAKS)}){_INSIDE}>", "\n"), (rf"</?[A-Za-z][A-Za-z0-9:-]*{_INSIDE}>", ""),
    (rf"(?i)</?(?:{'|'.join(BREAKS)}){_LOOSE}>", "\n"), (r"</?[A-Za-z][^>]*>", ""),
)
LINK, CANONICAL, HREF = rf"(?is)<link\s{_VALUES}>", r"(?is)\srel\s*=\s*(?:\"canonical\"|'canonical'|canonical(?=[\s/>]))", r"(?is)\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"


def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(entities.unescape, na_action="ignore")


def visible(page: Column) -> Column:
    """A page's text with a line feed at each break; null counts as empty."""
    text = F.coalesce(page, F.lit(""))
    for pattern in REMOVED:
        text = F.regexp_replace(text, pattern, "")
    for pattern, put in TAGS:
        text = F.regexp_replace(text, pattern, put)
    return F.when(F.contains(text, F.lit("&")), F.pandas_udf(_unescaped, "string")(text)).otherwise(text)


def canonical_link(page: Column) -> Column:
    """The address of the last canonical link; null without one."""
    links = F.filter(F.regexp_extract_all(page, F.lit(LINK), F.lit(0)), lambda x: x.rlike(CANONICAL))
    last = F.try_element_at(F.filter(links, lambda x: x.rlike(HREF)), F.lit(-1))
    return F.nullif(F.concat(*(F.regexp_extract(last, HREF, i) for i in (1, 2, 3))), F.lit(""))


def html_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, canonical``."""
    return pages.select("page_id", "url", web_text(visible(F.col("html"))).alias("text"), canonical_link(F.col("html")).alias("canonical"))


def text_blocks(pages: DataFrame) -> DataFrame:
    """Slices of lines, stripped, the first 128 of a page: ``page_id, ordinal, anchor, text_hash, character_count``."""
    slices = F.flatten(F.transform(F.split("text", "\n"), lambda line: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(line), F.lit(1)) - 1) / BLOCK_CHARS)), lambda i: F.trim(F.substr(line, (i * BLOCK_CHARS + 1).cast("int"), F.lit(BLOCK_CHARS))))))
    kept = F.slice(F.filter(slices, lambda x: x != ""), 1, MOST_BLOCKS)
    rows = pages.select("page_id", F.posexplode(kept).alias("ordinal", "text"))
    return rows.select("page_id", "ordinal", F.concat(F.lit("text:block:"), F.col("ordinal").cast("string")).alias("anchor"), F.sha2("text", 256).alias("text_hash"), F.length("text").cast("long").alias("character_count"))
