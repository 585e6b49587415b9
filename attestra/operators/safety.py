"""Safety signals: what a text holds that shouldn't be passed on, as counts by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Category, severity and pattern of each rule.
RULES = (
    ("SECRET_MATERIAL", "HIGH", r"(?i)-----BEGIN (?:RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----"),
    ("SECRET_MATERIAL", "HIGH", r"\b(?:sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16})\b"),
    ("BIDI_CONTROL", "LOW", "[‪-‮⁦-⁩]"),
    ("ZERO_WIDTH_CONTROL", "LOW", "[​-‏⁠﻿]"),
    ("LONG_ENCODING", "LOW", r"(?<![A-Za-z0-9+/=])(?:[A-Fa-f0-9]{128,}|[A-Za-z0-9+/]{128,}={0,2})(?![A-Za-z0-9+/=])"),
    (
        "INSTRUCTION_INJECTION",
        "HIGH",
        r"(?i)\b(?:ignore (?:all |any |the |previous )?(?:system )?(?:rules|instructions)|reveal (?:the )?system prompt|(?:execute|invoke|call) (?:a |the )?(?:tool|command))\b",
    ),
)


def signal_counts(text: Column) -> dict[tuple[str, str], Column]:
    """Number of matches by category and severity."""
    out: dict[tuple[str, str], Column] = {}
    for category, severity, pattern in RULES:
        n = F.regexp_count(text, F.lit(pattern))
        out[category, severity] = out[category, severity] + n if (category, severity) in out else n
    return out


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, category, severity, signals``: a row for each category found. One scan of the text, no shuffle."""
    found = [F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"), n.cast("long").alias("signals")) for (c, s), n in signal_counts(F.col("text")).items()]
    return docs.select("doc_id", F.explode(F.array(*found)).alias("s")).select("doc_id", "s.*").where("signals > 0")


def quarantined(docs: DataFrame) -> DataFrame:
    """Documents with any signal of high severity."""
    return scan(docs).groupBy("doc_id").agg(F.sum("signals").alias("signals"), F.bool_or(F.col("severity") == "HIGH").alias("quarantined"))
