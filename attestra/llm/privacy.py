"""Personal data and the terms that give it away.

Patterns find e-mail and IP addresses, card and phone numbers: the protected entities. The words of the whole documents
that hold an entity are counted against the whole corpus. A term's pointwise mutual information with an entity, as a share
of the entity's own information content, says how much of it the term discloses (after Sanchez and Batet, "C-sanitized",
2016). Every occurrence of a term beyond the threshold becomes a span too, in the documents that mention that entity.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, small_batches
from .words import word_hashes

KINDS = ("email", "ip", "card", "phone", "term")
#: Distinct texts that must hold both a term and an entity at least.
SUPPORT = 2
#: Share of an entity's information from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Terms counted in a task before the counts are handed on.
COUNTED = 1 << 20

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits matches from its start or not at all, so later starts in it need no look
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: a match starts where the run of local characters before its @ does."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        left = free + len(text[free:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if left < at else None
        if domain:
            out.append((left, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end in code points, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text) if _DIGIT.search(text) else ():
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _entities(text: str, spans: list[tuple[str, int, int]]) -> list[int]:
    return sorted({_hash(f"{kind}:{text[a:b].lower()}") for kind, a, b in spans})


def _terms(text: str) -> np.ndarray:
    """A hash for each word, in order."""
    return word_hashes(text.encode("utf-8", "surrogatepass")).astype(np.int64)


def occurrences(text: str, spans: list[tuple[int, int]], told: dict[int, float]) -> list[tuple[int, int, float]]:
    """Start, end and share of each word that ``told`` has; words that touch a span are left out."""
    out, taken, i, covered = [], sorted(spans), 0, 0
    for m, term in zip(_WORD.finditer(text), _terms(text).tolist(), strict=True):
        while i < len(taken) and taken[i][0] < m.end():
            covered = max(covered, taken[i][1])
            i += 1
        if term in told and covered <= m.start():
            out.append((*m.span(), told[term]))
    return out


class _Counts:
    """Numbers of documents by term, merged in sorted arrays of bounded size."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: np.ndarray) -> None:
        self.parts.append(np.unique(words))
        self.size += len(self.parts[-1])

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        terms, n = np.unique(np.concatenate(self.parts), return_counts=True) if self.parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.parts, self.size = [], 0
        return terms.astype(np.int64), n


SCAN = "digest binary, spans array<struct<kind: string, start: long, stop: long>>, entities array<long>, text string, term long, n long"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
_LONGS = pa.list_(pa.int64())
FOUND = "row long, terms array<struct<start: long, stop: long, share: double>>"
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("share", pa.float64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct text that has a mention, rows of term counts, and one of a number of texts without a term."""
    counts, texts, names = _Counts(), 0, ["digest", "spans", "entities", "text", "term", "n"]

    def counted(last: bool = False) -> pa.RecordBatch:
        terms, n = counts.take()
        if last:
            terms, n = pa.array([*terms.tolist(), None], pa.int64()), [*n.tolist(), texts]
        none = lambda kind: pa.nulls(len(terms), kind)
        return pa.RecordBatch.from_arrays([none(pa.binary()), none(_SPAN), none(_LONGS), none(pa.string()), pa.array(terms, pa.int64()), pa.array(n, pa.int64())], names)

    for batch in batches:
        rows = []
        for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts.add(word_hashes(text.encode("utf-8", "surrogatepass")))
            texts += 1
            if found := base_spans(text):
                rows.append((digest, [{"kind": k, "start": a, "stop": b} for k, a, b in found], _entities(text, found), text))
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.binary(), _SPAN, _LONGS, pa.string()))), none, none], names)
        if counts.size >= 4 * COUNTED:
            yield counted()
    yield counted(last=True)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each text."""
    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
            terms = np.unique(_terms(text))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), row), pa.int64()), pa.array(terms, pa.int64())], ["row", "term"])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans, told in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "told")), strict=True):
            hits = occurrences(text, [(s["start"], s["stop"]) for s in spans], {t["term"]: t["share"] for t in told})
            out.append([{"start": a, "stop": b, "share": x} for a, b, x in hits])
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, _FOUND)], ["row", "terms"])


def _share(both: Column, have: Column, df: Column, documents: int) -> Column:
    n = F.lit(float(documents))
    return F.log(n * both / (have * df)) / F.log(n / have)


def together(held: DataFrame, words: DataFrame, counts: DataFrame, documents: int) -> DataFrame:
    """``held(row, entity, have)`` and ``words(row, term)`` -> ``row, entity, term, have, df``, a row for each pair in a document.

    Pairs are left out that couldn't pass ``GENERALISE`` even if the term stood in each of the entity's documents, so
    frequent words meet frequent entities alone.
    """
    terms = counts.groupBy("term").agg(F.sum("n").alias("df")).where(F.col("df") >= SUPPORT)
    pairs = words.join(terms, "term").join(held, "row")
    best = _share(F.col("have"), F.col("have"), F.col("df"), documents)
    return pairs.where(best >= GENERALISE - 1e-9).select("row", "entity", "term", "have", "df")


def disclosing_terms(pairs: DataFrame, documents: int) -> DataFrame:
    """``entity, term, share``: how much of the entity's information the term gives, where that passes ``GENERALISE``.

    With numbers of distinct texts, PMI(e, t) = log(N c(e,t) / (c(e) c(t))) and the share is PMI / IC(e),
    IC(e) = log(N / c(e)). A hot entity's pairs are counted in part before they are shuffled.
    """
    counted = pairs.groupBy("entity", "term", "have", "df").agg(F.count("*").alias("both")).where(F.col("both") >= SUPPORT)
    share = _share(F.col("both"), F.col("have"), F.col("df"), documents)
    return counted.withColumn("share", share).where(F.col("share") >= GENERALISE).select("entity", "term", "share")


def personal_data(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``docs(doc_id long, text string, ...)`` -> ``doc_id``, ``base`` and ``terms``: arrays of spans, ``sanitised``, a row for each row.

    A span of ``terms`` also has its ``share``. ``sanitised`` is the text without what the spans disclose; null where there
    are none, as the text stays as it is. Null texts count as empty and have no spans; rows that share an id are
    judged apart. All counts are of distinct texts, so that copies support nothing; what is found in a text goes for all its
    copies. An entity that every text has discloses nothing. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    with small_batches(docs.sparkSession):
        distinct = docs.select(text.alias("text")).distinct().select(F.unhex(F.sha2("text", 256)).alias("digest"), "text")  # copies meet before they are shuffled
        scan = ws.keep(distinct.mapInArrow(_scan, SCAN), "scan")
        rows = ws.keep(scan.where("spans is not null").select(F.monotonically_increasing_id().alias("row"), "digest", "spans", "entities", "text"), "rows")
        documents = scan.where("spans is null and term is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        each = rows.select("row", F.explode("entities").alias("entity"))
        shared = each.groupBy("entity").agg(F.count("*").alias("have")).where((F.col("have") >= SUPPORT) & (F.col("have") < documents))
        held = ws.keep(each.join(shared, "entity"), "held")
        words = ws.keep(rows.select("row", "text").join(held.select("row").distinct(), "row", "left_semi").mapInArrow(_words, "row long, term long"), "words")
        pairs = ws.keep(together(held, words, scan.where("term is not null").select("term", "n"), documents), "pairs")
        terms = ws.keep(disclosing_terms(pairs, documents), "terms")
        told = pairs.join(terms, ["entity", "term"]).groupBy("row", "term").agg(F.max("share").alias("share"))
        told = told.groupBy("row").agg(F.collect_list(F.struct("term", "share")).alias("told"))  # words of one text
        found = ws.keep(rows.select("row", "text", "spans").join(told, "row").mapInArrow(_found, FOUND), "found")
        none = F.array().cast("array<struct<start: long, stop: long, share: double>>")
        spans = rows.join(found, "row", "left").select("digest", F.col("spans").alias("base"), F.coalesce("terms", none).alias("terms"), "text")
        edited = ws.keep(spans.select("digest", "base", "terms", sanitised(F.col("text"), F.col("base"), F.col("terms")).alias("sanitised")), "sanitised")
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest)
        no_spans = F.array().cast("array<struct<kind: string, start: long, stop: long>>")
        return ids.join(edited, "digest", "left").select("doc_id", F.coalesce("base", no_spans).alias("base"), F.coalesce("terms", none).alias("terms"), "sanitised")


def general_form(word: str) -> str:
    """What a disclosing term is generalised to: the class of its characters."""
    if any(c.isdigit() for c in word):
        return "<number>" if not any(c.isalpha() for c in word) else "<code>"
    return "<name>" if word[:1].isupper() else "<word>"


def sanitised(text: Column, base: Column, terms: Column) -> Column:
    """The text with entities named by kind, disclosing terms generalised to their class or removed; null text is empty."""

    def edited(texts: pd.Series, base: pd.Series, terms: pd.Series) -> pd.Series:
        out = []
        for text, spans, told in zip(texts, base, terms, strict=True):
            text, edits = text or "", [(s["start"], s["stop"], f"<{s['kind']}>") for s in spans]
            edits += [(s["start"], s["stop"], "" if s["share"] >= REMOVE else general_form(text[s["start"] : s["stop"]])) for s in told]
            parts, at = [], 0
            for start, stop, new in sorted(edits):
                if stop > at:
                    parts += [text[at : max(start, at)], new]
                    at = stop
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype="object")

    return F.pandas_udf(edited, "string")(text, base, terms)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark))
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    base = F.concat_ws(",", F.transform("base", written))
    terms = F.concat_ws(",", F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["stop"].cast("string"))))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in KINDS[:4]]
    action = F.transform("terms", lambda s: F.when(s["share"] >= REMOVE, "removed").otherwise("generalised"))
    actions = F.array_join(action, ",")
    sanitised_sha = F.sha2(F.col("sanitised"), 256).alias("sanitised_sha256")
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.when(base != "", base), F.when(terms != "", terms)).alias("spans"), actions.alias("term_actions"), sanitised_sha)
