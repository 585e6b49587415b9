"""Answers: evidence, citations, refusals and how well they do on known cases."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound
from ..streaming.run import kept
from .retrieve import CANDIDATES_PER_RESULT, LEAST_CANDIDATES, MOST_CANDIDATES

# The gate's thresholds.
LEAST_PRECISION, LEAST_RECALL = 0.95, 0.90


def citation_checks(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``claims(answer_id, position, cited, supporting, supported)``, ``evidence(answer_id, chunk_id)`` -> ``valid, reason``.

    Every cited chunk must be evidence of the answer; a supported claim needs supporting chunks, all of them cited.
    """
    cited = claims.select("answer_id", "position", F.explode("cited").alias("chunk_id")).distinct()
    unknown = cited.join(evidence.select("answer_id", "chunk_id").distinct(), ["answer_id", "chunk_id"], "left_anti").groupBy("answer_id", "position").agg(F.count("*").alias("unknown"))
    rows = claims.join(unknown, ["answer_id", "position"], "left")
    reason = (
        F.when(F.coalesce("unknown", F.lit(0)) > 0, "UNKNOWN_CITATION")
        .when(F.size(F.array_distinct("cited")) != F.size("cited"), "REPEATED_CITATION")
        .when(~F.col("supported"), "UNSUPPORTED")
        .when(F.size("supporting") == 0, "NO_SUPPORT")
        .when(F.size(F.array_except("supporting", "cited")) > 0, "SUPPORT_NOT_CITED")
    )
    return rows.select("answer_id", "position", reason.isNull().alias("valid"), reason.alias("reason"))


def citation_numbers(claims: DataFrame) -> DataFrame:
    """Numbers citations by first appearance in an answer."""
    seen = claims.select("answer_id", "position", F.posexplode("cited").alias("place", "chunk_id"))
    first = seen.groupBy("answer_id", "chunk_id").agg(F.min(F.struct("position", "place")).alias("at"))
    return first.select("answer_id", "chunk_id", F.row_number().over(Window.partitionBy("answer_id").orderBy("at")).alias("number"))


def rendered(claims: DataFrame) -> DataFrame:
    """Each claim with the numbers of its citations in brackets, ascending."""
    numbers = citation_numbers(claims)
    marks = claims.select("answer_id", "position", F.explode("cited").alias("chunk_id")).join(numbers, ["answer_id", "chunk_id"])
    marks = marks.groupBy("answer_id", "position").agg(F.array_join(F.transform(F.array_sort(F.collect_list("number")), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "").alias("marks"))
    return claims.join(marks, ["answer_id", "position"], "left").select("answer_id", "position", F.concat_ws(" ", "text", "marks").alias("line"))


def planned(requests: DataFrame) -> DataFrame:
    """``requests(request_id, scope, asked_scope, version, asked_version, top_k, current)`` -> what retrieval is asked for.

    What was asked for explicitly wins over what planning proposed. Opinions count for personal questions alone.
    """
    scope = F.coalesce("asked_scope", "scope")
    statuses = F.when(scope == "PERSONAL", "OPINION,USER_ASSERTED,VERIFIED").when(scope == "MIXED", "USER_ASSERTED,VERIFIED").otherwise("VERIFIED")
    candidates = F.least(F.lit(MOST_CANDIDATES), F.greatest(CANDIDATES_PER_RESULT * F.col("top_k"), F.lit(LEAST_CANDIDATES)))
    return requests.select("request_id", scope.alias("scope"), F.coalesce("asked_version", "version").alias("version"), statuses.alias("statuses"), candidates.alias("candidates"), (~F.col("current")).alias("allow_stale"))


def citation_link(path: Column, headings: Column) -> Column:
    """A wiki link without the file's suffix, headings joined, special characters escaped."""
    escape = lambda c: F.regexp_replace(c, r"([|\]#])", r"\\$1")
    return F.concat(F.lit("[["), escape(F.regexp_replace(path, r"\.md$", "")), F.lit("#"), escape(F.array_join(headings, " / ")), F.lit("]]"))


def refusal(requests: DataFrame) -> DataFrame:
    """The first reason, in order of the stages, not to answer; null where an answer stands."""
    c = F.col
    stale = c("needs_current") & (c("hits") > 0)
    code = (
        F.when(~c("planned"), "PLANNING_FAILED")
        .when(~c("has_generation"), "NO_ACTIVE_GENERATION")
        .when(~c("retrieved"), "RETRIEVAL_UNAVAILABLE")
        .when((c("hits") > 0) & (c("located") == 0), "EVIDENCE_NOT_LOCATABLE")
        .when((c("evidence") < c("least_evidence")) & stale, "STALE_EVIDENCE")
        .when(c("evidence") < c("least_evidence"), "NO_TRUSTED_EVIDENCE")
        .when(c("wanted_version").isNotNull() & ~F.coalesce(F.contains(F.lower("evidence_text"), F.lower("wanted_version")), F.lit(False)), "VERSION_MISMATCH")
        .when(~c("generated"), "GENERATION_FAILED")
        .when(~c("citations_valid"), "CITATION_VALIDATION_FAILED")
    )
    return requests.select("request_id", code.alias("refusal_code"))


#: Words in a run by which long passages are sought; runs lie inside, as the first and last word may be cut from longer ones.
RUN_WORDS = 5
#: Passages without a whole word inside that are compared with a document at once.
SHORT_BLOCK = 256


def _runs(words: Column, length: int, first: int, rest: int) -> Column:
    """Hashes of the runs of ``length`` words from the ``first`` on (from 0) that leave ``rest`` words after them."""
    last = F.size(words) - length - rest
    run = lambda i: F.xxhash64(F.lit(length), *(F.get(words, i + k) for k in range(length)))
    return F.when(last >= first, F.transform(F.sequence(F.lit(first), last), run)).otherwise(F.array().cast("array<bigint>"))


def passages_held(items: DataFrame, docs: DataFrame) -> DataFrame:
    """``items(item_id, text)``, ``docs(doc_id, text)`` -> ``item_id, doc_id`` where the document holds the whole text.

    Passages of seven words and more are sought by a run of five words inside them, those of three to six by a word
    inside: of all of a passage's runs the one that the fewest documents have, so that a common beginning costs nothing.
    Then whole passages are compared. Passages of one or two words may lie inside other words; these are compared with
    every document, in blocks. Null texts hold nothing and are held nowhere; an empty passage is held by every text.
    """
    items, docs = items.where("text IS NOT NULL").select("item_id", "text"), docs.where("text IS NOT NULL").select("doc_id", "text")
    words = lambda body: bound(F.split("text", r"\s+"), body)
    inside = words(lambda w: F.when(F.size(w) >= RUN_WORDS + 2, _runs(w, RUN_WORDS, 1, 1)).otherwise(_runs(w, 1, 1, 1)))
    wanted = kept(items.select("item_id", F.explode(F.array_distinct(inside)).alias("run")), "passage-runs")
    of_docs = words(lambda w: F.array_distinct(F.concat(_runs(w, RUN_WORDS, 0, 0), _runs(w, 1, 0, 0))))
    met = kept(docs.select("doc_id", F.explode(of_docs).alias("run")).join(wanted.select("run").distinct(), "run"), "runs-met")
    seen = wanted.join(met.groupBy("run").agg(F.count("*").alias("n")), "run", "left")
    rarest = seen.groupBy("item_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("r")).where("r.n > 0").select("item_id", "r.run")
    found = met.join(rarest, "run").select("item_id", "doc_id")
    long = found.join(docs, "doc_id").join(items.withColumnRenamed("text", "passage"), "item_id").where(F.contains("text", "passage")).select("item_id", "doc_id")
    tiny = items.where(words(F.size) < 3).select(F.col("item_id").cast("long"), "text")
    sets = tiny.mapInArrow(_together, "passages array<struct<item_id: long, text: string>>")
    short = docs.crossJoin(sets).select("doc_id", F.explode(F.filter("passages", lambda p: F.contains(F.col("text"), p["text"]))).alias("p")).select("p.item_id", "doc_id")  # a stated set against all rows, in blocks
    return long.unionByName(short).distinct()


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SHORT_BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([batch.slice(at, SHORT_BLOCK).to_pylist()], pa.list_(pa.struct([("item_id", pa.int64()), ("text", pa.string())])))], ["passages"])


def golden_metrics(cases: DataFrame, observations: DataFrame, expected: DataFrame, allowed: DataFrame, forbidden: DataFrame, retrieved: DataFrame, cited: DataFrame) -> DataFrame:
    """One row: precision, recall, refusal accuracy, unsafe citations, and whether the gate is passed.

    ``cases(case_id, should_refuse)``, ``observations(case_id, refused)``; the others are ``(case_id, id)`` rows, so a case
    may have any number of them. An empty denominator counts as 1. Cases and observations must match one to one.
    """
    marks = {"expected": expected, "allowed": allowed, "forbidden": forbidden, "retrieved": retrieved, "cited": cited}
    rows = None
    for name, ids in marks.items():
        part = ids.select("case_id", F.col("id").cast("string").alias("id"), *(F.lit(n == name).alias(n) for n in marks))
        rows = part if rows is None else rows.unionByName(part)
    each = rows.groupBy("case_id", "id").agg(*(F.max(n).alias(n) for n in marks))
    count = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    c = F.col
    sums = each.agg(
        count(c("cited") & (c("expected") | c("allowed")), "good"), count(c("cited"), "cited"), count(c("retrieved") & c("expected"), "found"),
        count(c("expected"), "expected"), count(c("cited") & c("forbidden"), "unsafe"),
    )
    both = cases.select("case_id", "should_refuse").join(observations.select("case_id", "refused"), "case_id", "full_outer")
    gap = c("should_refuse").isNull() | c("refused").isNull()
    totals = both.agg(count(c("should_refuse") == c("refused"), "right"), F.count("*").alias("cases"), count(gap, "gaps"))
    out = totals.crossJoin(sums)  # one row each
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0)), F.lit(1.0))
    out = out.select("cases", "gaps", ratio("good", "cited").alias("precision"), ratio("found", "expected").alias("recall"), ratio("right", "cases").alias("refusal_accuracy"), "unsafe")
    passed = (F.col("gaps") == 0) & (F.col("precision") >= LEAST_PRECISION) & (F.col("recall") >= LEAST_RECALL) & (F.col("refusal_accuracy") == 1) & (F.col("unsafe") == 0)
    return out.withColumn("passed", passed)


def purge(answers: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Answers that cite none of the given chunks."""
    cites = answers.select("answer_id", F.explode("cited").alias("chunk_id"))
    return answers.join(cites.join(chunk_ids, "chunk_id", "left_semi").select("answer_id").distinct(), "answer_id", "left_anti")


def sse_frame(event_id: Column, event: Column, data: Column) -> Column:
    return F.concat(F.lit("id: "), event_id.cast("string"), F.lit("\nevent: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))
