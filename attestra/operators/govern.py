"""Claims, their evidence and the policy's verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, digests
from ..functions.text import strip

# The policy's sets and thresholds.
HIGH_RISK_DOMAINS = ("medical", "medicine", "health", "legal", "law", "financial", "finance", "security")
SUBJECTIVE_TYPES = ("OPINION", "PREDICTION")
USER_TYPES = ("USER_EXPERIENCE", "PREFERENCE", "DECISION")
FACTUAL_TYPES = ("FACT", "DEFINITION", "PROCEDURE", "CODE_BEHAVIOR")
TRUSTED_TIERS = ("T1", "T2")
LEAST_COVERAGE, LEAST_RELEVANCE = 0.95, 0.8
TIER_ORDER = ("T1", "T2", "T0", "T3", "T4", "T5")
MOST_SOURCES, MOST_BLOCKS, MOST_EVIDENCE = 8, 2, 16


def tier_rank(tier: Column) -> Column:
    out = F.lit(len(TIER_ORDER))
    for i, t in enumerate(TIER_ORDER):
        out = F.when(tier == t, i).otherwise(out)
    return out


def first_hits(hits: DataFrame) -> DataFrame:
    """Of hits with the same intent and address the first by rank."""
    rest = [c for c in hits.columns if c not in ("intent", "url")]
    return hits.groupBy("intent", "url").agg(F.min(F.struct(F.col("rank"), *(F.col(c) for c in rest if c != "rank"))).alias("h")).select("intent", "url", "h.*")


def independence(candidates: DataFrame) -> DataFrame:
    """Adds ``independence``: one over the number of a claim's candidates of the same family."""
    n = candidates.groupBy("claim_id", "family").agg(F.count("*").alias("n"))
    return candidates.join(n, ["claim_id", "family"]).withColumn("independence", F.lit(1.0) / F.col("n")).drop("n")


def evidence_pack(materials: DataFrame) -> DataFrame:
    """``materials(claim_id, source_version, tier, rank, family, url, blocks)`` -> the blocks chosen for each claim.

    Sources go by tier, rank, family and address, the first of each family before repeats; the first eight sources, two
    blocks of each, sixteen in all. ``truncated`` tells whether anything was left out.
    """
    order = [tier_rank(F.col("tier")), "rank", "family", "url"]
    by_family = Window.partitionBy("claim_id", "family").orderBy(*order)
    rows = materials.withColumn("repeat", F.row_number().over(by_family) > 1)
    by_claim = Window.partitionBy("claim_id").orderBy("repeat", *order)
    rows = rows.withColumn("place", F.row_number().over(by_claim))
    dropped = F.max((F.col("place") > MOST_SOURCES) | (F.col("blocks") > MOST_BLOCKS)).over(Window.partitionBy("claim_id"))
    rows = rows.withColumn("truncated", dropped).where(F.col("place") <= MOST_SOURCES)
    taken = rows.withColumn("block", F.explode(F.sequence(F.lit(1), F.least("blocks", F.lit(MOST_BLOCKS)))))
    position = F.row_number().over(Window.partitionBy("claim_id").orderBy("place", "block"))
    return taken.withColumn("position", position).where(F.col("position") <= MOST_EVIDENCE).select("claim_id", "position", "source_version", "tier", "family", "block", "truncated")


def risk_level(claim_type: Column, domain: Column, sensitivity: Column) -> Column:
    return (
        F.when(F.lower(strip(domain)).isin(*HIGH_RISK_DOMAINS), "HIGH")
        .when(claim_type.isin(*SUBJECTIVE_TYPES, *USER_TYPES), "LOW")
        .when(sensitivity == "PUBLIC", "LOW").otherwise("MEDIUM")
    )


def dimensions(evidence: DataFrame) -> DataFrame:
    """Per claim, from ``evidence(claim_id, stance, tier, relevance, coverage, family, version_match, freshness_match)``.

    Trusted results come from the two upper tiers with enough relevance. Coverage of the dimensions reads all results;
    what the verdict reads is in the columns that begin with ``support`` and ``contra``.
    """
    trusted = F.col("tier").isin(*TRUSTED_TIERS) & (F.col("relevance") >= LEAST_RELEVANCE)
    support, contra = trusted & (F.col("stance") == "SUPPORT"), trusted & (F.col("stance") == "CONTRADICT")
    return evidence.groupBy("claim_id").agg(
        F.count("*").alias("results"),
        F.max("coverage").alias("coverage"),
        F.least(F.count_distinct("family") / 2.0, F.lit(1.0)).alias("independence"),
        F.count(F.when(support, 1)).alias("supports"),
        F.count(F.when(contra, 1)).alias("contradictions"),
        F.max(F.when(support, F.col("coverage"))).alias("support_coverage"),
        F.max(F.when(contra, F.col("coverage"))).alias("contra_coverage"),
        F.coalesce(F.bool_or(F.when(support, F.col("version_match"))), F.lit(False)).alias("version_ok"),
        F.coalesce(F.bool_or(F.when(support, F.col("freshness_match"))), F.lit(False)).alias("freshness_ok"),
    )


def verdicts(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``claims(claim_id, claim_type, tier, owner, domain, sensitivity, version, freshness_at, search_available, unsafe)`` ->
    ``verdict, reason, risk, review_required, publishable``; the first rule that applies decides."""
    d = claims.join(dimensions(evidence), "claim_id", "left")
    needs_version = (F.col("claim_type") == "CODE_BEHAVIOR") | (F.coalesce("version", F.lit("")) != "")
    sound = (F.col("support_coverage") >= LEAST_COVERAGE) & (~needs_version | F.col("version_ok")) & (F.col("freshness_at").isNull() | F.col("freshness_ok"))
    supported, contradicted = F.coalesce("supports", F.lit(0)) > 0, F.coalesce("contradictions", F.lit(0)) > 0
    by_user = (F.col("tier") == "T0") & F.col("claim_type").isin(*USER_TYPES) & F.col("owner").isNotNull()
    rules = [
        (F.col("unsafe"), "QUARANTINED", "SAFETY_SIGNAL"),
        (F.col("claim_type").isin(*SUBJECTIVE_TYPES), "OPINION", "SUBJECTIVE_CLAIM"),
        (by_user, "USER_ASSERTED", "USER_OWNED_CLAIM"),
        (~F.col("search_available"), "INSUFFICIENT", "SEARCH_CAPABILITY_UNAVAILABLE"),
        (F.coalesce("results", F.lit(0)) == 0, "INSUFFICIENT", "EVIDENCE_MISSING"),
        (supported & contradicted, "CONTESTED", "TRUSTED_CONFLICT"),
        (supported & sound, "VERIFIED", "TRUSTED_SUPPORT"),
        (contradicted & ~supported & (F.col("contra_coverage") >= LEAST_COVERAGE), "REJECTED", "TRUSTED_CONTRADICTION"),
    ]
    verdict, reason = F.lit("INSUFFICIENT"), F.lit("EVIDENCE_COVERAGE_INSUFFICIENT")
    for condition, v, r in reversed(rules):
        verdict, reason = F.when(condition, v).otherwise(verdict), F.when(condition, r).otherwise(reason)
    risk = F.when(F.col("unsafe"), "HIGH").otherwise(risk_level(F.col("claim_type"), F.col("domain"), F.col("sensitivity")))
    out = d.select("claim_id", verdict.alias("verdict"), reason.alias("reason"), risk.alias("risk"))
    low = F.col("risk") == "LOW"
    review = F.when(F.col("verdict").isin("CONTESTED", "INSUFFICIENT"), True).when(F.col("verdict") == "QUARANTINED", False).otherwise(~low)
    return out.withColumn("review_required", review).withColumn("publishable", F.col("verdict").isin("OPINION", "USER_ASSERTED", "VERIFIED") & low)


# What makes claims a family, and what makes them the same.
FAMILY = ("claim_type", "predicate", "scope", "subject")
SAME = (*FAMILY, "freshness_at", "object", "sensitivity", "valid_from", "valid_to")


def fingerprints(claims: DataFrame) -> DataFrame:
    """``claims`` with ``family_key`` and ``fingerprint``: digests of canonical JSON, the scope without its nulls."""
    rows = claims
    for name, fields in (("family_key", FAMILY), ("fingerprint", SAME)):
        rows = digests(rows.withColumn("whole", F.struct(*fields)), "whole", name, sparse=("scope",)).drop("whole")
    return rows


# What of a claim may leave for a public search.
PUBLIC_FIELDS = ("claim_type", "subject", "predicate", "object", "scope")


def public_claims(claims: DataFrame) -> DataFrame:
    """``claim_id, payload``: the five public fields of each claim as canonical JSON, without nulls in its object and scope."""
    rows = claims.withColumn("whole", F.struct(*PUBLIC_FIELDS))
    return rows.select("claim_id", canonical_json(rows, "whole", sparse=("object", "scope")).alias("payload"))


def rollup(items: DataFrame) -> DataFrame:
    """Per change: counts by stage and the status of run and change. Any failure fails it, any review holds it back."""
    out = items.groupBy("change_id").agg(
        F.count("*").alias("items"),
        F.count(F.when((F.col("stage") == "DECIDED") & (F.col("verdict") != "QUARANTINED"), 1)).alias("decided"),
        F.count(F.when(F.col("verdict") == "QUARANTINED", 1)).alias("quarantined"),
        F.count(F.when(F.col("stage") == "REVIEW_REQUIRED", 1)).alias("review"),
        F.count(F.when(F.col("stage") == "FAILED", 1)).alias("failed"),
    )
    status = F.when(F.col("failed") > 0, "FAILED").when(F.col("quarantined") > 0, "QUARANTINED").when(F.col("review") > 0, "REVIEW_REQUIRED").otherwise("PUBLISH_INTENT")
    return out.withColumn("change_status", status)


def review_gate(reviews: DataFrame) -> DataFrame:
    """What each decision does to its change: approvals publish once no other review of the change is pending."""
    pending = reviews.groupBy("change_id").agg(F.count(F.when(F.col("status") == "PENDING", 1)).alias("pending"))
    outcome = F.when(F.col("status").isin("REJECTED", "CANCELLED"), "FAILED").when((F.col("status") == "APPROVED") & (F.col("pending") == 0), "PUBLISH_INTENT").otherwise("REVIEW_REQUIRED")
    return reviews.join(pending, "change_id").select("review_id", "change_id", "status", "pending", outcome.alias("outcome"))
