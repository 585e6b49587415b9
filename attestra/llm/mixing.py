"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is the mass it should have over the mass it has. Each document inverts the Poisson
distribution of its source's rate at a uniform number hashed from the seed and its id, is repeated that often, and the
copies are ordered globally by another hash. All of it is deterministic and expressed in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace

#: A larger rate is the sum of that many smaller ones, each with its own hash; 160 terms cover rate 32 beyond 2**-53.
TERM_RATE, TERMS = 32.0, 160


def _uniform(seed: str, *parts: Column) -> Column:
    """In [0, 1), in steps of 2**-52."""
    key = F.concat_ws("|", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """``source, rate``: the mean number of copies of a document of each source.

    Mass is counted in characters. ``weights`` are relative shares of the result by source; sources not named get none
    of it. Without weights every source with any text gets the same share. ``epochs`` is the mass of the result over
    the mass of the input. A null source is a source of its own, named by null; a source without mass has rate 0.
    """
    mass = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0))).cast("double").alias("mass"))
    if weights is None:
        weighed = mass.withColumn("weight", F.when(F.col("mass") > 0, 1.0).otherwise(0.0))
    else:
        named = docs.sparkSession.createDataFrame(list(weights.items()) or [("", 0.0)], "source string, weight double").withColumnRenamed("source", "named")
        weighed = mass.join(named, F.col("source") == F.col("named"), "left").select("source", "mass", F.when(F.col("mass") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(0.0).alias("weight"))
    total = weighed.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))
    share = F.col("weight") / F.col("all_weight")
    rate = F.when(F.col("weight") > 0, F.lit(float(epochs)) * share * F.col("all_mass") / F.col("mass")).otherwise(0.0)
    return weighed.crossJoin(F.broadcast(total)).select("source", rate.alias("rate"))  # one row of totals


def _with_terms(rates: DataFrame) -> DataFrame:
    """Adds the number of terms and the distribution function of one term."""
    out = rates.withColumn("terms", F.greatest(F.lit(1), F.ceil(F.col("rate") / TERM_RATE)).cast("int")).withColumn("term", F.col("rate") / F.col("terms"))
    steps = F.sequence(F.lit(1), F.lit(TERMS))
    first = F.struct(F.exp(-F.col("term")).alias("p"), F.array(F.exp(-F.col("term"))).alias("f"))
    grow = lambda acc, k: F.struct((acc["p"] * F.col("term") / k).alias("p"), F.concat(acc["f"], F.array(F.element_at(acc["f"], -1) + acc["p"] * F.col("term") / k)).alias("f"))
    return out.select("source", "terms", F.aggregate(steps, first, grow, lambda acc: acc["f"]).alias("f"))


def mixed(docs: DataFrame, ws: Workspace, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = "mix-1") -> DataFrame:
    """``docs(doc_id, text, source, ...)`` -> ``doc`` (the whole row), ``copy`` from 1, ``copies``, ``shuffle_key``.

    Rows come in the order of ``shuffle_key``. Rows with the same id have the same number of copies; a null id draws as
    the word null. Null texts have no mass but are repeated at their source's rate. An empty table gives an empty result.
    Columns of any name pass through inside ``doc``.
    """
    rates = ws.keep(_with_terms(source_rates(docs, weights, epochs)), "rates")  # its size is known, so Spark may broadcast it
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    joined = rows.join(rates, F.col("doc.source").cast("string").eqNullSafe(F.col("source")))
    draws = F.transform(F.sequence(F.lit(1), F.col("terms")), lambda i: _uniform(seed, F.col("doc.doc_id"), i))  # one hash a term
    count = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter("f", lambda c: c <= u)))
    counted = joined.select("doc", count.alias("copies")).where("copies > 0")
    copies = counted.select("doc", "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("null")), F.col("copy").cast("string")))
    return copies.withColumn("shuffle_key", key).repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark))
    return out.select("doc.*", "copy", "copies", "shuffle_key")


OP7_SQL = """
WITH mass AS (
  SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS mass FROM documents GROUP BY source
), weighed AS (
  SELECT source, mass, CASE WHEN mass > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM mass
), rates AS (
  SELECT source, CASE WHEN weight > 0 THEN weight / (sum(weight) OVER ()) * (sum(mass) OVER ()) / mass ELSE 0.0 END AS rate FROM weighed
), terms AS (
  SELECT source, greatest(1, ceil(rate / 32))::INT AS terms, rate / greatest(1, ceil(rate / 32)) AS term FROM rates
), distribution AS (
  WITH RECURSIVE d AS (
    SELECT source, terms, term, 0 AS k, exp(-term) AS p, exp(-term) AS f FROM terms
    UNION ALL
    SELECT source, terms, term, k + 1, p * term / (k + 1), f + p * term / (k + 1) FROM d WHERE k < 160
  ) SELECT source, k, f, terms FROM d
), drawn AS (
  SELECT doc_id, i, source, ('0x' || substr(md5('mix-1|' || doc_id::VARCHAR || '|' || i::VARCHAR), 1, 13))::UBIGINT::DOUBLE / 4503599627370496 AS u
  FROM documents JOIN terms USING (source), unnest(range(1, terms + 1)) AS r(i)
), counted AS (
  SELECT doc_id, count(*)::INT AS copies FROM drawn JOIN distribution USING (source) WHERE f <= u GROUP BY doc_id
)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, copies,
       md5('mix-1|order|' || doc_id::VARCHAR || '|' || copy::VARCHAR) AS shuffle_key
FROM documents JOIN counted USING (doc_id), unnest(range(1, copies + 1)) AS c(copy)
"""
