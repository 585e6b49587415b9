"""Document versions as a stream keyed by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .run import finished, source


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies and first document of each content, kept as state; the last emission of a hash is its result."""
    d = source(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    out = finished(d.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")), "update")
    last = out.groupBy("content_hash").agg(F.max(F.struct("epoch", "copies", "first_doc")).alias("r"))
    return last.select("content_hash", "r.copies", "r.first_doc")
