"""Files as rows: Markdown folders, strict JSON lines, and their export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def markdown_listing(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, modificationTime, content`` of all Markdown files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(folder)


def stable_documents(first: DataFrame, second: DataFrame, most_bytes: int) -> DataFrame:
    """Two listings of the same folder -> ``path, text, content_hash, error``.

    A file that changed or went between them is UNSTABLE_FILE, a larger one TOO_LARGE, one that isn't UTF-8 DECODE.
    """
    seen = first.select("path", F.col("length").alias("l"), F.col("modificationTime").alias("m"))
    rows = second.join(seen, "path", "full_outer")
    steady = (F.col("length") == F.col("l")) & (F.col("modificationTime") == F.col("m"))
    error = F.when(~F.coalesce(steady, F.lit(False)), "UNSTABLE_FILE").when(F.col("length") > most_bytes, "TOO_LARGE").when(~F.is_valid_utf8(F.col("content").cast("string")), "DECODE")
    text = F.regexp_replace(F.col("content").cast("string"), "^﻿", "")
    return rows.select("path", F.when(error.isNull(), text).alias("text"), F.when(error.isNull(), F.sha2("content", 256)).alias("content_hash"), error.alias("error"))


def strict_json_lines(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """JSON lines of exactly this schema. A malformed or blank line fails the read, a repeated key the first action."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    once = rows.groupBy(key).agg(F.count("*").alias("n"))
    unique = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return rows.join(once.where(unique).select(key), key)


def export_json_lines(rows: DataFrame, path: str) -> None:
    """One line a row, keys in alphabetical order."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("error").text(path)


def write_snapshots(new: DataFrame, path: str) -> None:
    """Adds write-once contents by the first digits of their hashes; ``new`` holds only what isn't stored."""
    new.write.mode("append").partitionBy("folder").parquet(path)
