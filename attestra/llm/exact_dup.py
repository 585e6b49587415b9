"""Exact deduplication as a stateful stream.

A Structured Streaming aggregation keyed by the SHA-256 of the normalised text keeps, in RocksDB state that never
expires, the digest, the number of texts and the row that stays: its id and its content locator (the file, as a hash of
its path, and the row in it). The stream reads a log of fingerprints, so state never holds a text. Hits, that is texts
whose digest the state has more than once, are grouped again by digest *and* full text, which compares their bytes;
should texts differ under one digest, their groups are split by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, lower_az, settings

#: Bytes of fingerprints that a micro-batch takes.
PER_BATCH = str(16 << 30)
LOG = "doc_id long, digest binary, sha string, file long, row long"


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def locations(docs: DataFrame) -> DataFrame:
    """``file, path``: the files that the locators of ``docs``, read from files, name."""
    return docs.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("path")).distinct()


def _located(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``doc`` (the whole row), and where it lies. Rows that don't come from files are written to one first."""
    place = (F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *place)
    except AnalysisException:
        return ws.keep(docs, "located").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *place)


def advance(spark: SparkSession, log: str, state: str, out: str) -> None:
    """Takes what is new in the fingerprint log into the state; changed groups go to ``out``, by epoch.

    A call with the same ``state`` goes on where the last one ended, also after a failure.
    """
    groups = (
        spark.readStream.schema(LOG).option("maxBytesPerTrigger", PER_BATCH).parquet(log)
        .groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))
    )

    def write(changed: DataFrame, epoch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    with settings(
        spark,
        spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true",
        spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
        spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB="256",
        spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false",  # else each of many small stores holds 4 MB at least
    ):
        query = groups.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()


def _groups(spark: SparkSession, out: str) -> DataFrame:
    """The latest epoch's row of each digest; counts only ever grow."""
    rows = spark.read.schema("digest binary, n long, keep struct<doc_id: long, file: long, row: long>").parquet(out)
    return rows.groupBy("digest").agg(F.max("n").alias("n"), F.max_by("keep", "n").alias("keep"))


def exact_duplicates(docs: DataFrame, ws: Workspace, digest: Callable[[Column], Column] = sha256_digest) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id long, text string, ...)`` -> a row for each input row, and the located input.

    The first has ``doc_id, keep_id, group_size, kept, text_sha256`` and the locator ``file, row``. Texts are equal when
    identical after lower-casing A-Z; null counts as empty. The row with the largest id stays; among rows that share
    that id, the one with the largest locator does, so exactly one row of a group is kept. Null ids rank below all
    others. An empty table gives an empty result; other columns pass through untouched in ``doc`` of the second.
    """
    spark = docs.sparkSession
    located = _located(docs, ws)
    text = lower_az(F.coalesce(F.col("doc.text").cast("string"), F.lit("")))
    log, out = ws.folder("fingerprints"), ws.folder("groups")
    prints = located.select(F.col("doc.doc_id").cast("long").alias("doc_id"), digest(text).alias("digest"), F.sha2(text, 256).alias("sha"), "file", "row")
    prints.write.parquet(log)
    spark.range(0).select(F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("struct<doc_id: long, file: long, row: long>").alias("keep")).write.parquet(f"{out}/epoch=-1")
    advance(spark, log, ws.folder("state"), out)
    groups = ws.keep(_groups(spark, out), "latest")  # written, so that Spark can split a hot digest in the join below
    prints = spark.read.schema(LOG).parquet(log)

    hits = ws.keep(groups.where("n > 1").select("digest"), "hits")
    texts = located.select(digest(text).alias("digest"), text.alias("text"), F.col("doc.doc_id").cast("long").alias("doc_id"), "file", "row")
    same = texts.groupBy("digest", "text").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))  # copies meet before they are dealt out
    same = same.select("digest", F.sha2("text", 256).alias("sha"), "n", "keep")
    exact = ws.keep(same.join(hits.hint("merge"), "digest"), "checked")  # hits are distinct; a semi-join would be moved to before the texts meet
    unlike = exact.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1")
    if unlike.limit(1).count():  # texts that differ share a digest: they part by their full SHA-256
        single = groups.join(unlike, "digest", "left_anti").select("digest", F.lit(None).cast("string").alias("part"), "n", "keep")
        parted = exact.join(unlike, "digest", "left_semi").select("digest", F.col("sha").alias("part"), "n", "keep")
        prints = prints.join(unlike.select("digest", F.lit(True).alias("unlike")), "digest", "left").withColumn("part", F.when(F.col("unlike"), F.col("sha"))).drop("unlike")
        named = prints.join(single.union(parted).withColumnRenamed("digest", "d").withColumnRenamed("part", "p"), F.col("digest").eqNullSafe(F.col("d")) & F.col("part").eqNullSafe(F.col("p")))
    else:
        named = prints.join(groups, "digest")
    kept = F.struct("doc_id", "file", "row").eqNullSafe(F.col("keep"))
    return named.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"), "file", "row"), located


def without_copies(docs: DataFrame, ws: Workspace) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows, located = exact_duplicates(docs, ws)
    dropped = ws.keep(rows.where(~F.col("kept")).select("file", "row"), "dropped")
    return located.join(dropped, ["file", "row"], "left_anti").select("doc.*")


def op2_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark))[0].select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
