"""The corpus pipeline: reject poor documents, drop exact and near copies, mix the sources, pack the tokens.

Each stage takes all that its predecessor kept, written as Parquet and read again. The first four return the columns of
``documents``; the last returns a row for each packed piece. A document that mixing repeats is there as often, with the
same id. SQL can't express the classifier, the sketches or the tokenizer: ``ORACLE_SQL`` is None.

All stages read whole texts of any length and give an empty result for an empty table; the first four pass other columns
of any name through, the last leaves them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import exact_dup, mixing, near_dup, packing, quality_model
from attestra.llm.shared import Workspace, small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that the classifier takes for good; those of score 0.5 or more.

    Null and empty texts have the model's constant as score. Rows are judged one by one, repeated ones alike; ids only name
    the labelled texts.
    """
    ws = Workspace(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    with small_batches(spark):
        give, model = quality_model.scorer(quality_model.fit(docs, labels, ws))
        good = ws.keep(docs.where(give(F.col("text")) >= 0.5), "good")
        model.destroy()
    return good


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of those with equal texts, the one of the largest id.

    Null and empty texts are equal. Of rows that share that id too, one stays; null ids rank below all others.
    """
    return exact_dup.without_copies(docs, Workspace(spark))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest id of each near-duplicate group.

    Texts without words are linked with nothing and stay, as do rows without an id. Where ids repeat, rows are told apart
    by their place: one row of a group stays, and rows that merely share an id with a dropped one aren't touched.
    """
    return near_dup.without_near_copies(docs, Workspace(spark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out rows so that each source has the same share of the text, in a new global order.

    Null texts have no mass; a null source is a source of its own. Rows that share an id are repeated equally often; their
    copies have equal places in the order, in which ties may fall either way.
    """
    return mixing.mixed(docs, Workspace(spark)).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all rows into windows.

    A null or empty text is its end token alone. Repeated rows and null ids are documents of their own.
    """
    return packing.packed(docs, Workspace(spark))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark)
    for name, stage in STAGES:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
    return docs
