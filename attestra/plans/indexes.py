"""Queries over kept indexes: built, changed and searched; each result is also to be had without an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieve
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex, recall
from ..sources.tables import table
from ..sources.versioned import Tables
from ..streaming.run import shared_folder
from .base import derived, query, twin
from .retrieve import BM25_SQL, TOP, _queries, ranked_sql

#: What the index holds at first, and what enters, in part in place of that.
FIRST = "SELECT doc_id AS chunk_id, doc_id % 3 AS version_id, text FROM {documents} WHERE lang <> 'es'"
SECOND = "SELECT doc_id AS chunk_id, doc_id % 3 + 3 AS version_id, concat(coalesce(text, ''), ' second edition of ', source) AS text FROM {documents} WHERE lang = 'es' OR source = 'src3'"
GONE = "SELECT doc_id AS chunk_id FROM {documents} WHERE source = 'src5'"
HELD = f"SELECT * FROM (SELECT * FROM ({twin(FIRST)}) WHERE chunk_id NOT IN (SELECT chunk_id FROM ({twin(SECOND)})) UNION ALL SELECT * FROM ({twin(SECOND)})) WHERE chunk_id NOT IN ({twin(GONE)})"


def _index(spark, sf) -> TextIndex:
    index = TextIndex(Tables(spark, shared_folder(spark, "index")))
    index.upsert(derived(spark, sf, FIRST), "first")
    index.upsert(derived(spark, sf, SECOND), "second")
    index.delete(derived(spark, sf, GONE), "gone")
    return index


@query("index_search", f"WITH held AS (SELECT chunk_id AS doc_id, text FROM ({HELD})), {BM25_SQL.replace('FROM documents', 'FROM held')}, {ranked_sql('r', 'b', TOP)} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM r")
def index_search(spark, sf):
    """BM25 after rows have been replaced, added and deleted."""
    return _index(spark, sf).search(_queries(spark, sf), TOP).withColumn("score", F.round("score", 6))


@query("index_readback", f"SELECT chunk_id, version_id, sha256(text) AS content_hash FROM ({HELD})")
def index_readback(spark, sf):
    """What the index says that it holds, after the same changes and a compaction."""
    index = _index(spark, sf)
    index.compact("compact")
    return index.lookup()


@query("index_lookup", f"WITH h AS ({HELD}) SELECT chunk_id, version_id, sha256(text) AS content_hash, 'ids' AS by FROM h WHERE chunk_id IN (SELECT item_id FROM benchmark) UNION ALL SELECT chunk_id, version_id, sha256(text), 'version' FROM h WHERE version_id = 4")
def index_lookup(spark, sf):
    index = _index(spark, sf)
    ids = table(spark, sf, "benchmark").select(F.col("item_id").alias("chunk_id"))
    by_ids = index.lookup(ids.unionByName(ids)).withColumn("by", F.lit("ids"))
    return by_ids.unionByName(index.lookup(version_id=4).withColumn("by", F.lit("version")))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), (F.col("vec_id") % 7).alias("kind"))


def _asked(rows):
    return rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


@query(
    "vector_index_exact",
    """WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 11 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END AS v, vec_id % 7 AS kind FROM embeddings WHERE vec_id % 13 <> 1),
    s AS (SELECT q.vec_id AS query_id, e.id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], v), 6) AS score FROM embeddings q, e WHERE q.vec_id % 20 = 0 AND kind <> 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, score, rank::INT AS rank FROM r WHERE rank <= 10""",
)
def vector_index_exact(spark, sf):
    """All lists are searched, under a filter, after some vectors have been turned round and some deleted."""
    rows = _vectors(spark, sf)
    index = VectorIndex(Tables(spark, shared_folder(spark, "vectors")))
    index.build(rows, "build")
    index.upsert(rows.where("id % 11 = 0").withColumn("vector", F.transform("vector", lambda x: -x)), "turn")
    index.delete(rows.where("id % 13 = 1"), "delete")
    return index.search(_asked(rows), 10, where=F.col("kind") != 3)


@query("vector_index_probed")
def vector_index_probed(spark, sf):
    """As many lists as a recall of 0.95 takes are searched; how much of the exact result that finds, by query."""
    rows = _vectors(spark, sf)
    index = VectorIndex(Tables(spark, shared_folder(spark, "vectors")))
    index.build(rows, "build")
    return recall(index.search(_asked(rows), 10, probes=index.probes_for(0.95, 10)), retrieve.nearest(rows.select("id", "vector"), _asked(rows), 10))
