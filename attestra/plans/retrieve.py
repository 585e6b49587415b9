"""Queries over retrieval: embeddings, lexical scores, ranks, fusion, filters, reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import intervals, retrieve
from ..sources.tables import spread, table
from ..streaming.run import kept
from .base import derived, query, twin

TOKENS = "regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+')"
TOP, CANDIDATES = 5, retrieve.candidate_count(5)
DIM = 32

POSTINGS_SQL = f"p AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS token FROM documents) GROUP BY 1, 2)"
QUERY_SQL = f"q AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS token FROM benchmark) GROUP BY 1, 2)"
OVERLAP_SQL = f"{POSTINGS_SQL}, {QUERY_SQL}, o AS (SELECT query_id, doc_id, sum(least(tf, qtf))::DOUBLE AS score FROM p JOIN q USING (token) GROUP BY 1, 2)"


def ranked_sql(name: str, source: str, k: int, digits: int = 6) -> str:
    return f"{name} AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, {digits}) DESC, doc_id) AS rank FROM {source}) WHERE rank <= {k})"


def _documents(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def _postings(spark, sf):
    return retrieve.term_counts(_documents(spark, sf), "doc_id", "text")


def _queries(spark, sf):
    return retrieve.term_counts(table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id"), "query_id", "text")


@query("term_counts", f"WITH {POSTINGS_SQL} SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS tokens, max(tf) AS most FROM p GROUP BY doc_id")
def term_counts(spark, sf):
    return _postings(spark, sf).groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"), F.max("tf").alias("most"))


@query("overlap_topk", f"WITH {OVERLAP_SQL}, {ranked_sql('r', 'o', TOP)} SELECT query_id, doc_id, score, rank::INT AS rank FROM r")
def overlap_topk(spark, sf):
    return retrieve.best_overlap(_documents(spark, sf), _queries(spark, sf), TOP)


BM25_SQL = f"""{POSTINGS_SQL}, {QUERY_SQL}, l AS (SELECT doc_id, sum(tf) AS length FROM p GROUP BY 1),
  c AS (SELECT count(*)::DOUBLE AS docs, avg(length) AS mean FROM l), d AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
  b AS (SELECT query_id, p.doc_id, sum(qtf * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
        FROM q JOIN p USING (token) JOIN d USING (token) JOIN l ON l.doc_id = p.doc_id, c GROUP BY 1, 2)"""


@query("bm25_topk", f"WITH {BM25_SQL}, {ranked_sql('r', 'b', TOP)} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM r")
def bm25_topk(spark, sf):
    docs = kept(retrieve.counted(_documents(spark, sf)), "counts")
    return _bm25(docs, _queries(spark, sf), TOP).withColumn("score", F.round("score", 6))


def _bm25(docs, queries, k):
    weights = kept(retrieve.bm25_weights(docs, queries), "weights")  # as long as the queries; written, its size is known
    return retrieve.best_bm25(docs, weights, k)


BUCKET_SQL = f"('0x' || substr(sha256(token), 1, 8))::BIGINT % {DIM}"
SIGN_SQL = "CASE WHEN ('0x' || substr(sha256(token), 9, 2))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END"


def places_sql(e: str, n: str, counts: str, key: str, times: str, rows: str) -> str:
    """Places of vectors and their lengths: a row without tokens, or whose tokens all cancel out, has the first unit vector."""
    return f"""{e}_ AS (SELECT {key}, {BUCKET_SQL} AS i, sum({times} * {SIGN_SQL})::DOUBLE AS v FROM {counts} GROUP BY 1, 2), {n}_ AS (SELECT {key}, sqrt(sum(v * v)) AS n FROM {e}_ GROUP BY 1 HAVING sum(v * v) > 0),
  {n} AS (SELECT {key}, coalesce(n, 1) AS n FROM (SELECT {rows}) LEFT JOIN {n}_ USING ({key})),
  {e} AS (SELECT {e}_.* FROM {e}_ JOIN {n}_ USING ({key}) UNION ALL SELECT {key}, 0, 1 FROM {n} WHERE {key} NOT IN (SELECT {key} FROM {n}_))"""


PLACES_SQL = places_sql("e", "n", "p", "doc_id", "tf", "doc_id FROM documents")
QUERY_PLACES_SQL = places_sql("qe", "qn", "q", "query_id", "qtf", "item_id AS query_id FROM benchmark")


@query("hash_embedding", f"WITH {POSTINGS_SQL}, {PLACES_SQL} SELECT doc_id, i::INT AS place, round(v / n, 6) AS value FROM e JOIN n USING (doc_id) WHERE v <> 0")
def hash_embedding(spark, sf):
    v = retrieve.hash_embedding(_documents(spark, sf), "doc_id", "text", DIM)
    return v.select("doc_id", F.posexplode("vector").alias("place", "value")).where("value <> 0").withColumn("value", F.round("value", 6))


@query(
    "dense_topk",
    """
    WITH s AS (
      SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
      FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
    SELECT query_id, doc_id, score, rank::INT AS rank FROM r WHERE rank <= 10""",
)
def dense_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return retrieve.nearest(rows, rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 10)


@query("vector_checks", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm, len(embedding) AS dimension, true AS finite FROM embeddings")
def vector_checks(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 4).alias("norm"), F.size("embedding").cast("long").alias("dimension"), vectors.finite(F.col("embedding")).alias("finite"))


ROWS = """SELECT doc_id, text, 'n' || cast(doc_id % 211 AS string) AS note_id, doc_id % 3 AS version_id, 1 AS generation,
  CASE WHEN doc_id % 10 < 6 THEN 'VERIFIED' WHEN doc_id % 10 = 6 THEN 'USER_ASSERTED' WHEN doc_id % 10 = 7 THEN 'OPINION' ELSE 'OUTDATED' END AS status,
  CASE WHEN doc_id % 4 < 2 THEN 'PUBLIC' WHEN doc_id % 4 = 2 THEN 'RESTRICTED' ELSE 'PRIVATE' END AS sensitivity,
  CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1000 * (doc_id % 50) END AS valid_from, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 20000 + 1000 * (doc_id % 40) END AS valid_to,
  CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 15000 + 1000 * (doc_id % 60) END AS freshness_at FROM {documents}"""
ALLOWED_SQL = """status IN ('VERIFIED', 'USER_ASSERTED') AND sensitivity IN ('PUBLIC', 'RESTRICTED') AND generation = 1
  AND (valid_from = 0 OR valid_from <= 30000) AND (valid_to = 0 OR valid_to >= 30000) AND (freshness_at = 0 OR freshness_at >= 30000)"""


def _allowed(spark, sf):
    return derived(spark, sf, ROWS).where(retrieve.allowed(F.lit(30000), 1, ("VERIFIED", "USER_ASSERTED"), ("PUBLIC", "RESTRICTED"), False))


@query("hard_filter", f"SELECT doc_id, note_id, version_id, status, sensitivity FROM ({twin(ROWS)}) WHERE {ALLOWED_SQL}")
def hard_filter(spark, sf):
    return _allowed(spark, sf).select("doc_id", "note_id", "version_id", "status", "sensitivity")


TIMES = "SELECT DISTINCT event_id % 67 AS point_id, 1000 * (event_id % 67) - 2000 AS at FROM {events}"


@query("validity_at_times", f"SELECT doc_id, point_id FROM ({twin(ROWS)}) JOIN ({twin(TIMES)}) t(point_id, moment) ON (valid_from = 0 OR valid_from <= moment) AND (valid_to = 0 OR valid_to >= moment)")
def validity_at_times(spark, sf):
    """Which rows are valid at each of many times; 0 is an open end."""
    rows = derived(spark, sf, ROWS).select("doc_id", F.nullif("valid_from", F.lit(0)).alias("start"), F.nullif("valid_to", F.lit(0)).alias("stop"))
    return intervals.points_in(rows, derived(spark, sf, TIMES), "doc_id")


POINTERS = "SELECT 'n' || cast(doc_id % 211 AS string) AS note_id, min(doc_id % 3) AS version_id, 1 AS generation FROM {documents} GROUP BY 1"


@query("current_version_filter", f"SELECT doc_id, r.note_id, r.version_id FROM ({twin(ROWS)}) r JOIN ({twin(POINTERS)}) p ON r.note_id = p.note_id AND r.version_id = p.version_id AND r.generation = p.generation")
def current_version_filter(spark, sf):
    return retrieve.current_only(derived(spark, sf, ROWS), derived(spark, sf, POINTERS)).select("doc_id", "note_id", "version_id")


HYBRID_SQL = f"""
  WITH a AS (SELECT * FROM ({twin(ROWS)}) WHERE {ALLOWED_SQL}), {POSTINGS_SQL.replace("FROM documents", "FROM a")}, {QUERY_SQL}, {PLACES_SQL.replace("FROM documents", "FROM a")}, {QUERY_PLACES_SQL},
  dense AS (SELECT q.query_id, d.doc_id, coalesce(s.score, 0) AS score FROM qn q CROSS JOIN (SELECT doc_id FROM a) d LEFT JOIN
    (SELECT query_id, doc_id, sum((qe.v / qn.n) * (e.v / n.n)) AS score FROM qe JOIN qn USING (query_id) JOIN e USING (i) JOIN n USING (doc_id) GROUP BY 1, 2) s ON s.query_id = q.query_id AND s.doc_id = d.doc_id),
  lexical AS (SELECT q.query_id, d.doc_id, coalesce(s.score, 0) AS score FROM qn q CROSS JOIN (SELECT doc_id FROM a) d LEFT JOIN
    (SELECT query_id, doc_id, sum(least(tf, qtf))::DOUBLE AS score FROM p JOIN q USING (token) GROUP BY 1, 2) s ON s.query_id = q.query_id AND s.doc_id = d.doc_id),
  {ranked_sql("r1", "dense", CANDIDATES)}, {ranked_sql("r2", "lexical", CANDIDATES)},
  f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM r1 UNION ALL SELECT query_id, doc_id, rank FROM r2) GROUP BY 1, 2),
  {ranked_sql("c", "f", CANDIDATES, 12)},
  k AS (SELECT c.query_id, c.doc_id, c.score FROM c JOIN a USING (doc_id) JOIN ({twin(POINTERS)}) g ON a.note_id = g.note_id AND a.version_id = g.version_id AND a.generation = g.generation)"""


def _searched(spark, sf):
    """The documents that may be found, as token counts written once, and the queries with theirs."""
    docs = kept(retrieve.counted(spread(_allowed(spark, sf).select("doc_id", "text"))), "counts")
    return docs, table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id"), _queries(spark, sf)


def _dense(docs, queries):
    vectors_ = retrieve.hash_embedding(docs, "doc_id", "text", DIM).withColumnRenamed("doc_id", "id")
    return retrieve.nearest(vectors_, retrieve.hash_embedding(queries, "query_id", "text", DIM), CANDIDATES)


def _candidates(spark, sf):
    """Filter, rank both ways, fuse, cut; then what isn't current goes. Gives what was searched and the queries' tokens too."""
    docs, queries, terms = _searched(spark, sf)
    scores = kept(retrieve.best_overlap(docs, terms, CANDIDATES), "overlap")
    lexical = retrieve.with_unscored(scores, docs, queries, CANDIDATES)
    best = retrieve.fused([_dense(docs, queries), retrieve.ranked(lexical, CANDIDATES, F.col("doc_id"))], CANDIDATES)
    named = best.join(_allowed(spark, sf).select("doc_id", "note_id", "version_id", "generation"), "doc_id")
    return retrieve.current_only(named, derived(spark, sf, POINTERS)).select("query_id", "doc_id", "score"), docs, terms


@query("hybrid_retrieval", HYBRID_SQL + ", " + ranked_sql("t", "k", TOP, 12) + " SELECT query_id, doc_id, round(score, 9) AS score, rank::INT AS rank FROM t")
def hybrid_retrieval(spark, sf):
    return retrieve.ranked(_candidates(spark, sf)[0], TOP, F.col("doc_id"), 12).withColumn("score", F.round("score", 9))


@query(
    "hybrid_bm25",
    HYBRID_SQL
    + """, l AS (SELECT doc_id, sum(tf) AS length FROM p GROUP BY 1), co AS (SELECT count(*)::DOUBLE AS docs, avg(length) AS mean FROM l), df AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
    b AS (SELECT query_id, p.doc_id, sum(qtf * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
      FROM q JOIN p USING (token) JOIN df USING (token) JOIN l ON l.doc_id = p.doc_id, co GROUP BY 1, 2), """
    + ranked_sql("r3", "b", CANDIDATES)
    + """, f2 AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM r1 UNION ALL SELECT query_id, doc_id, rank FROM r3) GROUP BY 1, 2), """
    + ranked_sql("t", "f2", TOP, 12)
    + " SELECT query_id, doc_id, round(score, 9) AS score, rank::INT AS rank, false AS degraded FROM t",
)
def hybrid_bm25(spark, sf):
    docs, queries, terms = _searched(spark, sf)
    lexical = _bm25(docs, terms, CANDIDATES)
    return retrieve.degraded({"dense": _dense(docs, queries), "lexical": lexical}, TOP).withColumn("score", F.round("score", 9))


@query(
    "lexical_only",
    f"WITH {OVERLAP_SQL}, {ranked_sql('r', 'o', CANDIDATES)}, f AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS score FROM r), {ranked_sql('t', 'f', TOP, 12)} SELECT query_id, doc_id, round(score, 9) AS score, rank::INT AS rank, true AS degraded FROM t",
)
def lexical_only(spark, sf):
    """What retrieval gives where no vectors are to be had."""
    lexical = retrieve.best_overlap(_documents(spark, sf), _queries(spark, sf), CANDIDATES)
    return retrieve.degraded({"dense": None, "lexical": lexical}, TOP).withColumn("score", F.round("score", 9))


@query(
    "rerank",
    HYBRID_SQL
    + """, v AS (SELECT k.query_id, k.doc_id, k.score, coalesce(l.score, 0) AS overlap FROM k LEFT JOIN lexical l ON l.query_id = k.query_id AND l.doc_id = k.doc_id),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, round(score, 12) DESC, doc_id) AS rank FROM v)
    SELECT query_id, doc_id, overlap, rank::INT AS rank FROM t WHERE rank <= 5""".replace("k.score, coalesce", "k.score AS score, coalesce"),
)
def rerank(spark, sf):
    hits, docs, terms = _candidates(spark, sf)
    hits = kept(hits, "hits")
    return retrieve.reranked(hits, retrieve.overlap_of(hits, docs, terms), TOP).select("query_id", "doc_id", "overlap", "rank")


#: A reranker that turns every order round, and for some queries leaves one out, gives one twice, makes one up or says nothing.
FAULTS_SQL = """f AS (SELECT query_id, query_id % 5 AS kind, doc_id, score, rank AS r, 100 - rank AS place, rank * 1.5 AS rerank_score FROM r),
  a AS (SELECT query_id, place, doc_id, rerank_score FROM f WHERE kind <> 4 AND NOT (kind = 1 AND r = 2) UNION ALL SELECT query_id, 200, doc_id, 0.0 FROM f WHERE kind = 2 AND r = 1 UNION ALL SELECT query_id, 200, -1, 0.0 FROM f WHERE kind = 3 AND r = 1)"""


@query(
    "rerank_fallback",
    f"""WITH {OVERLAP_SQL}, {ranked_sql("r", "o", TOP)}, {FAULTS_SQL},
    s AS (SELECT query_id FROM a GROUP BY 1 HAVING count(*) = count(DISTINCT doc_id) AND bool_and(EXISTS (SELECT 1 FROM f WHERE f.query_id = a.query_id AND f.doc_id = a.doc_id)))
    SELECT f.query_id, f.doc_id, f.score, CASE WHEN s.query_id IS NOT NULL THEN a.rerank_score::DOUBLE END AS rerank_score, row_number() OVER (PARTITION BY f.query_id ORDER BY CASE WHEN s.query_id IS NOT NULL THEN a.place END, f.score DESC, f.doc_id)::INT AS rank, s.query_id IS NULL AS degraded
    FROM f LEFT JOIN s USING (query_id) LEFT JOIN a ON s.query_id IS NOT NULL AND a.query_id = f.query_id AND a.doc_id = f.doc_id WHERE s.query_id IS NULL OR a.place IS NOT NULL""",
)
def rerank_fallback(spark, sf):
    hits = kept(overlap_topk(spark, sf), "hits")
    rows = hits.select("query_id", (F.lit(100) - F.col("rank")).alias("place"), "doc_id", (F.col("rank") * 1.5).alias("score"), (F.col("query_id") % 5).alias("kind"), "rank")
    said = rows.where("kind <> 4 AND NOT (kind = 1 AND rank = 2)").select("query_id", "place", "doc_id", "score")
    twice = rows.where("kind = 2 AND rank = 1").select("query_id", F.lit(200).alias("place"), "doc_id", F.lit(0.0).alias("score"))
    made_up = rows.where("kind = 3 AND rank = 1").select("query_id", F.lit(200).alias("place"), F.lit(-1).cast("long").alias("doc_id"), F.lit(0.0).alias("score"))
    return retrieve.rescored(hits.select("query_id", "doc_id", "score"), said.unionByName(twice).unionByName(made_up))
