"""Lexical search by blocks: the same ranks as from all pairs, and no pair of a document and a query is shuffled."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from attestra.operators import retrieve

import __spark_entry__

from .compare import SF


@pytest.fixture(scope="module")
def texts(spark):
    # Words of very unlike frequency, ties, an empty and a null text.
    docs = [(i, " ".join(f"w{(i * j) % (3 + j)}" for j in range(i % 40))) for i in range(300)] + [(300, ""), (301, None), (302, "w1 " * 500)]
    asked = [(q, " ".join(f"w{(q + j) % 9}" for j in range(1 + q % 6))) for q in range(40)] + [(40, "nowhere"), (41, None)]
    queries = retrieve.term_counts(spark.createDataFrame(asked, "query_id long, text string"), "query_id", "text").cache()
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3).cache(), queries


def rows(ranks):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in ranks.collect())


@pytest.mark.parametrize("at_once", [1 << 16, 5])
def test_blocks_give_the_ranks_of_all_pairs(spark, texts, monkeypatch, at_once):
    monkeypatch.setattr(retrieve, "QUERY_TOKENS", at_once)  # 5: many blocks of queries
    docs, queries = texts
    overlap = retrieve.ranked(retrieve.overlap_scores(retrieve.term_counts(docs, "doc_id"), queries), 7, F.col("doc_id"))
    assert rows(retrieve.best_overlap(docs, queries, 7)) == rows(overlap)
    weights = retrieve.bm25_weights(docs, queries).cache()
    assert rows(retrieve.best_bm25(docs, weights, 7)) == rows(retrieve.ranked(retrieve.bm25_scores(docs, weights), 7, F.col("doc_id")))


@pytest.mark.parametrize("cells", [1, 100, 1 << 21])
def test_some_documents_at_a_time(texts, monkeypatch, cells):
    docs, queries = texts
    monkeypatch.setattr(retrieve, "CELLS", cells)
    block = retrieve.counted(docs).toArrow().combine_chunks().to_batches()[0]
    asked = queries.select("query_id", "token", F.col("tf").alias("weight")).toArrow().to_struct_array().combine_chunks()
    found = {}
    for part in retrieve._block_scores(block, asked, 4, 6):
        for r in part.to_pylist():
            found.setdefault(r["query_id"], []).append((-r["score"], r["doc_id"]))
    ranks = {}
    for r in retrieve.ranked(retrieve.overlap_scores(retrieve.term_counts(docs, "doc_id"), queries), 4, F.col("doc_id")).collect():
        ranks.setdefault(r["query_id"], []).append((-r["score"], r["doc_id"]))
    assert {q: sorted(x)[:4] for q, x in found.items()} == {q: sorted(x) for q, x in ranks.items()}


def test_overlap_of_given_pairs(spark, texts):
    docs, queries = texts
    every = retrieve.overlap_scores(retrieve.term_counts(docs, "doc_id"), queries)
    pairs = every.where("(query_id + doc_id) % 3 = 0").select("query_id", "doc_id")
    found = retrieve.overlap_of(pairs, retrieve.counted(docs), queries)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, every.join(pairs, ["query_id", "doc_id"]).select("query_id", "doc_id", "score").collect()))


@pytest.mark.parametrize("name", ["bm25_topk", "overlap_topk", "lexical_only"])
def test_pairs_are_not_shuffled(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert "MapInArrow" in plan
    assert name == "lexical_only" or not any("doc_id" in x for x in exchanges)  # the fusion there groups ranks, k a query
