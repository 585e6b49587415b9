"""Retrieval over texts without tokens, and over texts whose tokens cancel out, against its SQL."""

import hashlib

import duckdb
import pytest

from attestra.catalog import ORACLE_SQL, QUERIES
from tests.compare import assert_same


def opposite() -> str:
    """Two words of one place with unlike signs."""
    seen: dict[int, tuple[str, int]] = {}
    for i in range(10_000):
        word = f"w{i}"
        digest = hashlib.sha256(word.encode()).digest()
        place, sign = int.from_bytes(digest[:4], "big") % 32, digest[4] & 1
        other = seen.setdefault(place, (word, sign))
        if other[1] != sign:
            return f"{other[0]} {word}"
    raise AssertionError


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Every third document has no vector of its own; so have two queries."""
    folder = tmp_path_factory.mktemp("odd")
    none = [None, "", " ?! ", opposite()]
    docs = [(i, none[i // 3 % 4] if i % 3 == 0 else " ".join(f"word{(i * j) % 41}" for j in range(1, 2 + i % 23)), "en", f"src{i % 3}", 1) for i in range(400)]
    asked = [(i, none[i % 4] if i < 4 else " ".join(f"word{(i + j) % 41}" for j in range(9))) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(str(folder / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["hash_embedding", "hybrid_bm25", "hybrid_retrieval", "rerank", "overlap_topk", "bm25_topk"])
def test_texts_without_a_vector(spark, odd, name):
    folder, con = odd
    assert_same(QUERIES[name](spark, folder), con, ORACLE_SQL[name])
