"""A quality classifier on supervised subword embeddings.

Hashed words and byte n-grams each have a learned vector, and so have two marks for words that repeat what came before;
a document is the mean of its features' vectors, and a softmax layer gives the class. It is trained by stochastic gradient descent in numpy. The output is linear in the mean, so for
scoring each feature's vector shrinks to one number and a document's score needs one table lookup a feature.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, small_batches
from .words import mix, shingle_hashes, word_hashes

#: The training sample's expected numbers of documents and of features at most; all labelled ones up to those numbers.
SAMPLE, MOST_FEATURES = 3000, 1 << 25
BUCKETS, DIMENSIONS, EPOCHS, RATE, GRAMS = 1 << 17, 16, 6, 0.5, (3, 4)
_SHIFT = np.uint64(64 - 17)
_PIECE = 1 << 18


def features(text: bytes) -> np.ndarray:
    """A bucket for each word, each byte n-gram, and each word that repeats the last one or a run of three words."""
    words = word_hashes(text, fold=False)
    runs = shingle_hashes(words, 3)
    again = np.ones(len(runs), bool)
    again[np.unique(runs, return_index=True)[1]] = False
    out = [(words >> _SHIFT).astype(np.int32)]
    for mark, n in ((1, np.count_nonzero(words[1:] == words[:-1])), (2, np.count_nonzero(again))):
        out.append(np.full(n, int(mix(np.array([mark], np.uint64))[0] >> _SHIFT), np.int32))
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(raw), _PIECE):  # pieces overlap by what an n-gram needs
        buf = raw[at : at + _PIECE + max(GRAMS) - 1].astype(np.uint64)
        for n in GRAMS:
            last = min(_PIECE, len(buf) - n + 1)
            if last > 0:
                h = np.full(last, n, np.uint64)
                for i in range(n):
                    h = (h << np.uint64(8)) | buf[i : last + i]
                out.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> _SHIFT).astype(np.int32))
    return np.concatenate(out)


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their shares."""
    ids, n = np.unique(features(text), return_counts=True)
    return ids, (n / max(1, n.sum())).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Vectors, output weights and biases. Without both classes the model is a constant."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    share = np.bincount(labels.astype(int), minlength=2) / max(1, len(labels)) if len(labels) else np.array([0.5, 0.5])
    bias += np.log(np.clip(share, 1e-3, 1)).astype(np.float32)
    steps, total = 0, EPOCHS * max(1, len(bags))
    for _ in range(EPOCHS if len(set(labels.tolist())) == 2 else 0):
        for i in random.permutation(len(bags)):
            ids, w = bags[i]
            rate = np.float32(RATE * (1 - steps / total))
            steps += 1
            mean = w @ vectors[ids] if len(ids) else np.zeros(DIMENSIONS, np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            pull = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            if len(ids):
                # a feature's step grows with its share of the text, without vanishing in long ones
                vectors[ids] -= rate * np.sqrt(w)[:, None] * pull
    return {"vectors": vectors, "out": out, "bias": bias}


def scalar_table(model: dict[str, np.ndarray]) -> tuple[np.ndarray, float]:
    """What each feature adds to the log-odds of class 1, and the constant."""
    return model["vectors"] @ (model["out"][:, 1] - model["out"][:, 0]), float(model["bias"][1] - model["bias"][0])


def score(text: bytes, table: np.ndarray, constant: float) -> float:
    ids = features(text)
    z = float(table[ids].mean(dtype=np.float64)) + constant if len(ids) else constant
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        bags = [bag((t or "").encode()) for t in rows["text"]]
        yield pd.DataFrame({"doc_id": rows["doc_id"], "quality": rows["quality"], "ids": [i.astype("<i4").tobytes() for i, _ in bags], "shares": [w.astype("<f4").tobytes() for _, w in bags]})


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat([pd.DataFrame({"doc_id": [], "quality": [], "ids": [], "shares": []}), *batches]).sort_values(["doc_id", "ids", "shares"])
    bags = [(np.frombuffer(i, "<i4"), np.frombuffer(w, "<f4")) for i, w in zip(rows["ids"], rows["shares"], strict=True)]
    model = train(bags, rows["quality"].to_numpy(dtype=int))
    np.savez(buffer := io.BytesIO(), **model)
    yield pd.DataFrame({"model": [buffer.getvalue()]})


def held_out(doc_id="doc_id"):
    """Rows that no label is learned from: the CRC-32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, ws: Workspace, sample: int = SAMPLE) -> DataFrame:
    """One row with the trained model. Reads the labelled, not held-out documents, of which about ``sample`` at most.

    One task trains; it holds features only, and both bounds of the sample limit them. Labels other than 0 and 1, and null
    ids, are left out, and so are ids that have labels of both kinds. Documents that share an id each count with its label.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    share = sample / max(sample, known.count())
    drawn = ws.keep(known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000)), "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(drawn, "doc_id")
    bags = ws.keep(texts.mapInPandas(_bags, "doc_id long, quality int, ids binary, shares binary"), "bags")
    n = bags.agg(F.sum(F.length("ids") / 4)).first()[0] or 0
    if n > MOST_FEATURES:
        bags = bags.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1_000_000)) < int(MOST_FEATURES / n * 1_000_000))
    return ws.keep(bags.repartition(1).mapInPandas(_fit, "model binary"), "model")


def scorer(model: DataFrame):
    """A column function text -> score, and the broadcast that it needs: the model as one number a bucket, half a megabyte."""
    row = model.first()  # none without any labelled text: then the untrained model gives 0.5
    table, constant = scalar_table(np.load(io.BytesIO(bytes(row["model"]))) if row else train([], np.empty(0)))
    shared = model.sparkSession.sparkContext.broadcast((table.astype(np.float32), constant))

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        values, base = shared.value
        return pd.Series([score(t.encode() if t else b"", values, base) for t in texts], dtype="float64")

    return lambda text: scores(text.cast("string")), shared


def classified(docs: DataFrame, labels: DataFrame, ws: Workspace) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs(doc_id, text, ...)``.

    Null and empty texts have no features; their score is the constant of the model. Null ids count as not held out.
    Without labels of both kinds every score is the share of label 1 among them, or 0.5 without any.
    """
    with small_batches(docs.sparkSession):
        give, model = scorer(fit(docs, labels, ws))
        rows = docs.select("doc_id", held_out().alias("held_out"), give(F.col("text")).alias("score"))
        rows = ws.keep(rows, "scores")
        model.destroy()
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classified(docs, labels, Workspace(spark))
