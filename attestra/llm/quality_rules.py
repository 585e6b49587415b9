"""Quality rules and robust multivariate outliers.

Each text becomes a vector of transformed statistics. For every language and source a minimum-covariance-determinant
estimate describes the bulk of its texts, and a text whose squared Mahalanobis distance lies beyond a chi-squared quantile
is rejected. The estimate is found as in Hubert, Rousseeuw and Verdonck, "A deterministic algorithm for robust location
and scatter" (2012), and Rousseeuw and Van Driessen, "A fast algorithm for the minimum covariance determinant estimator"
(1999): four deterministic starts, two concentration steps each, then the start of least determinant goes on until the
determinant falls no more; consistency factors; one step of reweighting.

A step is one aggregation over all rows: sums by group and by step of the distance's logarithm, of which a group has a few
hundred at most. Its wanted share of nearest rows is what lies in the nearest of these. So a group of any size costs its
rows, nothing gathers in one place, and the outcome doesn't depend on how rows are dealt out. Estimates of small groups
shrink towards their language's, and those towards that of all texts, by numbers of rows; no size is treated apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, small_batches, utf8
from .words import shingle_hashes, word_hashes

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIM = 5
#: Share of a group's rows that determine its estimate at least; concentration steps before the best start is chosen, and after.
SHARE, FIRST_STEPS, MOST_STEPS = 0.75, 2, 30
#: Rows that a parent's estimate counts for in its children's.
PARENT_ROWS = 50
#: Words of average length that mean word lengths are smoothed by, and that length.
SMOOTH_WORDS, SMOOTH_LENGTH = 50, 5
#: The share of normal vectors that stays, and that enters reweighting.
CONFIDENCE, REWEIGHT = 0.999, 0.975
#: Steps of a value's histogram to one, and of a squared distance's to a factor of e.
VALUE_STEPS, DISTANCE_STEPS = 1000, 16


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the incomplete gamma function."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = 0
    while term > 1e-16 * total:
        n += 1
        term *= z / (a + n)
        total += term
    return total * math.exp(a * math.log(z) - z - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < p else (low, middle)
    return low


def consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of normal vectors must be multiplied by."""
    return 1.0 if share >= 1 else share / chi2_cdf(chi2_quantile(share, DIM), DIM + 2)


CUT, NEAR = chi2_quantile(CONFIDENCE, DIM), chi2_quantile(REWEIGHT, DIM)
#: What counts as a standard deviation at least; a statistic that most texts share has none of its own. A text that
#: repeats half its words, the base rule's limit, is by that alone just at the cut.
FLOOR = (0.25, 0.03, 0.10, 0.10, (0.5 / CUT) ** 0.5)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def text_statistics(text: bytes) -> tuple[int, ...]:
    raw = np.frombuffer(text, np.uint8)
    words = word_hashes(text, fold=False)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > 3:
        grams = shingle_hashes(words, 3)
        _, which, counts = np.unique(grams, return_inverse=True, return_counts=True)
        covered = np.zeros(len(words) + 1, np.int64)
        at = np.flatnonzero(counts[which] > 1)
        covered[at] += 1
        np.subtract.at(covered, np.minimum(at + 3, len(words)), 1)
        repeated = int(np.count_nonzero(np.cumsum(covered)[:-1]))
    chars = int(np.count_nonzero((raw & 0xC0) != 0x80)) - int(np.count_nonzero(_BLANK[raw]))
    return len(words), chars, int(np.count_nonzero(_SYMBOL[raw])), len(lines) - len(set(lines)), repeated


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([text_statistics(x) for x in utf8(batch.column("text"))], np.int64).reshape(-1, DIM)
        kept = [batch.column(c) for c in ("doc_id", "lang", "source")]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(rows[:, i]) for i in range(DIM))], ["doc_id", "lang", "source", *STATS])


def _vector() -> list[Column]:
    n, chars, symbols, lines, repeats = (F.col(c).cast("double") for c in STATS)
    words = F.greatest(n, F.lit(1.0))
    length = (chars + SMOOTH_WORDS * SMOOTH_LENGTH) / (words + SMOOTH_WORDS)
    return [F.log1p(n), F.log(length), F.sqrt(symbols / words), F.sqrt(lines / words), F.sqrt(repeats / words)]


def _quadratic(x: list[Column], matrix: Column) -> Column:
    terms = [x[i] * x[j] * matrix[i * DIM + j] for i in range(DIM) for j in range(DIM)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _distance() -> Column:
    return _quadratic([F.col("x")[i] - F.col("mean")[i] for i in range(DIM)], F.col("inverse"))


def _products(x: list[Column]) -> Column:
    return F.array(*(F.sum(x[i] * x[j]) for i in range(DIM) for j in range(DIM)))


def _step_of(d: Column) -> Column:
    return F.floor(F.log(F.greatest(d, F.lit(1e-6))) * DISTANCE_STEPS).cast("int")


def _model(mean: np.ndarray, cov: np.ndarray) -> tuple[list, list, float]:
    cov = cov + np.diag(np.square(FLOOR))
    inverse = np.linalg.inv(cov)
    return mean.tolist(), ((inverse + inverse.T) / 2).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


def _nearest(rows: pd.DataFrame, share: float) -> tuple[pd.DataFrame, float]:
    """The nearest steps that hold ``share`` of the rows, and the share that they do hold."""
    rows = rows.sort_values("step")
    n = rows["n"].cumsum().to_numpy()
    upto = int(np.searchsorted(n, math.ceil(share * n[-1]))) + 1
    return rows.iloc[:upto], float(n[upto - 1] / n[-1])


def _sum(column: pd.Series) -> np.ndarray:
    return np.sum(np.stack(column.to_list()), axis=0)


def _middles(rows: pd.DataFrame) -> pd.DataFrame:
    """``group, axis, value, n`` of one group -> its medians and deviations, to a step of the histogram."""
    middle, scale = [], []
    for axis in range(DIM):
        part = rows[rows["axis"] == axis].sort_values("value")
        v, n = part["value"].to_numpy(float) / VALUE_STEPS, part["n"].to_numpy()
        at = lambda v, n: float(v[np.searchsorted(np.cumsum(n), n.sum() / 2)])
        middle.append(at(v, n))
        away = np.abs(v - middle[-1])
        order = np.argsort(away, kind="stable")
        scale.append(float(np.hypot(1.4826 * at(away[order], n[order]), FLOOR[axis])))
    return pd.DataFrame({"group": [rows["group"].iloc[0]], "middle": [middle], "scale": [scale]})


def _starts(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of standardised vectors of one group -> a first model for each start, its correlations from

    nothing, hyperbolic tangents, spatial signs, and the nearer half.
    """
    n, middle, scale = rows["n"].sum(), np.array(rows["middle"].iloc[0]), np.array(rows["scale"].iloc[0])
    half, _ = _nearest(rows, 0.5)
    out = []
    for start, second in enumerate((None, _sum(rows["tangents"]) / n, _sum(rows["signs"]) / n, _sum(half["second"]) / half["n"].sum())):
        shape = np.eye(DIM)
        if second is not None:
            second = second.reshape(DIM, DIM)
            deviation = np.sqrt(np.diag(second) + 1e-9)
            shape = 0.999 * second / np.outer(deviation, deviation) + 0.001 * np.eye(DIM)
        inverse = np.linalg.inv(shape * np.outer(scale, scale))
        out.append((rows["group"].iloc[0], start, middle.tolist(), ((inverse + inverse.T) / 2).ravel().tolist(), np.inf, True))
    return pd.DataFrame(out, columns=["group", "start", "mean", "inverse", "size", "falling"])


def _concentrated(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums by step of distance of one group and start -> the model of its nearest rows; the old one where that is no smaller."""
    old = rows.iloc[0]
    near, share = _nearest(rows, SHARE)
    n = near["n"].sum()
    mean = _sum(near["first"]) / n
    mean, inverse, size = _model(mean, consistency(share) * (_sum(near["second"]).reshape(DIM, DIM) / n - np.outer(mean, mean)))
    if size < old["size"] - 1e-6:
        return pd.DataFrame([(old["group"], old["start"], mean, inverse, size, True)], columns=["group", "start", "mean", "inverse", "size", "falling"])
    return pd.DataFrame([(old["group"], old["start"], list(old["mean"]), list(old["inverse"]), old["size"], False)], columns=["group", "start", "mean", "inverse", "size", "falling"])


MODEL = "group string, start int, mean array<double>, inverse array<double>, size double, falling boolean"


def _concentration(rows: DataFrame, models: DataFrame, ws: Workspace) -> DataFrame:
    """One step for the models that still fall; the others as they are.

    The sums are written first: so they are dealt out by their steps, and a group gathers only a row for each.
    """
    x = [F.col("x")[i] for i in range(DIM)]
    far = rows.join(models.where("falling"), "group").withColumn("step", _step_of(_distance()))
    sums = far.groupBy("group", "start", "step").agg(
        F.count("*").alias("n"), F.array(*(F.sum(v) for v in x)).alias("first"), _products(x).alias("second"),
        F.first("mean").alias("mean"), F.first("inverse").alias("inverse"), F.first("size").alias("size"),
    )
    return ws.keep(sums, "sums").groupBy("group", "start").applyInPandas(_concentrated, MODEL).unionByName(models.where("not falling"))


def robust_estimates(rows: DataFrame, ws: Workspace) -> DataFrame:
    """``rows(group string, x array<double>)`` -> ``group, n, mean, covariance`` (reweighted), a row for each group.

    Groups of a single row or of one repeated vector are fine: floors keep every covariance regular. Rows with equal
    distances stand or fall together.
    """
    x = [F.col("x")[i] for i in range(DIM)]
    axes = rows.select("group", F.posexplode("x").alias("axis", "value"))
    histogram = axes.groupBy("group", "axis", F.floor(F.col("value") * VALUE_STEPS).alias("value")).agg(F.count("*").alias("n"))
    middles = ws.keep(ws.keep(histogram, "histogram").groupBy("group").applyInPandas(_middles, "group string, middle array<double>, scale array<double>"), "middles", one_file=True)
    z = [(F.col("x")[i] - F.col("middle")[i]) / F.col("scale")[i] for i in range(DIM)]
    apart = rows.join(middles, "group").select("group", "middle", "scale", F.array(*z).alias("z"))
    z = [F.col("z")[i] for i in range(DIM)]
    norm = F.greatest(sum((v * v for v in z[1:]), z[0] * z[0]), F.lit(1e-6))
    apart = apart.withColumn("step", _step_of(norm)).groupBy("group", "step").agg(
        F.count("*").alias("n"), _products(z).alias("second"), _products([v / F.sqrt(norm) for v in z]).alias("signs"), _products([F.tanh(v) for v in z]).alias("tangents"),
        F.first("middle").alias("middle"), F.first("scale").alias("scale"),
    )
    models = ws.keep(ws.keep(apart, "apart").groupBy("group").applyInPandas(_starts, MODEL), "starts", one_file=True)
    for _ in range(FIRST_STEPS):
        models = ws.keep(_concentration(rows, models, ws), "concentrated", one_file=True)
    best = models.groupBy("group").agg(F.min_by(F.struct("start", "mean", "inverse", "size"), F.struct("size", "start")).alias("m"))
    models = ws.keep(best.select("group", "m.*", F.lit(True).alias("falling")), "best", one_file=True)
    for _ in range(MOST_STEPS):
        models = ws.keep(_concentration(rows, models, ws), "concentrated", one_file=True)
        if not models.where("falling").limit(1).count():
            break
    near = rows.join(models.select("group", "mean", "inverse"), "group").where(_distance() <= NEAR)
    sums = near.groupBy("group").agg(F.count("*").alias("near"), F.array(*(F.sum(v) for v in x)).alias("first"), _products(x).alias("second"))
    sums = rows.groupBy("group").agg(F.count("*").alias("n")).join(sums, "group", "left").join(models.select("group", "mean", "inverse"), "group")
    return ws.keep(sums.mapInPandas(_reweighted, "group string, n long, mean array<double>, covariance array<double>"), "estimates", one_file=True)


def _reweighted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    factor = REWEIGHT / chi2_cdf(NEAR, DIM + 2)
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            if r.first is None or not r.near > 0:
                mean, cov = np.array(r.mean), np.linalg.inv(np.array(r.inverse).reshape(DIM, DIM))
            else:
                mean = np.array(r.first) / r.near
                cov = factor * (np.array(r.second).reshape(DIM, DIM) / r.near - np.outer(mean, mean)) + np.diag(np.square(FLOOR))
            out.append((r.group, r.n, mean.tolist(), cov.ravel().tolist()))
        yield pd.DataFrame(out, columns=["group", "n", "mean", "covariance"])


def _shrunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The estimates of all texts, of a language and of a source in it, each mixed into the next by numbers of rows."""
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            mean, cov = None, None
            for n, m, c in ((r.n0, r.m0, r.c0), (r.n1, r.m1, r.c1), (r.n2, r.m2, r.c2)):
                if m is None:
                    continue
                part = 1.0 if mean is None else n / (n + PARENT_ROWS)
                mean = np.array(m) * part + (0 if mean is None else mean * (1 - part))
                cov = np.array(c) * part + (0 if cov is None else cov * (1 - part))
            if mean is None:
                continue
            inverse = np.linalg.inv(cov.reshape(DIM, DIM))
            out.append((r.by_source, mean.tolist(), ((inverse + inverse.T) / 2).ravel().tolist()))
        yield pd.DataFrame(out, columns=["by_source", "mean", "inverse"])


def shrunk_estimates(groups: DataFrame, estimates: DataFrame) -> DataFrame:
    """``groups(by_source, by_lang)`` and the estimates of all three levels -> ``by_source, mean, inverse``."""
    level = lambda i: estimates.select(F.col("group").alias(f"g{i}"), F.col("n").alias(f"n{i}"), F.col("mean").alias(f"m{i}"), F.col("covariance").alias(f"c{i}"))
    rows = groups.join(level(0), F.col("g0") == ALL, "left").join(level(1), F.col("by_lang") == F.col("g1"), "left").join(level(2), F.col("by_source") == F.col("g2"), "left")
    return rows.mapInPandas(_shrunk, "by_source string, mean array<double>, inverse array<double>")


ALL = "[]"


def judged(docs: DataFrame, ws: Workspace) -> DataFrame:
    """A row for each row of ``docs(doc_id, text, lang, source, ...)``: statistics, ``base_failed``, ``kept``, ``distance``.

    Null and empty texts have no words and fail. Null languages and sources are groups of their own. The estimate reads
    all rows that pass the base rule; where there are none, ``distance`` is null, as it is for rows that fail that rule.
    Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in STATS)
    with small_batches(docs.sparkSession):
        stats = ws.keep(texts.mapInArrow(_statistics, schema), "statistics")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for c in ("lang", "source"))
    rows = stats.withColumn("base_failed", failed).withColumn("by_source", F.to_json(F.array(lang, source))).withColumn("by_lang", F.to_json(F.array(lang)))
    rows = rows.withColumn("x", F.array(*_vector()))
    levels = F.explode(F.array("by_source", "by_lang", F.lit(ALL))).alias("group")
    vectors = ws.keep(rows.where("not base_failed").select("by_source", "by_lang", "x"), "vectors").select(levels, "x")
    estimates = robust_estimates(vectors, ws)
    models = ws.keep(shrunk_estimates(rows.select("by_source", "by_lang").distinct(), estimates), "models", one_file=True)
    named = rows.join(models, "by_source", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True))
    return named.select("doc_id", *STATS, "base_failed", kept.alias("kept"), "distance")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark))
