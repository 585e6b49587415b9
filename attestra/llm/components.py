"""Connected components of an edge table by alternating large-star and small-star steps.

Each step maps every node to the smallest node around it, by aggregation and join (Kiveris et al., "Connected Components
in MapReduce and Beyond", SoCC 2014). No neighbour list is ever gathered: a node with many neighbours is a skewed join
key, which adaptive execution splits. Edges stay in written tables; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """``edges(a, b)`` of longs, ``a <> b`` -> ``(node, component)`` for each node that isn't its component's smallest.

    The rounds end when the edges no longer change, which is after a number of rounds logarithmic in the diameter.
    An empty edge table gives an empty result.
    """
    now, before = ws.keep(_small_star(edges), "star"), None
    while True:
        at = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if at == before or not at["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = at
        now = ws.keep(_small_star(_large_star(now)), "star")
