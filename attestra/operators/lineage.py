"""What lies below given nodes of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.run import shared_folder


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``edges(src, dst)``, ``roots(node)`` -> ``node, depth``: each node once, with the least number of steps to it.

    A round joins the newest nodes with the edges and leaves out those known already, so circles end and a node that many
    paths reach is followed once. Rounds are written tables; the driver sees whether one is empty.
    """
    spark, base = edges.sparkSession, shared_folder(edges.sparkSession, "lineage")
    schema, depth = f"node {roots.schema['node'].dataType.simpleString()}, depth int", 0
    roots.select("node").distinct().select("node", F.lit(0).alias("depth")).write.parquet(f"{base}/round=0")
    while True:
        known = spark.read.schema(schema).parquet(*(f"{base}/round={i}" for i in range(depth + 1)))
        newest = spark.read.schema(schema).parquet(f"{base}/round={depth}")
        if not newest.limit(1).count():
            return known
        depth += 1
        below = edges.join(newest.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        below.join(known.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth")).write.parquet(f"{base}/round={depth}")
