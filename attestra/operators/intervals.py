"""Intervals and the points in them, as an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _nodes(start: Column, stop: Column, levels: int) -> Column:
    """The few aligned blocks, of sizes that are powers of two, that make up ``start .. stop``, ends included."""
    first = F.struct(start.alias("a"), stop.alias("b"), F.array().cast("array<struct<level: int, node: bigint>>").alias("nodes"))

    def step(acc: Column, level: Column) -> Column:
        a, b, nodes = acc["a"], acc["b"], acc["nodes"]
        block = lambda at: F.array(F.struct(level.alias("level"), at.alias("node")))
        none = F.array().cast("array<struct<level: int, node: bigint>>")
        left = F.when((a <= b) & (a % 2 == 1), block(a)).otherwise(none)
        right = F.when((a <= b) & (b % 2 == 0) & ~((a == b) & (a % 2 == 1)), block(b)).otherwise(none)
        return F.struct(F.shiftright(a + 1, 1).alias("a"), F.shiftright(b - 1, 1).alias("b"), F.concat(nodes, left, right).alias("nodes"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), first, step, lambda acc: acc["nodes"])


def points_in(intervals: DataFrame, points: DataFrame, key: str = "id", point: str = "point_id") -> DataFrame:
    """``intervals(key, start, stop)``, ``points(point, at)`` -> ``key, point`` for each interval that holds the point.

    Ends are included and are whole numbers; a null end is open. Each interval is cut into aligned blocks, at most two of each
    size, and each point lies in one block of each size, so a pair meets once and no interval meets a point outside it.
    Reversed intervals and null points hold and are in nothing. ``key`` and ``point`` may repeat; rows then pair by row.
    """
    c = F.col
    low, high = points.agg(F.min("at"), F.max("at")).first()
    if low is None:
        return intervals.select(key).join(points.select(point), F.lit(False))
    levels = (high - low).bit_length()
    start, stop = F.greatest(F.coalesce(c("start"), F.lit(low)), F.lit(low)) - low, F.least(F.coalesce(c("stop"), F.lit(high)), F.lit(high)) - low  # beyond the points nothing is met
    blocks = intervals.select(key, start.cast("long").alias("a"), stop.cast("long").alias("b")).where("a <= b").select(key, F.inline(_nodes(c("a"), c("b"), levels)))
    spots = points.where("at IS NOT NULL").select(point, F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda n: F.struct(n.alias("level"), F.call_function("shiftright", (c("at") - low).cast("long"), n).alias("node")))).alias("s"))
    return blocks.join(spots.select(point, "s.level", "s.node"), ["level", "node"]).select(key, point)
