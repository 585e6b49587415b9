"""Constraints of immutable tables as queries for what breaks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms of digests and of typed identifiers.
SHA256_FORM = "^[0-9a-f]{64}$"
ID_FORM = "_[0-9A-HJKMNP-TV-Z]{26}$"


def is_sha256(value: Column) -> Column:
    return value.rlike(SHA256_FORM)


def is_typed_id(value: Column, prefix: str) -> Column:
    return value.rlike("^" + prefix + ID_FORM)


def repeated_keys(rows: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys that occur more than once, among the rows of a partial index where given. Nulls never clash."""
    live = rows if where is None else rows.where(where)
    present = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return live.where(present).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """References to rows that aren't there."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti").groupBy(column).agg(F.count("*").alias("n"))


def broken(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Counts of rows for which a check is false, in one pass."""
    counts = rows.agg(*(F.count(F.when(~c, 1)).alias(name) for name, c in checks.items()))
    pairs = F.array(*(F.struct(F.lit(name).alias("check"), F.col(name).alias("n")) for name in checks))
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def entity_exists(references: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``references(type, id)`` of rows that are in the table of their type."""
    ids = [t.select(F.lit(name).alias("type"), F.col(key).cast("string").alias("id")) for name, (t, key) in tables.items()]
    return references.join(reduce(DataFrame.unionByName, ids), ["type", "id"], "left_semi")


def next_numbers(rows: DataFrame, key: str, number: str) -> DataFrame:
    return rows.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))
