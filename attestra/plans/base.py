"""Registration of queries, and inputs derived from the tables by SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can express it, its twin."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return register


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs SQL whose tables stand in braces, as ``{documents}``."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def twin(sql: str) -> str:
    """The same SQL for an engine that knows the tables by name and names the digest otherwise."""
    return re.sub(r"\bsha2\((\w+), 256\)", r"sha256(\1)", re.sub(r"\{(\w+)\}", r"\1", sql))
