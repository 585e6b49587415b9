"""What the operators share: the cluster's work folder, tables written to it, and Arrow batch plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables written between two collections of the driver's garbage: many small plans would else let its heap grow to its limit.
FREED_EVERY = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's name, so that other readers than Spark's find the same place."""
    if "://" in path:
        return path
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file:///") else full


def work_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent (tests on one machine) a temporary folder stands in; on a cluster that is an error,
    as executors could not see it.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark, "_attestra_work", None) or tempfile.mkdtemp(prefix="spark-attestra-")
        spark._attestra_work = base
    return f"{_qualified(spark, base).rstrip('/')}/attestra-{uuid.uuid4().hex}"


class Workspace:
    """Tables of one operator run, written as Parquet to the shared folder and read back.

    A written table cuts the lineage: an executor lost later costs a re-read, not a recomputation. The tables stay
    until ``drop`` is called, because the returned DataFrame reads them lazily.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self._n = spark, work_dir(spark), 0

    def folder(self, label: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{label}"

    def keep(self, df: DataFrame, label: str, one_file: bool = False) -> DataFrame:
        """``one_file`` is for a row a group: its size then shows that it is small, and joins with it don't shuffle."""
        with settings(self.spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):  # a step's shuffles end with it
            (df.repartition(1) if one_file else df).write.parquet(to := self.folder(label))
        if self._n % FREED_EVERY == 0:  # Spark drops shuffles and broadcasts when the driver collects garbage, and the heap shrinks
            self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, **values):
    """Session settings for the jobs run inside; ``__`` in a name stands for a dot."""
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 512):
    """Few rows in an Arrow batch, so that long texts don't add up in a Python worker."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=rows)


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z alone. ASCII texts take the engine's own fast path, which is the same for them."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
