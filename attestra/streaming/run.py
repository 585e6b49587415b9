"""Running a stream over the files there are, to its end."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one where that is unset and Spark runs on one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-attestra-")
    return f"{base.rstrip('/')}/attestra-{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: computed once, of known size."""
    rows.write.parquet(to := shared_folder(rows.sparkSession, name))
    return rows.sparkSession.read.schema(rows.schema).parquet(to)


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"  # a file or a folder; streams take single files by pattern only
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def finished(stream: DataFrame, mode: str, close: Callable[[], None] | None = None) -> DataFrame:
    """Everything the stream emits until its input ends, one folder an epoch: an epoch run again overwrites its own.

    ``close`` adds what ends the input; the stream then goes on from where it stood.
    """
    spark = stream.sparkSession
    base = shared_folder(spark, "stream")

    def write(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    def run() -> None:
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()

    run()
    if close is not None:
        close()
        run()
    return spark.read.schema(stream.schema.add("epoch", "long")).parquet(f"{base}/out")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State with timers and several variables a key lives in RocksDB."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
