"""Token ids of a corpus as binary files, in document order.

Documents are range-partitioned by id, so file after file holds them in ascending order. Each attempt of a task streams
its partition into a file of its own in the shared folder, which must be in a store that Arrow opens (local, HDFS, S3,
Google). Only the manifest, a table that Spark commits, says which files count: it names those of the attempts that
succeeded, so what a lost executor or a repeated task leaves behind is never read, and nothing is renamed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import Encoder
from .pfor import Reader, Writer
from .shared import Workspace, small_batches

MANIFEST = "file string, shard int, n_documents long, n_tokens long"


def _write(folder: str, tokenizer: str, end_id: int):
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder.of(tokenizer), TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        writer, name = None, f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}.atpf"
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    writer = Writer(store.open_output_stream(name))
                writer.add(doc, ids)
                writer.end(end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "shard": task.partitionId(), "n_documents": len(writer.docs), "n_tokens": writer.total}], pa.schema([("file", pa.string()), ("shard", pa.int32()), ("n_documents", pa.int64()), ("n_tokens", pa.int64())]))

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """``docs(doc_id long, text string, ...)`` -> the manifest, a row for each file written.

    Null texts count as empty and hold the end id alone. Null ids come first; rows with equal ids stand in the order of
    a hash of their texts. An empty table writes no file.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return rows.select("doc_id", "text").mapInArrow(_write(folder, tokenizer, end_id), MANIFEST)


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                reader, out = Reader(store.open_input_file(row["file"])), []
                for doc, start, ids in reader.documents():
                    out.append((doc, row["first"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 10_000:
                        yield _rows(out)
                        out = []
                yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads the files back, a task each: every document's place among all ids, its length and a checksum of its ids.

    ``manifest`` is a written table; its number of rows is what the driver sees.
    """
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    files = manifest.withColumn("first", F.coalesce(before, F.lit(0))).select("file", "first", "shard")
    files = files.repartitionByRange(max(1, manifest.count()), "shard").select("file", "first")  # a given number isn't coalesced
    return files.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    ws = Workspace(spark)
    folder = ws.folder("token-files")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with small_batches(spark):
        manifest = ws.keep(write_token_files(docs, folder, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), 2), "manifest")
    return read_token_files(manifest, folder)
