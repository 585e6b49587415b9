"""Digests and identifiers derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, nfc


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def path_key(path: Column) -> Column:
    """One key for all spellings of a path: normal form C, folded."""
    return sha256(fold(nfc(path)))


def file_key(device: Column, inode: Column) -> Column:
    """Null unless both are known."""
    return sha256(F.concat(device.cast("string"), F.lit(":"), inode.cast("string")))


def chunk_id(version: Column, chunker: str, ordinal: Column, text: Column) -> Column:
    return sha256(F.concat_ws("|", version, F.lit(chunker), ordinal.cast("string"), text))


def candidate_id(source_version: Column, position: Column) -> Column:
    return F.concat(F.lit("evidence_candidate_"), F.substring(sha256(F.concat_ws(":", source_version, position.cast("string"))), 1, 24))


def item_operation_id(run: Column, item: Column) -> Column:
    return F.concat(F.lit("ingop_"), sha256(F.concat_ws(":", run, item, F.lit("1"))))

