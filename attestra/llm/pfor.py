"""A binary file of token ids: patched frame-of-reference blocks, an index of block starts, and one of documents.

Layout, little-endian: ``b"ATPF0001"``; the blocks; the footer (block starts u64 each; for each document its id i64,
whether it has one u8, its number of ids u64); then u64 number of blocks, u64 documents, u64 ids, u32 ids in a block,
``b"ATPF0001"``. A block is: u32 minimum, u32 values, u32 exceptions, u8 bit width; the values less the minimum, packed
at that width; positions u16 and values u32 of the exceptions, which are what doesn't fit the width.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

MAGIC, BLOCK, PERCENTILE = b"ATPF0001", 4096, 95
_HEAD, _TAIL = struct.Struct("<IIIB"), struct.Struct("<QQQI8s")


def encode_block(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(values.min())
    rest = values - np.uint32(low)
    width = max(1, int(np.partition(rest, at := min(len(rest) - 1, int(len(rest) * percentile / 100)))[at]).bit_length())
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, int)
    body = rest.astype("<u4")
    bits = np.unpackbits(body.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return _HEAD.pack(low, len(values), len(over), width) + np.packbits(bits, bitorder="little").tobytes() + over.astype("<u2").tobytes() + body[over].tobytes()


def decode_block(data: bytes) -> np.ndarray:
    low, n, over, width = _HEAD.unpack_from(data)
    at, to = _HEAD.size, _HEAD.size + (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, to - at, at), count=n * width, bitorder="little").reshape(n, width)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :width] = bits
    values = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)
    where = np.frombuffer(data, "<u2", over, to)
    values[where] = np.frombuffer(data, "<u4", over, to + 2 * over)
    return values + np.uint32(low)


class Writer:
    """Streams documents into a file; holds one block and the two indexes."""

    def __init__(self, out):
        self.out, self.at, self.starts, self.docs, self.part, self.pending, self.total = out, len(MAGIC), [], [], [], 0, 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((0 if doc_id is None else doc_id, doc_id is not None, len(ids)))
        self.total += len(ids)
        self._put(ids)

    def end(self, ids: np.ndarray) -> None:
        """Further ids of the document added last."""
        doc_id, known, n = self.docs[-1]
        self.docs[-1] = (doc_id, known, n + len(ids))
        self.total += len(ids)
        self._put(ids)

    def _put(self, ids: np.ndarray) -> None:
        while len(ids):
            take = ids[: BLOCK - self.pending]
            self.part.append(take)
            self.pending += len(take)
            ids = ids[len(take) :]
            if self.pending == BLOCK:
                self._flush()

    def _flush(self) -> None:
        if self.pending:
            self.starts.append(self.at)
            self.out.write(data := encode_block(np.concatenate(self.part)))
            self.at += len(data)
            self.part, self.pending = [], 0

    def close(self) -> None:
        self._flush()
        ids, known, counts = zip(*self.docs, strict=True) if self.docs else ((), (), ())
        for part in (np.array([*self.starts, self.at], "<u8"), np.array(ids, "<i8"), np.array(known, "u1"), np.array(counts, "<u8")):
            self.out.write(part.tobytes())
        self.out.write(_TAIL.pack(len(self.starts), len(self.docs), self.total, BLOCK, MAGIC))
        self.out.close()


class Reader:
    """Reads a file by its indexes: all documents in order, or any range of ids without the blocks around it."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        blocks, docs, self.total, self.block, magic = _TAIL.unpack(self._read(size - _TAIL.size, _TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        foot = self._read(size - _TAIL.size - 8 * (blocks + 1) - 17 * docs, 8 * (blocks + 1) + 17 * docs)
        self.starts = np.frombuffer(foot, "<u8", blocks + 1).astype(np.int64)
        at = 8 * (blocks + 1)
        self.ids, self.known = np.frombuffer(foot, "<i8", docs, at), np.frombuffer(foot, "u1", docs, at + 8 * docs)
        self.counts = np.frombuffer(foot, "<u8", docs, at + 9 * docs).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block_at(self, i: int) -> np.ndarray:
        return decode_block(self._read(int(self.starts[i]), int(self.starts[i + 1] - self.starts[i])))

    def range(self, start: int, length: int) -> np.ndarray:
        if not length:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (start + length - 1) // self.block
        return np.concatenate([self.block_at(i) for i in range(first, last + 1)])[start - first * self.block :][:length]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, start in this file and token ids of each document; decodes each block once."""
        have, left, at = [], 0, 0
        block = 0
        for doc, known, n in zip(self.ids.tolist(), self.known.tolist(), self.counts.tolist(), strict=True):
            while left < n:
                have.append(self.block_at(block))
                left += len(have[-1])
                block += 1
            values = np.concatenate(have) if have else np.empty(0, np.uint32)
            yield (doc if known else None), at, values[:n]
            have, left, at = [values[n:]], left - n, at + n
