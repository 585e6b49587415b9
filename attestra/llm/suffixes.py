"""Suffixes of texts as numbers: which of them to keep, their leading bytes as words, and their order.

Of the suffixes of a text only some need sorting: in each window of ``WIDTH`` bytes the leading ``LEAD`` bytes with the
smallest hash are its anchor, so equal windows have the same anchor at the same place, and neighbouring windows mostly
share one. A run of windows with one anchor is a stretch of at most ``2 * WIDTH - LEAD`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

WIDTH, LEAD = 50, 20
#: Starts of windows taken up at once; a longer text goes in overlapping pieces.
AT_ONCE = 1 << 20
#: Below this many, a part of the quicksort is sorted at once.
SHORT = 1 << 14
_BASE = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(12).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_POWERS: list[np.ndarray] = []
_PLACE = np.uint64((1 << 24) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, AT_ONCE + 2 * WIDTH), b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


class Stretches(NamedTuple):
    """Of each run of windows: the row of its text, its first window's place there, the number of windows, its anchor's
    leading bytes as a word (three bytes as they are, then 40 bits of their hash), and a hash of the whole stretch."""

    row: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    word: np.ndarray
    whole: np.ndarray


def utf8_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of texts without nulls, and where each text begins and the last ends."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bytes: whole texts together, or a long text's parts, each with what its last windows reach into."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + AT_ONCE, "right")) - 1)
        if offsets[j] - offsets[i] <= AT_ONCE:
            yield int(offsets[i]), int(offsets[j])
        else:
            for at in range(int(offsets[i]), int(offsets[j]), AT_ONCE):
                yield at, min(at + AT_ONCE + WIDTH - 1, int(offsets[j]))
        i = j


def stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[Stretches]:
    """The runs of windows of many texts. Every window lies in exactly one run and in one text."""
    for lo, hi in _pieces(offsets):
        if hi - lo < WIDTH:
            continue
        text = data[lo:hi]
        power, inverse = _powers(len(text))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUE[text] * inverse[: len(text)])])
        leads = mixed((sums[LEAD:] - sums[:-LEAD]) * power[: len(text) - LEAD + 1])
        least = (leads & ~_PLACE) | np.arange(len(leads), dtype=np.uint64)
        reach, span = 1, WIDTH - LEAD + 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
        anchor = (least & _PLACE).astype(np.int64)
        begins, ends = np.maximum(offsets[:-1], lo) - lo, np.minimum(offsets[1:], hi) - lo - WIDTH + 1
        there = ends > begins
        edge = np.zeros(len(anchor) + 1, np.int8)
        edge[begins[there]] += 1
        edge[ends[there]] -= 1
        inside = np.cumsum(edge[:-1]) > 0
        change = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])]))
        size = np.diff(np.append(change, len(anchor)))
        first, size = change[inside[change]], size[inside[change]]
        at = anchor[first]
        whole = mixed((sums[first + size + WIDTH - 1] - sums[first]) * power[first] + (at - first).astype(np.uint64))
        head = (text[at].astype(np.uint64) << np.uint64(56)) | (text[at + 1].astype(np.uint64) << np.uint64(48)) | (text[at + 2].astype(np.uint64) << np.uint64(40))
        row = np.searchsorted(offsets, first + lo, "right") - 1
        yield Stretches(row, first + lo - offsets[row], size, head | (leads[at] >> np.uint64(24)), whole)


def windows(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The windows that begin at these places, a row of bytes each."""
    return np.lib.stride_tricks.sliding_window_view(data, WIDTH)[starts] if len(starts) else np.zeros((0, WIDTH), np.uint8)


def as_words(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as words of eight, whose order is that of the bytes."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return [np.ascontiguousarray(c).astype(np.uint64) for c in padded.view(">u8").T]


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their keys, one after the other, as multikey quicksort finds it: parts by three-way
    partition on one key; the part that equals the pivot goes on with the next key."""
    order, todo = np.arange(len(keys[0])), [(0, len(keys[0]), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == len(keys):
            continue
        part = order[lo:hi]
        if hi - lo <= SHORT:
            order[lo:hi] = part[np.lexsort([k[part] for k in reversed(keys[depth:])])]
            continue
        values = keys[depth][part]
        some = np.sort(values[:: max(1, len(values) // 63)])
        pivot = some[len(some) // 2]
        less, more = values < pivot, values > pivot
        low, same = part[less], part[~(less | more)]
        order[lo:hi] = np.concatenate([low, same, part[more]])
        a, b = lo + len(low), lo + len(low) + len(same)
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def starts_of(keys: list[np.ndarray]) -> np.ndarray:
    """Where runs of rows with equal keys begin, in sorted rows."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class Splitters:
    """Sampled words that cut all suffixes into ranges. A word that is a splitter itself fills several: its rows are
    dealt to them by document, and what these ranges say of it has to be compared."""

    def __init__(self, sample: np.ndarray, ranges: int):
        sample = np.sort(sample)
        self.words = sample[(np.arange(1, ranges) * len(sample)) // ranges] if len(sample) else np.zeros(0, np.uint64)
        self.ranges = len(self.words) + 1

    def deal(self, word: np.ndarray, doc: np.ndarray) -> np.ndarray:
        low, high = (np.searchsorted(self.words, word, side) for side in ("left", "right"))
        return (low + (mixed(doc.astype(np.uint64)) % (high - low + 1).astype(np.uint64)).astype(np.int64)).astype(np.int32)

    def across(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words, word, "left") < np.searchsorted(self.words, word, "right")
