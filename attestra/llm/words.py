"""Words and word shingles of a text as 64-bit hashes, computed on whole byte arrays with numpy.

A word is a maximal run of characters other than ``\\x20`` and ``\\x09-\\x0D``; A-Z count as a-z. UTF-8 never uses those
bytes inside a longer character, so bytes can be cut where characters would be.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)
_PLAIN = np.arange(256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 18
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, _PIECE + 1024)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits each depend on all input bits (splitmix64's finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _piece(buf: np.ndarray, fold: bool) -> np.ndarray:
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_SPACE[buf]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(((_FOLD if fold else _PLAIN) + np.uint64(1))[buf] * _powers(_BASE, n)[:n], out=sums[1:])
    inverse = _powers(pow(_BASE, -1, 1 << 64), n)
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(text: bytes, fold: bool = True) -> np.ndarray:
    """A hash for each word, in order. Long texts go in pieces cut at white space, which bounds the work arrays."""
    buf = np.frombuffer(text, np.uint8)
    if len(buf) <= _PIECE:
        return _piece(buf, fold) if len(buf) else np.empty(0, np.uint64)
    out, at = [], 0
    while at < len(buf):
        to = min(at + _PIECE, len(buf))
        while to < len(buf) and not _SPACE[buf[to]]:
            to += 1
        out.append(_piece(buf[at:to], fold))
        at = to
    return np.concatenate(out)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of ``size`` words; a shorter text that has words is one shingle of all of them."""
    if not len(words):
        return words
    n = min(size, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0xFF51AFD7ED558CCD) + words[i : len(words) - n + 1 + i])
    return h


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(word_hashes(text), size))


def jaccard_parts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared, len(both) - shared
