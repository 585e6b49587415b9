"""SetSketch registers: exponentially spaced, truncated minima of hashed elements.

Each register takes the minimum of an exponentially distributed hash over the set and keeps
``floor(1 - log_b(minimum))`` within ``0..q+1``. Registers of a union are the maxima of the registers, and with a base
near 1 two registers agree with about the probability of the sets' Jaccard similarity, so groups of them serve as
locality-sensitive keys (Ertl, "SetSketch: Filling the Gap between MinHash and HyperLogLog", VLDB 2021).
"""

from __future__ import annotations

import numpy as np

from .words import mix

BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2


def _coefficients(m: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:m] | np.uint64(1), seeds[m:]


class SetSketch:
    def __init__(self, registers: int = 200, band: int = 5):
        if registers % band:
            raise ValueError("the registers must fill whole bands")
        self.m, self.band = registers, band
        self.a, self.b = _coefficients(registers)

    def registers(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of registers for each set; an empty set has zeros."""
        out = np.zeros((len(sets), self.m), np.uint16)
        sizes = np.array([len(s) for s in sets])
        full = np.flatnonzero(sizes)
        at = 0
        while at < len(full):  # sets are taken together up to a bounded number of elements
            to, total = at, 0
            while to < len(full) and (to == at or total + sizes[full[to]] <= 1 << 16):
                total += sizes[full[to]]
                to += 1
            rows = full[at:to]
            e = np.concatenate([sets[i] for i in rows])
            starts = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
            least = np.empty((self.m, len(rows)), np.uint64)
            for k in range(self.m):
                v = e * self.a[k]
                v += self.b[k]
                np.minimum.reduceat(v, starts, out=least[k])
            out[rows] = self.truncate(least.T)
            at = to
        return out

    @staticmethod
    def truncate(least: np.ndarray) -> np.ndarray:
        x = -np.log1p(-((least >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / RATE
        return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The registers of the union of the two sets."""
        return np.maximum(a, b)

    def band_keys(self, registers: np.ndarray) -> np.ndarray:
        """A 64-bit key for each set and band."""
        parts = registers.reshape(len(registers), -1, self.band).astype(np.uint64)
        h = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), parts.shape[:2])
        for i in range(self.band):
            h = mix(h * np.uint64(0xFF51AFD7ED558CCD) + parts[:, :, i])
        return h.astype(np.int64)


def joint_estimate(n_a, n_b, higher, lower, m: int) -> np.ndarray:
    """The Jaccard similarity that makes the register comparison likeliest.

    ``higher`` and ``lower`` count registers in which the first sketch is above or below the second; the set sizes are
    known exactly. With ``u``, ``v`` the shares of the sizes, registers are higher with probability ``p(u - v J)`` and
    lower with ``p(v - u J)`` where ``p(x) = -log_b(1 - x (b-1)/b)``. The log-likelihood is concave in ``J``.
    """
    n_a, n_b = np.asarray(n_a, float), np.asarray(n_b, float)
    higher, lower = np.asarray(higher, float), np.asarray(lower, float)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        return higher * np.log(up) + lower * np.log(down) + (m - higher - lower) * np.log(np.clip(1 - up - down, 1e-12, 1))

    low, high = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        left = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2
