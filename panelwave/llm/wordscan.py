"""Vectorised scan of the words of many texts at once.

The UTF-8 bytes of an Arrow column are scanned with numpy: word boundaries, a 64-bit hash of
every word, and hashes of runs of words.  A run's hash comes from prefix sums of
``value[i] * base**i`` (arithmetic modulo 2**64), divided by ``base**start``, so that windows of
any length cost the same.  Two different runs share a hash with a probability of about 2**-64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from panelwave.llm.common import texts_of

U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Odd bases with a small 2-adic valuation of base - 1.
BYTE_BASE, WORD_BASE, SECOND_BASE = 0x9E3779B97F4A7C15 | 3, 0xD1342543DE82EF93, 0xA0761D6478BD642B
_TABLE = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@lru_cache(maxsize=12)
def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse for i below ``count``."""
    size = 1 << max(12, int(count).bit_length())
    return _powers(base, size), _powers(pow(base, -1, 1 << 64), size)


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], dtype=U, out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of the values from ``start`` up to ``end``, by place: equal runs have equal hashes."""
    inverse = powers(base, len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] ^ mix((end - start).astype(U)))


class Words:
    """Words of the texts of one Arrow column.

    start, end   byte offsets of each word in ``data``
    doc          row of each word
    first        first word of each row (length rows + 1)
    hash         64-bit hash of each word; ``lower`` folds A-Z first
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        text = texts_of(column)
        self.rows = len(text)
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + self.rows + 1]
        raw = text.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.data, self.offsets = data, offsets - offsets[0]
        inside = ~SEPARATOR[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[self.offsets] = True
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | begins[:-1]))
        self.end = np.flatnonzero(inside & (~after | begins[1:])) + 1
        self.inside = inside
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.rows), self.count)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.sums = prefix(_TABLE[data], BYTE_BASE)
        self.hash = run_hash(self.sums, self.start, self.end, BYTE_BASE)

    def windows(self, length: int) -> np.ndarray:
        """Starts of all runs of ``length`` words that lie within one row."""
        if len(self.doc) < length:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: len(self.doc) - length + 1] == self.doc[length - 1 :])


def per_row(rows: np.ndarray, count: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights, minlength=count).astype(np.int64)
