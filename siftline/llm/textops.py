"""Vectorised text helpers for Arrow batches: words, word hashes and shingle sets of whole texts.

Hashes have 64 bits. Two different words (or shingles) share one with a chance of 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finisher of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        row = np.full(max(n, 1 << 20), base, U)
        row[0] = 1
        _powers[base] = np.cumprod(row, dtype=U)
    return _powers[base][:n]


def slices(batch: pa.RecordBatch, column: int = 0, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``limit`` bytes of text (a longer text stands alone): the rows, the
    UTF-8 bytes of their texts, and where each text begins (one more entry than rows). Null: empty."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased, split at the bytes ``between``) and their rows."""
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64)
    solid = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    summed = np.zeros(len(data) + 1, U)
    np.cumsum((LOWER[data].astype(U) + U(1)) * powers(_BASE, len(data)), out=summed[1:])
    h = mix((summed[end] - summed[start]) * powers(_BACK, len(data))[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))
    return h, np.searchsorted(offsets, start, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Each row's sorted distinct hashes of ``size``-word shingles; the whole sequence as one for
    fewer words; empty without words."""
    h, row = words(data, offsets)
    n_rows = len(offsets) - 1
    first = np.searchsorted(row, np.arange(n_rows + 1))
    count = np.diff(first)
    out = [np.zeros(0, U)] * n_rows
    if len(h) >= size:
        full = np.zeros(len(h) - size + 1, U)
        for i in range(size):
            full = mix(full + h[i : len(h) - size + 1 + i] * U((2 * i + 3) * 0x9FB21C651E98DF25 % (1 << 64)))
    for r in range(n_rows):
        if count[r] >= size:
            s = np.sort(full[first[r] : first[r + 1] - size + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out[r] = s[keep]
        elif count[r]:
            whole = count[r : r + 1].astype(U)
            for i in range(first[r], first[r + 1]):
                whole = mix(whole * U(0xA24BAED4963EE407) + h[i : i + 1])
            out[r] = whole
    return out


def content_keys(*columns: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of values, nulls told from anything else: the same for equal rows in every scan."""
    parts = [x for c in columns for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *reversed(parts))


class Counts:
    """Sorted keys and counts that grow by parts."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        if len(self.parts) > 16:
            self.parts = [self.total()]

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = np.concatenate([k for k, _ in self.parts])
        order = np.argsort(keys)
        keys, n = keys[order], np.concatenate([n for _, n in self.parts])[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(n, first) if len(keys) else n


EMPTY = np.iinfo(np.int64).min


class Lookup:
    """An open-addressing hash table of int64 keys (EMPTY counts as EMPTY + 1) and double values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = np.maximum(keys, EMPTY + 1)
        self.shift = 64 - max(4, (2 * len(keys) + 1).bit_length())
        size = 1 << 64 - self.shift
        self.keys, self.values = np.full(size, EMPTY), np.zeros(size)
        left, slot = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = self.keys[slot[left]] == EMPTY
            _, one = np.unique(slot[left][free], return_index=True)
            placed = left[free][one]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], values[placed]
            left = left[~np.isin(left, placed)]
            slot[left] = (slot[left] + 1) & (size - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys.view(U) * U(0x9E3779B97F4A7C15)
        return ((x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9) >> U(self.shift)).astype(np.int64)

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        keys = np.maximum(keys, EMPTY + 1)
        slot = self.slot(keys)
        held = self.keys[slot]
        hit = held == keys
        out = np.where(hit, self.values[slot], default)
        left = np.flatnonzero(~hit & (held != EMPTY))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            held = self.keys[slot]
            hit = held == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (held != EMPTY)
            left, slot = left[on], slot[on]
        return out
