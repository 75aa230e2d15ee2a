"""Jaro similarity, a batch of pairs at a time."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT = 64  # bytes up to which pairs are compared together, as matrices
PAIRS = 4096  # pairs in one matrix


def jaro(a: bytes, b: bytes) -> float:
    """Jaro similarity of byte strings; half transpositions are rounded down, empty strings give 0.

    Time is linear in the lengths: the window moves on, so of the places of a byte in b none that lies
    behind it, or is taken, is looked at again.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(n, m) // 2 - 1, 0)
    places: dict[int, list[int]] = defaultdict(list)
    for j in range(m - 1, -1, -1):
        places[b[j]].append(j)
    left, right = bytearray(), []
    for i, ch in enumerate(a):
        queue = places.get(ch)
        while queue and queue[-1] < i - reach:
            queue.pop()
        if queue and queue[-1] <= i + reach:
            left.append(ch)
            right.append(queue.pop())
    k = len(left)
    if not k:
        return 0.0
    swaps = sum(x != b[j] for x, j in zip(left, sorted(right))) // 2
    return (k / n + k / m + (k - swaps) / k) / 3


def _matrix(words: list[bytes], pad: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full((len(words), max(int(size.max(initial=0)), 1)), pad, np.int16)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return out, size


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bytes each pair of rows shares, wherever they stand: no fewer than match."""
    n, rows = len(x), np.arange(len(x))[:, None] * 258
    counts = [np.bincount((rows + z + 2).ravel(), minlength=258 * n).reshape(n, 258)[:, 2:] for z in (x, y)]
    return np.minimum(*counts).sum(1)


def jaro_pairs(a: list[bytes], b: list[bytes], cutoff: float = 0.0) -> np.ndarray:
    """Similarities of pairs; those that can't exceed the cutoff may be given as 0."""
    out = np.zeros(len(a))
    short = np.fromiter((0 < len(x) <= SHORT and 0 < len(y) <= SHORT for x, y in zip(a, b)), bool, len(a))
    for i in np.flatnonzero(~short).tolist():
        out[i] = jaro(a[i], b[i])
    some = np.flatnonzero(short)
    for at in range(0, len(some), PAIRS):
        part = some[at : at + PAIRS]
        x, n = _matrix([a[i] for i in part], -1)
        y, m = _matrix([b[i] for i in part], -2)
        k = _shared(x, y)
        near = np.flatnonzero((k / n + k / m + 1) / 3 > cutoff)
        out[part[near]] = _jaro_matrix(x[near], n[near], y[near], m[near])
    return out


def _jaro_matrix(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    rows, places = np.arange(len(x)), np.arange(y.shape[1])
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)[:, None]
    free, hit = np.ones(y.shape, bool), np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        ok = (y == x[:, i : i + 1]) & free & (np.abs(places - i) <= reach)
        first = ok.argmax(1)
        hit[:, i] = ok[rows, first]
        free[rows[hit[:, i]], first[hit[:, i]]] = False
    k = hit.sum(1)
    swaps = np.bincount(np.repeat(rows, k), x[hit] != y[~free], len(x)) // 2
    some = np.maximum(k, 1)
    return np.where(k > 0, (k / n + k / m + (k - swaps) / some) / 3, 0.0)


def _batch(cutoff: float):
    def similarities(a: pa.Array, b: pa.Array) -> pa.Array:
        """A batch repeats its pairs many times: each is compared once."""
        valid = np.flatnonzero(a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False))
        out = np.full(len(a), np.nan)
        if len(valid):
            x, y = (c.take(pa.array(valid)).cast(pa.binary()).dictionary_encode() for c in (a, b))
            left, right = x.dictionary.to_pylist(), y.dictionary.to_pylist()
            code = x.indices.to_numpy().astype(np.int64) * len(right) + y.indices.to_numpy()
            pairs, back = np.unique(code, return_inverse=True)
            found = jaro_pairs([left[i] for i in pairs // len(right)], [right[i] for i in pairs % len(right)], cutoff)
            out[valid] = found[back]
        return pa.array(out, pa.float64(), mask=np.isnan(out))

    return similarities


def jaro_similarity(a: Column, b: Column, cutoff: float = 0.0) -> Column:
    """Null if either is null; what can't exceed the cutoff may be 0."""
    return F.arrow_udf(_batch(cutoff), "double")(a, b)


def reachable(a: Column, b: Column, cutoff: float) -> Column:
    """Whether the lengths allow a similarity above the cutoff: it is at most (2 + shorter / longer) / 3."""
    x, y = F.octet_length(a), F.octet_length(b)
    return 3 * (cutoff - 0.001) <= 2 + F.least(x, y) / F.greatest(x, y, F.lit(1))
