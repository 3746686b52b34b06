"""Distinct word shingles of texts as 64-bit hashes, computed over whole Arrow slices with numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from weftline.llm import common

U = np.uint64
_BYTE = common.mix64(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_P = 0x2545F4914F6CDD1D
_P_INVERSE = pow(_P, -1, 1 << 64)
_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_P, _P_INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POWERS[i] = np.cumprod(x)
    return _POWERS


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each row); words are runs of other than ASCII white space."""
    n = len(data)
    rows = len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1])) & ~edge[:-1]
    after = np.concatenate((solid[1:], [False])) & ~edge[1:]
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    power, inverse = _powers(n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[:n])))
    h = common.mix64((total[end] - total[start]) * inverse[start])
    return h, np.diff(np.searchsorted(start, offsets))


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each row, offsets). A row of fewer than k words, but at least
    one, has its whole sequence as its only shingle."""
    h, counts = word_hashes(*common.raw(column))
    at = np.concatenate(([0], np.cumsum(counts)))
    s = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        s += h[j : len(h) - k + 1 + j] * common.mix64(np.array([j + 11], np.uint64))
    s = common.mix64(s)
    parts, sizes = [], np.zeros(len(counts), np.int64)
    for i, n in enumerate(counts):
        if n >= k:
            x = np.unique(s[at[i] : at[i] + n - k + 1])
        elif n:
            x = np.full(1, n * 7919, np.uint64)
            for j in range(at[i], at[i] + n):
                x = common.mix64(x * U(0x9E3779B97F4A7C15) + h[j : j + 1])
        else:
            continue
        parts.append(x)
        sizes[i] = len(x)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def set_key(x: np.ndarray) -> bytes:
    """Sixteen bytes that stand for a set."""
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()
