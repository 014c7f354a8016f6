"""Numpy helpers for tasks: hashes of words, word shingles and byte windows of whole texts.

All of them work on a batch of texts at once and keep 64-bit arithmetic modulo 2**64.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole result."""
    x = x ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLES: dict[int, np.ndarray] = {}
_POWERS: dict[int, np.ndarray] = {}


def _table(seed: int) -> np.ndarray:
    if seed not in _TABLES:
        _TABLES[seed] = mix(np.arange(1, 257, dtype=np.uint64), seed + 7)
    return _TABLES[seed]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    key = int(base)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        p[0] = 1
        have = _POWERS[key] = np.multiply.accumulate(p)
    return have


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


_INV = np.uint64(_inverse(int(_BASE)))


def prefix_hash(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """H with H[i] = sum of table[data[j]] * base**j for j < i, one longer than data."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_table(seed)[data] * _powers(_BASE, len(data) + 1)[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of data[start:end) for arrays of spans; equal bytes give equal hashes wherever they stand."""
    inv = _powers(_INV, len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start], seed) + mix((end - start).astype(np.uint64), seed + 1)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes other than ASCII white space."""
    solid = np.empty(len(data) + 2, dtype=bool)
    solid[0] = solid[-1] = False
    np.logical_not(_SPACE[data], out=solid[1:-1])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    return edge[::2], edge[1::2]


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII letters A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of one text.

    A text of fewer words than ``size`` has its whole word sequence as its one shingle;
    a text without words has none.
    """
    data = lower(np.frombuffer(text, dtype=np.uint8))
    start, end = words(data)
    n = len(start)
    if not n:
        return np.empty(0, dtype=np.uint64)
    w = span_hash(prefix_hash(data), start, end)
    k = min(size, n)
    acc = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        acc = (acc + w[i : n - k + 1 + i]) * _BASE
        acc ^= acc >> np.uint64(29)
    return np.unique(mix(acc, k))


def shingle_sets(texts: list[bytes], size: int = 5, chunk: int = 1 << 17) -> list[np.ndarray]:
    """``shingle_set`` of many texts, hashed together in chunks of bytes."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        group, total = [], 0
        while at < len(texts) and (not group or total + len(texts[at]) < chunk):
            group.append(texts[at])
            total += len(texts[at]) + 1
            at += 1
        data = lower(np.frombuffer(b"\n".join(group), dtype=np.uint8))
        start, end = words(data)
        w = span_hash(prefix_hash(data), start, end) if len(start) else np.empty(0, np.uint64)
        limit = np.cumsum([len(g) + 1 for g in group])
        edge = np.concatenate([[0], np.searchsorted(start, limit)])
        n = max(0, len(w) - size + 1)
        acc = np.zeros(n, dtype=np.uint64)
        for i in range(size if n else 0):
            acc = (acc + w[i : n + i]) * _BASE
            acc ^= acc >> np.uint64(29)
        acc = mix(acc, size)
        for i, text in enumerate(group):
            a, b = edge[i], edge[i + 1]
            out.append(np.unique(acc[a : b - size + 1]) if b - a >= size else shingle_set(text, size))
    return out


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of each window of ``width`` values (uint64, top bits random)."""
    n = len(values)
    m = n - width + 1
    # value and position in one number: the low 24 bits hold the position inside a block of two windows
    pad = -n % width
    order = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(order, axis=1).ravel()
    right = np.minimum.accumulate(order[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:m], left[width - 1 : width - 1 + m])
