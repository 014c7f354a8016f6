"""MD5 draws in numpy: the first digits of the digests of many short texts at once.

A digest's hexadecimal text begins with the bytes of the first word of MD5's state, so that word settles the order but for ties,
which whole digests settle. A text of at most 55 bytes is one block of MD5.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_WORD = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
ONE_BLOCK = 55  # bytes of text
LANE = 1 << 15  # texts in one go: what is worked on stays in the cache
PLACES = 1 << 16  # places whose digits are written out at a time


def first_words(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first four bytes of the MD5 of texts, as numbers in the order of the digests.

    ``words`` has a column a text with its bytes, the mark 0x80 and zeros, as little-endian words, those after the last row being 0;
    ``size`` is the texts' length in bits.
    """
    n = words.shape[1]
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three steps leave the first word as it is
        turn = i // 16
        if turn == 0:
            np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
        else:
            np.bitwise_or(np.invert(d, out=f), b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, np.uint32(_SINES[i]), out=f)
        word = _WORD[turn](i)
        if word == 14:
            np.add(f, size, out=f)
        elif word < len(words):
            np.add(f, words[word], out=f)
        left = _TURNS[turn][i % 4]
        np.left_shift(f, np.uint32(left), out=t)
        np.right_shift(f, np.uint32(32 - left), out=f)
        np.bitwise_or(t, f, out=t)
        np.add(t, b, out=t)
        a, b, c, d, t = d, t, b, c, a
    return (b + np.uint32(_START[0])).byteswap()


class Tails:
    """The texts ``|place|seed`` of places from ``lo`` on, with MD5's mark, as words, for texts before them of any length."""

    def __init__(self, lo: int, hi: int, seed: int):
        texts = [b"|%d|%d\x80" % (i, seed) for i in range(lo, hi)]
        self.lo, self.size = lo, np.fromiter(map(len, texts), np.int64, len(texts)) - 1
        width = int(self.size.max()) + 1
        data = np.array(texts, f"S{width}").view(np.uint8).reshape(len(texts), width)
        self.words = []
        for at in range(4):  # bytes of a word that the text before takes
            full = np.zeros((len(texts), -(-(width + at) // 4) * 4), np.uint8)
            full[:, at : at + width] = data
            self.words.append(np.ascontiguousarray(full.view("<u4").T))


def place_keys(names: list[bytes], los: list[int], his: list[int], tails: Tails) -> np.ndarray:
    """The first words of the digests of ``name|place|seed`` for the places lo to hi (excluded) of each name, in turn."""
    total = sum(his) - sum(los)
    rows = max(len(n) // 4 + len(tails.words[len(n) % 4]) for n in names)
    words, size = np.zeros((rows, total), np.uint32), np.empty(total, np.uint32)
    at = 0
    for name, lo, hi in zip(names, los, his, strict=True):
        to, part, tail = at + hi - lo, slice(lo - tails.lo, hi - tails.lo), tails.words[len(name) % 4]
        first = len(name) // 4
        words[first : first + len(tail), at:to] = tail[:, part]
        own = np.frombuffer(name + b"\0" * (-len(name) % 4), "<u4")
        words[: len(own), at:to] |= own[:, None]
        size[at:to] = (tails.size[part] + len(name)) * 8
        at = to
    return np.concatenate([first_words(words[:, i : i + LANE], size[i : i + LANE]) for i in range(0, total, LANE)])


def drawn_places(names: list[bytes], los: list[int], his: list[int], without: list[list[int]], count: list[int], seed: int) -> list[list[int]]:
    """Of the places lo to hi (excluded) of each name, but for those in ``without``, the ``count`` first by the MD5 of ``name|place|seed``."""
    best: list[list[tuple[bytes, int]]] = [[] for _ in names]

    def take(i: int, places) -> None:
        found = [(hashlib.md5(b"%s|%d|%d" % (names[i], k, seed)).digest(), k) for k in places]
        best[i] = sorted(best[i] + found)[: count[i]]

    wide = len(b"|%d|%d" % (max(his, default=0), seed))
    short = [i for i, n in enumerate(names) if len(n) + wide <= ONE_BLOCK and his[i] > los[i]]
    for i in set(range(len(names))) - set(short):
        take(i, sorted(set(range(los[i], his[i])) - set(without[i])))
    for lo in range(0, max((his[i] for i in short), default=0), PLACES):
        some = [i for i in short if his[i] > lo and los[i] < lo + PLACES]
        if not some:
            continue
        tails, at = Tails(lo, min(lo + PLACES, max(his[i] for i in some)), seed), 0
        while at < len(some):
            to, total = at, 0
            while to < len(some) and (to == at or total < 16 * LANE):
                total += min(his[some[to]], lo + PLACES) - max(los[some[to]], lo)
                to += 1
            part = some[at:to]
            begin, end = [max(los[i], lo) for i in part], [min(his[i], lo + PLACES) for i in part]
            keys = place_keys([names[i] for i in part], begin, end, tails)
            start = 0
            for i, b, e in zip(part, begin, end, strict=True):
                own, start = keys[start : start + e - b], start + e - b
                free = np.ones(e - b, bool)
                free[[k - b for k in without[i] if b <= k < e]] = False
                places = np.flatnonzero(free)
                if len(places) > count[i]:
                    own = own[places]
                    places = places[own <= np.partition(own, count[i] - 1)[count[i] - 1]] if count[i] else places[:0]
                take(i, (places + b).tolist())
            at = to
    return [[k for _, k in found] for found in best]
