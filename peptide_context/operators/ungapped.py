"""Ungapped comparison of sequences in numpy, many pairs at a time: seeds on diagonals, equal residues, best targets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

HITS = 2 << 20  # seed hits looked at in one go
RESIDUES = 4 << 20  # residues compared in one go


class Texts:
    """Sequences one after the other in a byte array; ``codes`` holds each k-mer as a number, -1 where none starts."""

    def __init__(self, seqs: list[bytes], k: int):
        self.size = np.fromiter(map(len, seqs), np.int64, len(seqs))
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(seqs), np.uint8)
        self.owner = np.repeat(np.arange(len(seqs)), self.size)
        self.place = np.arange(len(self.data)) - self.start[self.owner]
        self.codes = np.full(len(self.data), -1, np.int64)
        n = len(self.data) - k + 1
        if n > 0:
            code = np.zeros(n, np.int64)
            for i in range(k):  # seven bits a residue: exact for k up to 9
                code = (code << 7) | (self.data[i : i + n] & 127)
            whole = self.place[:n] + k <= self.size[self.owner[:n]]
            self.codes[:n][whole] = code[whole]


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for ``length`` places, of all spans in turn."""
    end = np.cumsum(length)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + length, length)


def equal_residues(x: np.ndarray, at_x: np.ndarray, y: np.ndarray, at_y: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many of ``length`` residues from places at_x of x and at_y of y on are equal, for each triple."""
    found, at = np.zeros(len(length), np.int64), 0
    ends = np.cumsum(length)
    while at < len(length):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RESIDUES, side="right")))
        part = slice(at, to)
        same = x[spans(at_x[part], length[part])] == y[spans(at_y[part], length[part])]
        total = np.concatenate([[0], np.cumsum(same)])
        edge = np.concatenate([[0], np.cumsum(length[part])])
        found[part] = np.diff(total[edge])
        at = to
    return found


def first_of(groups: np.ndarray) -> np.ndarray:
    """Places where a new value begins in an array whose equal values stand together."""
    return np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.empty(0, np.int64)


class Index:
    """The k-mers of some queries in order, to be looked up by those of targets."""

    def __init__(self, queries: Texts):
        own = np.flatnonzero(queries.codes >= 0)
        order = own[np.argsort(queries.codes[own], kind="stable")]
        self.queries, self.codes = queries, queries.codes[order]
        self.owner, self.place = queries.owner[order], queries.place[order]

    def part(self, chosen: np.ndarray) -> Index:
        """The same for the queries marked in ``chosen``."""
        other = object.__new__(Index)
        keep = chosen[self.owner]
        other.queries, other.codes, other.owner, other.place = self.queries, self.codes[keep], self.owner[keep], self.place[keep]
        return other

    def diagonals(self, targets: Texts, lo: int = 0, hi: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
        """(target, query, diagonal, seeds) of all pairs with a common k-mer, sorted in this order; a pair stands in one piece.

        Pieces are as many targets as have some millions of hits together; where one alone has more, it meets the queries
        in parts. Nothing is left out, however common a k-mer is.
        """
        hi = len(targets.size) if hi is None else hi
        span = slice(targets.start[lo], targets.start[hi - 1] + targets.size[hi - 1]) if hi > lo else slice(0, 0)
        codes = targets.codes[span]
        first = np.searchsorted(self.codes, codes, side="left")
        count = np.where(codes >= 0, np.searchsorted(self.codes, codes, side="right") - first, 0)
        owner = targets.owner[span] - lo
        each = np.bincount(owner, count, max(0, hi - lo)).astype(np.int64)
        ends, at = np.cumsum(each), 0
        edge = np.searchsorted(owner, np.arange(hi - lo + 1))
        while at < hi - lo:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HITS, side="right")))
            known = np.unique(self.owner)
            if each[at:to].sum() > HITS and len(known) > 1:
                half = np.zeros(len(self.queries.size), bool)
                half[known[: len(known) // 2]] = True
                for chosen in (half, ~half):
                    yield from self.part(chosen).diagonals(targets, lo + at, lo + to)
            elif each[at:to].sum():
                part = slice(edge[at], edge[to])
                entry = spans(first[part], count[part])
                target = np.repeat(owner[part], count[part]) + lo
                diagonal = np.repeat(targets.place[span][part], count[part]) - self.place[entry]
                low, width = int(diagonal.min()), int(diagonal.max() - diagonal.min()) + 1
                key, seeds = np.unique((target * len(self.queries.size) + self.owner[entry]) * width + diagonal - low, return_counts=True)
                pair, d = np.divmod(key, width)
                yield (*np.divmod(pair, len(self.queries.size)), d + low, seeds)
            at = to


def best_diagonals(index: Index, targets: Texts, k: int, seeds: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(target, query, diagonal, seeds, same, lo, overlap): of each pair the diagonal of most seeds, ties to the least.

    A pair needs ``seeds`` common k-mers there, or all k-mers of the query if it has fewer; ``lo`` is the query's place where
    both begin to lie side by side.
    """
    q = index.queries
    for target, query, d, n in index.diagonals(targets):
        enough = n >= np.minimum(seeds, q.size[query] - k + 1)
        target, query, d, n = (x[enough] for x in (target, query, d, n))
        order = np.lexsort((d, -n, query, target))
        target, query, d, n = (x[order] for x in (target, query, d, n))
        top = first_of(target * len(q.size) + query)
        target, query, d, n = (x[top] for x in (target, query, d, n))
        lo = np.maximum(0, -d)
        overlap = np.minimum(q.size[query], targets.size[target] - d) - lo
        same = equal_residues(q.data, q.start[query] + lo, targets.data, targets.start[target] + lo + d, overlap)
        yield target, query, d, n, same, lo, overlap
