"""Motif matches over whole batches of sequences: all motifs run as one bit-parallel automaton over byte arrays.

A motif of single residues, classes and ``.``, with a class to look ahead to at most, is a row of residue sets. Each step
of the automaton is a table from a byte to a word with a bit for every motif whose set at that step has the byte, or that is shorter; the
words of some consecutive bytes, taken together by AND, tell which motifs begin at the first. Other patterns run by ``re``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .sequences import slices

_SET = r"(?:\[\^?[A-Za-z]+\]|\.|[A-Za-z])"
_SIMPLE = re.compile(rf"({_SET}+)(?:\(\?=({_SET}+)\))?")


class Motifs:
    """Compiled (pattern, offset of the bond from the match) pairs, at most 64 simple ones."""

    def __init__(self, patterns: list[tuple[str, int]]):
        self.offsets = [o for _, o in patterns]
        self.compiled = [re.compile(p) for p, _ in patterns]
        rows = [_SIMPLE.fullmatch(p) for p, _ in patterns]
        self.simple = [i for i, r in enumerate(rows) if r][:64]
        self.width = {i: len(re.findall(_SET, rows[i][1])) for i in self.simple}
        sets = {i: [re.compile(x) for x in re.findall(_SET, rows[i][1] + (rows[i][2] or ""))] for i in self.simple}
        self.steps = np.zeros((max(map(len, sets.values()), default=0), 256), np.uint64)
        for bit, i in enumerate(self.simple):
            for j in range(len(self.steps)):
                fits = [j >= len(sets[i]) or (0 < c < 128 and sets[i][j].match(chr(c)) is not None) for c in range(256)]
                self.steps[j, fits] |= np.uint64(1 << bit)

    def find(self, seqs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, motif, bond) of the leftmost matches of each motif that do not overlap, 1 <= bond < length."""
        plain = [s.isascii() and "\0" not in s for s in seqs]
        raw = b"\0".join(s.encode() if p else b"" for s, p in zip(seqs, plain, strict=True)) + b"\0" * (len(self.steps) + 1)
        data = np.frombuffer(raw, np.uint8)
        size = np.fromiter((len(s) if p else 0 for s, p in zip(seqs, plain, strict=True)), np.int64, len(seqs))
        start = np.cumsum(size + 1) - size - 1
        n = len(data) - len(self.steps)
        words = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        for j, table in enumerate(self.steps):
            words &= table[data[j : j + n]]
        found = [np.empty((3, 0), np.int64)]
        for bit, i in enumerate(self.simple):
            at = _apart(np.flatnonzero(words & np.uint64(1 << bit)), self.width[i])
            which = np.searchsorted(start, at, side="right") - 1
            bond = at - start[which] + self.offsets[i]
            inside = (bond >= 1) & (bond < size[which])
            found.append(np.array([which[inside], np.full(inside.sum(), i), bond[inside]], np.int64))
        for k, (s, p) in enumerate(zip(seqs, plain, strict=True)):
            for i in range(len(self.compiled)):
                if not p or i not in self.width:
                    bonds = [b for m in self.compiled[i].finditer(s) if 1 <= (b := m.start() + self.offsets[i]) < len(s)]
                    found.append(np.array([[k] * len(bonds), [i] * len(bonds), bonds], np.int64).reshape(3, -1))
        return tuple(np.concatenate(found, axis=1))


def _apart(at: np.ndarray, width: int) -> np.ndarray:
    """Of sorted places the first, and then always the next that is ``width`` or more behind the last one taken."""
    if width < 2 or len(at) < 2:
        return at
    taken = np.concatenate([[True], np.diff(at) >= width])
    after, now = np.searchsorted(at, at + width), np.flatnonzero(taken)
    while len(now):
        now = after[now]
        now = np.unique(now[now < len(at)])
        now = now[~taken[now]]
        taken[now] = True
    return at[taken]


SITES = {
    "motif_ord": pa.int32(), "bond": pa.int32(), "p1_residue": pa.string(), "window": pa.string(), "window8": pa.string(), "seq_len": pa.int32(),
    "kr_before": pa.int32(), "kr_total": pa.int32(), "de_before": pa.int32(), "de_total": pa.int32(),
}


def _strings(rows: np.ndarray, valid: np.ndarray) -> pa.Array:
    """The letters of each row of code points where ``valid``, as strings."""
    text = rows[valid].astype("<u4").tobytes().decode("utf-32-le").encode()
    sizes = np.zeros(len(rows), np.int64)
    if rows.size:
        letters = np.where(rows < 128, 1, np.where(rows < 0x800, 2, np.where(rows < 0x10000, 3, 4)))
        sizes = (letters * valid).sum(axis=1)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends), pa.py_buffer(text))


class Located:
    """The bonds of motifs in sequences, and what stands around and before them."""

    def __init__(self, motifs: Motifs, seqs: list[str], flank: int):
        which, motif, bond = motifs.find(seqs)
        self.size = np.fromiter(map(len, seqs), np.int64, len(seqs))
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer("".join(seqs).encode("utf-32-le"), "<u4")
        if not len(self.data):
            which, motif, bond, self.data = which[:0], motif[:0], bond[:0], np.zeros(1, np.uint32)
        self.which, self.motif, self.bond = which, motif, bond
        first = self.start[which]
        at = (first + bond)[:, None] + np.arange(-flank, flank)
        self.inside = (at >= first[:, None]) & (at < (first + self.size[which])[:, None])
        self.letters = self.data[np.clip(at, 0, len(self.data) - 1)]
        self.full = self.inside.all(axis=1)

    def running(self, kind: str) -> np.ndarray:
        """How many residues of a kind stand before each place, all sequences in a row."""
        return np.concatenate([[0], np.cumsum(np.isin(self.data, [ord(c) for c in kind]))])

    def scores(self, table: np.ndarray) -> np.ndarray:
        """Logistic of the sum of ``table`` over a bond's full window, 0 where it runs off an end. The table has a number a place
        and code, and the constant of the sum behind them, as ``cleavage.letter_table`` makes it."""
        total = np.zeros(len(self.bond))
        for i in range(self.letters.shape[1]):
            total = total + table[128 * i : 128 * (i + 1)][np.minimum(self.letters[:, i], 127)]
        return np.where(self.full, 1.0 / (1.0 + np.exp(-np.clip(total + table[-1], -700.0, 700.0))), 0.0)


def sites(motifs: Motifs, seqs: list[str], flank: int) -> tuple[np.ndarray, list[pa.Array]]:
    """(sequence of each site, columns ``SITES``): what stands around the bonds, and how many basic and acidic residues
    stand in front of them, by running sums."""
    x = Located(motifs, seqs, flank)
    which, bond, letters, inside, full = x.which, x.bond, x.letters, x.inside, x.full
    bar = np.full((len(bond), 1), ord("|"), letters.dtype)
    window = _strings(np.hstack([letters[:, :flank], bar, letters[:, flank:]]), np.hstack([inside[:, :flank], bar > 0, inside[:, flank:]]))
    whole = _strings(letters, inside & full[:, None])
    whole = pa.StringArray.from_buffers(len(whole), whole.buffers()[1], whole.buffers()[2], pa.py_buffer(np.packbits(full, bitorder="little").tobytes()), int((~full).sum()))
    counts = []
    for kind in ("KR", "DE"):
        running = x.running(kind)
        counts += [running[x.start[which] + bond] - running[x.start[which]], (running[x.start + x.size] - running[x.start])[which]]
    numbers = lambda v: pa.array(v, pa.int32())
    p1 = _strings(letters[:, flank - 1 : flank], inside[:, flank - 1 : flank])
    return which, [numbers(x.motif), numbers(bond), p1, window, whole, numbers(x.size[which]), *map(numbers, counts)]


def scan_scored(batches: Iterator[pa.RecordBatch], patterns: list[tuple[str, int]], flank: int, table: np.ndarray, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """(precursor_id, motif_ord, bond, score) of batches (id, seq): the sites of ``scan``, scored where they are found."""
    motifs = Motifs(patterns)
    for batch in batches:
        at = 0
        for part in slices(batch.column(1), most):
            x = Located(motifs, part.to_pylist(), flank)
            ids = batch.column(0).slice(at, len(part)).take(pa.array(x.which))
            at += len(part)
            columns = [ids, pa.array(x.motif, pa.int32()), pa.array(x.bond, pa.int32()), pa.array(x.scores(table))]
            for a in range(0, len(ids), 1 << 16):
                yield pa.record_batch([c.slice(a, 1 << 16) for c in columns], ["precursor_id", "motif_ord", "bond", "score"])


def scan(batches: Iterator[pa.RecordBatch], patterns: list[tuple[str, int]], flank: int, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Sites of batches (id, seq), ``most`` bytes of sequences at a time, or one sequence; nulls have none."""
    motifs = Motifs(patterns)
    for batch in batches:
        at = 0
        for part in slices(batch.column(1), most):
            which, columns = sites(motifs, part.to_pylist(), flank)
            ids = batch.column(0).slice(at, len(part)).take(pa.array(which))
            at += len(part)
            for a in range(0, len(which), 1 << 16):
                yield pa.record_batch([x.slice(a, 1 << 16) for x in (ids, *columns)], ["precursor_id", *SITES])
