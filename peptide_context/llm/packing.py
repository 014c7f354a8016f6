"""Packing token pieces into fixed windows by non-negative least squares.

Shallow combinations of piece lengths that fill a window are enumerated, their repeat counts are solved
against the histogram of lengths, rounded down, and what is left is packed greedily. Only the histogram
(at most one row a length, so bounded by the window) is seen by the driver; the pieces stay on Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, materialize, rank_within, small_batches, small_side

WINDOW = 2048
END_ID = 1
TEXT_BYTES = 8 << 20  # of texts that a task holds as words at a time
KEPT_STEMS, KEPT_IDS = 500_000, 4_000_000  # known to a task between batches, some 30 MB
#: ASCII marks that the vocabulary takes as one run behind a word; the apostrophe may start a part of its own.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_STEM = r"^[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}]+$"


def _spans(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """pool[start : start + length] of all spans, one after the other."""
    end = np.cumsum(length)
    return pool[np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + length, length)]


def _tails(words: pa.StringArray, skip: np.ndarray) -> pa.StringArray:
    """The words without their first ``skip`` bytes, cut at a character's edge."""
    offsets, data = (np.frombuffer(x, t) for x, t in zip(words.buffers()[1:], (np.int32, np.uint8), strict=True))
    own = offsets[words.offset : words.offset + len(words) + 1].astype(np.int64)
    start, size = own[:-1] + skip, np.diff(own) - skip
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(ends), pa.py_buffer(_spans(data, start, size)))


class _Words:
    """Ids of the distinct words of a batch.

    A word of Latin letters and marks behind them is put together from its lower-case letters' ids and the
    marks' ids, as the vocabulary lowers case and splits letters from marks. Such letters need no normalising and
    go to the merges directly, spelt in the vocabulary's byte alphabet, many at a time. Any other word is encoded as it is.
    Stems are kept, as one Arrow array and one of ids, for all batches of a task; past ``most`` of them, or ``most_ids``
    ids, only the last batch's stay. Nothing outlives the task: idle workers would hold tokenizers beside later stages.
    """

    def __init__(self, path: str, most: int = KEPT_STEMS, most_ids: int = KEPT_IDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.most, self.most_ids = most, most_ids
        self.plain = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.plain.model)  # the same tables, without normalizer and special tokens
        self.merges.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {ord(c): spell(c)[0][0] for c in map(chr, range(0x130)) if c.isalpha() and c == c.lower()}
        self.stems = pa.array([], pa.string())  # the ids of stem i are pool[at[i] : at[i + 1]]
        self.pool, self.at = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.tails: dict[str, np.ndarray] = {}

    def _learn(self, stems: pa.StringArray) -> None:
        pools, sizes = [self.pool], [np.diff(self.at)]
        for i in range(0, len(stems), 5_000):
            part = stems.slice(i, 5_000).to_pylist()
            found = self.merges.encode(" ".join(part).translate(self.spelling), add_special_tokens=False)
            pools.append(np.asarray(found.ids, np.uint32))
            sizes.append(np.bincount(np.asarray(found.word_ids, np.int64), minlength=len(part)))
        self.stems = pa.concat_arrays([self.stems, stems])
        self.pool, self.at = np.concatenate(pools), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def _places(self, names: pa.StringArray) -> np.ndarray:
        """Places of distinct stems in the table, which learns those that it lacks."""
        at = pc.fill_null(pc.index_in(self.stems, value_set=names), -1).to_numpy()  # the smaller side is hashed
        have = np.flatnonzero(at >= 0)
        place = np.full(len(names), -1, np.int64)
        place[at[have]] = have
        new = np.flatnonzero(place < 0)
        place[new] = len(self.stems) + np.arange(len(new))
        if len(new):
            self._learn(names.take(pa.array(new)))
        return place

    def encode(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length): the ids of each word are ids[start : start + length]."""
        n = len(words)
        stems = pc.utf8_rtrim(words, characters=_MARKS)
        plain = pc.match_substring_regex(stems, pattern=_STEM)
        lower = pc.utf8_lower(stems.filter(plain)).dictionary_encode()
        place, used = self._places(lower.dictionary), lower.indices.to_numpy()
        whole = plain.to_numpy(zero_copy_only=False)
        start, length = np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64)
        start[whole, 0], length[whole, 0] = self.at[place[used]], (self.at[place + 1] - self.at[place])[used]
        stem_bytes = np.where(whole, pc.binary_length(stems).to_numpy(), 0)
        marked = np.flatnonzero(~whole | (stem_bytes < pc.binary_length(words).to_numpy()))
        tails = _tails(words.take(pa.array(marked)), stem_bytes[marked]).dictionary_encode()
        known, which = tails.dictionary.to_pylist(), tails.indices.to_numpy()
        for t in known:
            if t not in self.tails:
                self.tails[t] = np.asarray(self.plain.encode(t, add_special_tokens=False).ids, np.uint32)
        parts = [self.tails[t] for t in known]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        start[marked, 1], length[marked, 1] = len(self.pool) + (np.cumsum(sizes) - sizes)[which], sizes[which]
        ids = _spans(np.concatenate([self.pool, *parts]), start.ravel(), length.ravel())
        size = length.sum(axis=1)
        if len(self.stems) > self.most or len(self.pool) > self.most_ids:
            self._keep(lower.dictionary, place)
        # the next batch may need the tails that this one needed twice
        self.tails = {t: self.tails[t] for t, c in zip(known, np.bincount(which, minlength=len(known)).tolist(), strict=True) if c > 1}
        return ids, np.cumsum(size) - size, size

    def _keep(self, names: pa.StringArray, place: np.ndarray) -> None:
        """Leaves the stems ``names`` in the table, or none where they are too many by themselves."""
        size = self.at[place + 1] - self.at[place]
        if len(names) > self.most or size.sum() > self.most_ids:
            names, place, size = names.slice(0, 0), place[:0], size[:0]
        self.pool, self.at = _spans(self.pool, self.at[place], size), np.concatenate([[0], np.cumsum(size)])
        self.stems = names


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, ids_at_a_time: int = 1 << 20) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, ids of each, all ids one after the other) of batches (doc_id, text), about a million ids at a time; ``end_id`` follows
    each text, and null is an empty text."""
    known = _Words(tokenizer)
    for batch in batches:
        for a, b in byte_slices(batch.column(1), TEXT_BYTES):
            doc, texts = batch.column(0).slice(a, b - a), pc.fill_null(batch.column(1).slice(a, b - a), "")
            lists = pc.ascii_split_whitespace(texts)
            words = pc.list_flatten(lists).dictionary_encode()
            pool, start, length = known.encode(words.dictionary)
            code, edge = words.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ends = np.concatenate([[0], np.cumsum(length[code])])[edge]
            at = 0
            while at < len(doc):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + ids_at_a_time, side="right")) - 1)
                own = code[edge[at] : edge[to]]
                flat = np.insert(_spans(pool, start[own], length[own]), ends[at + 1 : to + 1] - ends[at], end_id).astype("<u4")
                yield doc.slice(at, to - at), np.diff(ends[at : to + 1]) + 1, flat
                at = to


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, ids: bool = True) -> DataFrame:
    """Cuts the ids of each text, and ``end_id`` behind them, into pieces of ``window`` ids and one shorter rest.

    Rows (doc_id, start, length, ids_crc32, doc_tokens, part, at, ids); ids is binary, little-endian unsigned 32-bit,
    and left out without ``ids``; (part, at) counts the pieces of one length in a task. The vocabulary ``word_bpe``
    drops white space and never joins across it, so a text's ids are those of its words in turn, and each distinct word
    of some megabytes of texts is encoded once. A null, empty or blank text is a single piece with ``end_id``; rows
    that repeat are each cut; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
    """
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "part": pa.int64(), "at": pa.int64()}
    kinds |= {"ids": pa.binary()} if ids else {}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for doc, total, flat in encoded(batches, tokenizer, end_id):
            yield pieces(doc, total, flat, part, seen)

    def pieces(doc: pa.Array, total: np.ndarray, flat: np.ndarray, part: int, seen: np.ndarray) -> pa.RecordBatch:
        n = -(-total // window)
        which = np.repeat(np.arange(len(total)), n)
        start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * window
        size = np.minimum(total[which] - start, window)
        first = (np.cumsum(total) - total)[which] + start
        order = np.argsort(size, kind="stable")
        place = np.empty(len(size), np.int64)
        place[order] = np.arange(len(size)) - np.searchsorted(size[order], size[order]) + seen[size[order]]
        seen += np.bincount(size, minlength=window + 1)
        raw = flat.data.cast("B")
        found = [raw[4 * a : 4 * (a + k)] for a, k in zip(first.tolist(), size.tolist(), strict=True)]
        crc = np.fromiter(map(zlib.crc32, found), np.int64, len(found))
        columns = [doc.take(pa.array(which)), *map(pa.array, (start, size, crc, total[which], np.full(len(size), part), place))]
        return pa.record_batch(columns + ([pa.array([bytes(x) for x in found], pa.binary())] if ids else []), list(kinds))

    small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return read.mapInArrow(cut, ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in kinds))


def combinations(lengths: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Combinations of one to four present lengths that fill the window exactly: every pair, and for each
    length the triples and quadruples whose rest is split evenly or unevenly in a few fixed shares."""
    have = set(int(x) for x in lengths)
    found: set[tuple[int, ...]] = set()
    for a in have:
        if a == window:
            found.add((a,))
        rest = window - a
        if rest in have:
            found.add(tuple(sorted((a, rest))))
        for share in (2, 3, 4, 6, 8, 12, 16):
            for b in (rest // share, rest // share + 1, rest // share - 1):
                if b in have and rest - b in have:
                    found.add(tuple(sorted((a, b, rest - b))))
        for b in (rest // 3, rest // 3 + 1):
            for c in ((rest - b) // 2, (rest - b) // 3):
                if b in have and c in have and rest - b - c in have:
                    found.add(tuple(sorted((a, b, c, rest - b - c))))
    return sorted(found)


def solve(histogram: dict[int, int], window: int, rounds: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) that use every piece of the histogram exactly once."""
    left = {int(k): int(v) for k, v in histogram.items() if v}
    plan: list[tuple[tuple[int, ...], int]] = []
    combos = combinations(np.asarray(sorted(left)), window)
    if combos:
        h = np.zeros(window + 1)
        for k, v in left.items():
            h[k] = v
        rows = np.concatenate([np.asarray(c) for c in combos])
        cols = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
        # multiplicative updates keep x >= 0 and lower ||Ax - h||
        ath = np.bincount(cols, h[rows], len(combos))
        x = np.full(len(combos), h.sum() / max(1, len(rows)))
        for _ in range(rounds):
            fitted = np.bincount(rows, x[cols], window + 1)
            x *= ath / np.maximum(np.bincount(cols, fitted[rows], len(combos)), 1e-12)
        for i in np.argsort(-x, kind="stable"):
            need: dict[int, int] = {}
            for k in combos[i]:
                need[k] = need.get(k, 0) + 1
            n = min([int(x[i]), *(left[k] // m for k, m in need.items())])
            if n > 0:
                plan.append((combos[i], n))
                for k, m in need.items():
                    left[k] -= m * n
    plan += residual(left, window)
    return plan


def residual(left: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on the histogram: the longest length left, then whichever lengths fill its rest
    best, an exact two-piece fill before the longest that fits; repeated while every part has pieces."""
    plan = []
    left = {k: v for k, v in left.items() if v > 0}
    while left:
        combo: list[int] = []
        space, used = window, {}
        while True:
            fits = [k for k, v in left.items() if k <= space and v > used.get(k, 0)]
            if not fits:
                break
            pick = max(fits)
            if combo and pick != space:
                have = set(fits)
                exact = next((k for k in sorted(have, reverse=True) if space - k in have and (2 * k != space or left[k] - used.get(k, 0) > 1)), None)
                pick = exact or pick
            combo.append(pick)
            used[pick] = used.get(pick, 0) + 1
            space -= pick
        n = min(left[k] // m for k, m in used.items())
        plan.append((tuple(combo), n))
        for k, m in used.items():
            left[k] -= m * n
            if not left[k]:
                del left[k]
    return plan


def pack_pieces(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, start and length (1 to ``window``); other columns stay.

    In a sequence the offsets run gapless from 0. Pieces of equal length are exchangeable, so the plan speaks
    of ranks within a length. A written table with the columns (part, at) of ``token_pieces`` is ranked by them: each
    part starts after the pieces of that length in the parts before it, so only counts by part and length are moved,
    and the rows stay where they are. Other rows are ranked in parts of a hash, as one length may hold a third of all pieces. The
    broadcast plan has at most a few rows a length, however many pieces there are. No rows in, no rows out.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, sequence, seen = [], 0, {}
    for combo, repeats in solve(histogram, window):
        offset = 0
        for length in combo:
            base = seen.get(length, 0)
            slots.append((length, base, base + repeats, sequence - base, offset))
            seen[length] = base + repeats
            offset += length
        sequence += repeats
    plan = spark.createDataFrame(slots, "length long, _from long, _to long, _shift long, offset long")
    if {"part", "at"} <= set(pieces.columns):
        before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = pieces.groupBy("length", "part").agg(F.count("*").alias("_n"))
        base = counts.select("length", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
        ranked = pieces.join(small_side(materialize(base)), ["length", "part"]).withColumn("rank", F.col("_base") + F.col("at")).drop("_base", "part", "at")
    else:
        ranked = rank_within(pieces.withColumn("_h", F.xxhash64("doc_id", "start")), ["length"], "_h", ["doc_id", "start"]).drop("_h")
    return (
        ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to")))
        .drop(plan["length"])
        .withColumn("sequence_id", F.col("rank") + F.col("_shift"))
        .drop("rank", "_from", "_to", "_shift")
    )


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, ids: bool = False) -> DataFrame:
    """Whole texts to packed pieces: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), with ``ids`` the
    ids themselves as well. Nulls, repeats and empty tables are as in ``token_pieces``.

    A sequence's padding is ``window`` less its filled length, or none if that is a power of two.
    """
    packed = pack_pieces(materialize(token_pieces(docs, tokenizer, window, ids=ids)), window)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if ids else []))
