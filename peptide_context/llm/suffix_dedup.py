"""Removal of repeated byte passages: a depth-limited radix order of suffixes, by families of suffixes.

Sorting every suffix by most-significant digits moves a row for each byte of text in each pass: at 12 bytes a row some
20 times the stored input, five times what the check tool allows. So suffixes are put into families first, and it
is families that are passed on digit by digit; only what is left in the end is told apart start by start. Groups that are
still equal after ``LENGTH`` bytes are exactly the repeated windows, as in the full order.

A family is chosen by content. Of the 64-byte grams of a window of 400 bytes, the one with the least hash
(leftmost in a tie) is its anchor; equal windows have equal anchors at equal places. A family is all starts whose
window has the same anchor. A digit is a run of bytes, its bucket the digit's hash, and a pass goes on only with buckets
that hold two or more. Pass 1 drops families whose anchor gram is unique. Pass 2
looks at the family's whole stretch of bytes: one that repeats settles all starts of its families at once, and one
of them stands for all from there on; and at 232 bytes to the right of, and to the left of, the anchor, as every
window of the family holds one of the two. Pass 3 takes the starts 32 at a time: their windows have 369
bytes in common. Pass 4 hashes the full 400 bytes of each start that is left.

Long texts are hashed in segments; a family that lies across two of them is two families, which costs a pass more and
changes nothing in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, small_side, text_or_empty
from .hashing import prefix_hash, sliding_argmin, span_hash

LENGTH, GRAM, STEP = 400, 64, 32
SEGMENT = 1 << 18  # starts of a text that are hashed at a time


def families(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor, first start, last start) of each family of a text of at least ``length`` bytes."""
    h = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    g = span_hash(h, at, at + gram)
    bits = np.uint64(max(20, int(len(data)).bit_length()))
    marked = (g >> bits << bits) | at.astype(np.uint64)
    low = sliding_argmin(marked, length - gram + 1)
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
    return h, g, anchor[first], first, last


def _anchors(length: int, gram: int):
    side = (length - gram) // 2  # a window reaches at least so far left of its anchor, or far enough to the right
    reach = length - side
    names = ["doc_id", "rk", "a", "s0", "s1", "g", "right", "left", "f1", "f2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = []
        size = 0
        for batch in _slices(batches):
            for doc, rk, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                for at in range(0, len(data) - length + 1, SEGMENT):
                    own = data[at : at + SEGMENT + length - 1]
                    h, g, a, s0, s1 = families(own, length, gram)
                    h2 = prefix_hash(own, 5)
                    place = (a - s0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    f1, f2 = span_hash(h, s0, s1 + length, 23) + place, span_hash(h2, s0, s1 + length, 24) ^ place
                    off = min(at, side)  # the digits beside the anchor reach beyond the segment
                    wide = data[at - off : at + SEGMENT + length + reach]
                    h, w = h if len(wide) == len(own) else prefix_hash(wide), a + off
                    right = span_hash(h, w, np.minimum(w + reach, len(wide)), 21)
                    left = span_hash(h, np.maximum(w - side, 0), w + gram, 22)
                    ids = np.full(len(a), doc, dtype=np.int64)
                    out.append([ids, np.full(len(a), rk, np.int64), a + at, s0 + at, s1 + at, *(x.view(np.int64) for x in (g[a], right, left, f1, f2))])
                    size += len(a)
                    if size > 20_000:
                        yield _batch(out)
                        out, size = [], 0
        if out:
            yield _batch(out)

    def _batch(out):
        return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    return run


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Small parts of batches, so that a task holds few texts and ranges as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _segments(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """(rows, off, to): the spans [first, last) in groups that lie in one short stretch [off, to) of the text each."""
    which = first // SEGMENT
    for k in np.unique(which):
        rows = np.flatnonzero(which == k)
        yield rows, int(first[rows].min()), int(last[rows].max())


def _cores(length: int, step: int):
    """Splits ranges of starts by their distance to the anchor into parts of ``step``, and hashes what the windows of
    a part have in common (c) and the part's whole stretch (e)."""
    names = ["doc_id", "rk", "part", "lo", "hi", "c1", "c2", "e1", "e2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out: list[list[np.ndarray]] = []
            for doc, rk, text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                a, lo, hi = (np.asarray([r[k] for r in ranges], dtype=np.int64) for k in ("a", "lo", "hi"))
                first, last = (a - hi) // step, (a - lo) // step
                n = last - first + 1
                which = np.repeat(np.arange(len(a)), n)
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[which]
                low, high = np.maximum(lo[which], a[which] - part * step - step + 1), np.minimum(hi[which], a[which] - part * step)
                start = a[which] - part * step
                end = start - step + 1 + length
                place = (a[which] - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                hashes = [np.empty(len(part), np.uint64) for _ in range(4)]
                for rows, off, to in _segments(np.minimum(start, low), np.maximum(end, high + length)):
                    h, h2 = prefix_hash(data[off:to]), prefix_hash(data[off:to], 5)
                    s, e, u, v = start[rows] - off, end[rows] - off, low[rows] - off, high[rows] + length - off
                    hashes[0][rows], hashes[1][rows] = span_hash(h, s, e, 41), span_hash(h2, s, e, 42)
                    hashes[2][rows], hashes[3][rows] = span_hash(h, u, v, 43) + place[rows], span_hash(h2, u, v, 44) ^ place[rows]
                ids = [np.full(len(part), doc, np.int64), np.full(len(part), rk, np.int64)]
                out.append([*ids, part, low, high, *(x.view(np.int64) for x in hashes)])
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for doc, rk, text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                s = np.unique(np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in ranges]))
                for rows, off, to in _segments(s, s + length):
                    at = s[rows] - off
                    w1 = span_hash(prefix_hash(data[off:to]), at, at + length, 31).view(np.int64)
                    w2 = span_hash(prefix_hash(data[off:to], 5), at, at + length, 32).view(np.int64)
                    for i in range(0, len(at), 50_000):
                        part = slice(i, i + 50_000)
                        n = len(at[part])
                        yield pa.record_batch(
                            [pa.array(np.full(n, doc, np.int64)), pa.array(np.full(n, rk, np.int64)), pa.array(at[part] + off), pa.array(w1[part]), pa.array(w2[part])],
                            ["doc_id", "rk", "s", "w1", "w2"],
                        )

    return run


def cut(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, bytes kept) without the union of [start, end)."""
    if not len(starts):
        return 0, 0, data
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    first, last = starts[new], ends[np.append(new[1:] - 1, len(ends) - 1)]
    kept = b"".join(data[a:b] for a, b in zip([0, *last.tolist()], [*first.tolist(), len(data)], strict=True))
    return int((last - first).sum()), len(new), kept


def _finish(length: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in _slices(batches):
            out: list[list] = [[] for _ in names]
            size = 0
            for doc, z, spans, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = unpack.decompress(z)
                first = np.asarray([x["lo"] for x in spans or ()] + (starts or []), dtype=np.int64)
                last = np.asarray([x["hi"] for x in spans or ()] + (starts or []), dtype=np.int64) + length
                removed, runs, kept = cut(data, first, last)
                for column, value in zip(out, (doc, len(data), removed, runs, kept), strict=True):
                    column.append(value)
                size += len(kept)
                if size > 4 << 20:
                    yield _batch(out)
                    out, size = [[] for _ in names], 0
            yield _batch(out)

    def _batch(out):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return run


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as Zstandard frames: half of what a shuffle would else move."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in _slices(batches):
        z = [pack.compress(x.encode()) for x in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(z, pa.binary())], ["doc_id", "rk", "z"])


def _with_texts(read: DataFrame, ranges: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, rk, text, ranges) of the texts with ranges: these are broadcast if few, else joined by shuffle."""
    own = ranges.groupBy(F.col("doc_id").alias("_d"), F.col("rk").alias("_r")).agg(F.collect_list(F.struct(*fields)).alias("ranges"))
    own = small_side(materialize(own))
    return read.join(own, (F.col("doc_id") == F.col("_d")) & (F.col("rk") == F.col("_r"))).select("doc_id", "rk", "text", "ranges")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of docs(doc_id, text); kept is binary.

    Every byte covered by a window of ``length`` bytes that also starts at another place of any text, the same one
    included, is removed; windows are judged on the input. Null texts are empty, texts shorter than ``length`` stay
    whole. Rows are told apart by doc_id and a hash of the text, so rows that repeat are each cut (and, being
    copies, cut away if long enough); other columns are ignored; an empty table gives an empty result.

    Groups are counted by pre-aggregation and joined back, never gathered; only a document's own spans meet in a row.
    """
    small_batches(docs.sparkSession)
    none = F.lit(-(1 << 63))  # stands for a null doc_id in keys
    read = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("doc_id"), text_or_empty().alias("text"))
    read = read.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), "text")
    schema = "doc_id long, rk long, a long, s0 long, s1 long, g long, right long, left long, f1 long, f2 long"
    anchors = materialize(read.mapInArrow(_anchors(length, gram), schema))
    # counts are written before they are joined: a plain join of two tables is one whose hot keys Spark deals anew
    twice = materialize(anchors.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"))
    open_ = materialize(anchors.join(twice, "g").drop("g"))
    side = (length - gram) // 2
    # families with the same stretch are one class: with two members all their starts repeat, and one of them
    # stands for the class in the passes that follow
    place = ["doc_id", "rk", "a", "s0", "s1", "right", "left"]
    classes = materialize(open_.groupBy("f1", "f2").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("m")))
    settled = open_.join(classes.where("n > 1").select("f1", "f2"), ["f1", "f2"])
    settled = settled.select("doc_id", "rk", F.struct(F.col("s0").alias("lo"), F.col("s1").alias("hi")).alias("r"))
    keys = F.array(F.struct(F.lit(1).alias("kind"), F.col("right").alias("k")), F.struct(F.lit(2).alias("kind"), F.col("left").alias("k")))
    digits = classes.select((F.col("n") == 1).cast("int").alias("alone"), "m.*")
    digits = digits.select("doc_id", "rk", "a", "s0", "s1", "alone", F.explode(keys).alias("k")).select("doc_id", "rk", "a", "s0", "s1", "alone", "k.*")
    shared = digits.groupBy("kind", "k").agg(F.count("*").alias("n"), F.sum("alone").alias("alone")).where("n > 1 and alone > 0")
    state = digits.drop("alone").join(materialize(shared.select("kind", "k")), ["kind", "k"])
    lo = F.when(F.col("kind") == 1, F.greatest("s0", F.col("a") - side)).otherwise(F.col("s0"))
    hi = F.when(F.col("kind") == 1, F.col("s1")).otherwise(F.least("s1", F.col("a") - side - 1))
    left = state.select("doc_id", "rk", "a", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    parts = materialize(
        _with_texts(read, left, ["a", "lo", "hi"]).mapInArrow(
            _cores(length, STEP), "doc_id long, rk long, part long, lo long, hi long, c1 long, c2 long, e1 long, e2 long"
        )
    )
    # as for families: a repeated stretch settles its part, and one of its members stands for it among those that
    # share the core
    core = ["part", "c1", "c2"]
    stretches = materialize(
        parts.groupBy(*core, "e1", "e2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "rk", "lo", "hi")).alias("m"))
    )
    again = parts.join(stretches.where("n > 1").select(*core, "e1", "e2"), [*core, "e1", "e2"])
    settled = settled.union(again.select("doc_id", "rk", F.struct("lo", "hi").alias("r")))
    mixed = stretches.groupBy(*core).agg(F.count("*").alias("k"), F.sum((F.col("n") == 1).cast("int")).alias("alone"))
    left = stretches.join(materialize(mixed.where("k > 1 and alone > 0").select(*core)), core).select("m.*")
    windows = materialize(
        _with_texts(read, left, ["lo", "hi"]).mapInArrow(_windows(length), "doc_id long, rk long, s long, w1 long, w2 long")
    )
    again = materialize(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    starts = windows.join(again, ["w1", "w2"]).groupBy("doc_id", "rk").agg(F.collect_set("s").alias("starts"))
    spans = settled.groupBy("doc_id", "rk").agg(F.collect_set("r").alias("spans"))
    spans = spans.join(starts, ["doc_id", "rk"], "full")
    packed = read.mapInArrow(_compress, "doc_id long, rk long, z binary")
    full = packed.join(spans, ["doc_id", "rk"], "left")
    full = full.select(F.nullif(F.col("doc_id"), none).alias("doc_id"), "z", "spans", "starts")
    return full.mapInArrow(_finish(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
