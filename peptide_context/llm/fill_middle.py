"""Fill-in-middle texts: a byte automaton cuts whole texts into units, and prefix, suffix and middle change places.

A unit is a run of ASCII letters or any other single code point. One table drives the scan: its states are outside a
word, inside one, behind ``<`` and behind ``<P``, ``<S`` or ``<M``; each byte makes a transition, and a transition may start a
unit, start a code point or complete a sentinel. Whatever the state was, two bytes settle it, so that the state before
every byte of a block is one look-up, and numpy runs a block of bytes at a time. The first scan only counts: it gives
each text its units, code points and sentinels. The second scan goes over those blocks again that hold a cut, and finds its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, small_batches, text_or_empty

#: The marks of the format (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

BLOCK = 1 << 20  # bytes scanned at a time
TEXT_BYTES = 8 << 20  # of texts held at a time

_OTHER, _LETTER, _NAME, _OPEN, _CLOSE, _MORE, _RESET = range(7)  # classes of bytes; _MORE continues a code point
_OUT, _WORD, _OPENED, _NAMED = range(4)
_UNIT, _POINT, _MARK = 1, 2, 4


def _classes() -> np.ndarray:
    found = np.full(256, _OTHER, np.uint8)
    for a, b in (("A", "Z"), ("a", "z")):
        found[ord(a) : ord(b) + 1] = _LETTER
    found[[ord(x[1]) for x in (PREFIX, SUFFIX, MIDDLE)]] = _NAME
    found[ord("<")], found[ord(">")], found[0x80:0xC0] = _OPEN, _CLOSE, _MORE
    return found


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, what the transition emits) by state and class."""
    to, emits = np.full((4, 7), _OUT, np.uint8), np.zeros((4, 7), np.uint8)
    to[:, _LETTER] = to[:, _NAME] = _WORD
    to[_OPENED, _NAME] = _NAMED
    to[:, _OPEN] = _OPENED
    emits[:, [_OTHER, _OPEN, _CLOSE]] = _UNIT | _POINT
    emits[:, [_LETTER, _NAME]] = _POINT
    emits[np.ix_([_OUT, _OPENED], [_LETTER, _NAME])] = _UNIT | _POINT
    emits[_NAMED, _CLOSE] |= _MARK
    return to, emits


def _by_three() -> np.ndarray:
    """What a byte emits, by the classes of the two bytes in front of it and its own: two transitions lead to one state from anywhere."""
    to, emits = _tables()
    found = np.zeros((8, 8, 8), np.uint8)
    for a in range(7):
        for b in range(7):
            state = set(to[to[:, a], b].tolist())
            assert len(state) == 1
            found[a, b, :7] = emits[state.pop()]
    return found.ravel()


CLASSES, EMITS = _classes(), _by_three()


def _scan(data: np.ndarray, at: int, to: int, starts: np.ndarray) -> np.ndarray:
    """What each byte of data[at:to] emits; ``starts`` are the places where a text begins."""
    left = max(0, at - 2)
    kinds = CLASSES[data[left:to]].astype(np.uint16)
    before = np.full((2, len(kinds)), _RESET, np.uint16)
    before[0, 1:] = kinds[:-1]
    own = starts[np.searchsorted(starts, left) : np.searchsorted(starts, to)] - left
    before[0, own] = _RESET
    before[1, 1:] = before[0, :-1]
    before[1, own] = _RESET
    return EMITS[before[1] * 64 + before[0] * 8 + kinds][at - left :]


def _counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First scan: (units, code points, sentinels) in front of each offset, and in front of each block."""
    edges = np.arange(0, max(1, len(data)) + BLOCK, BLOCK)
    at_offset, at_block = np.zeros((3, len(offsets)), np.int64), np.zeros((3, len(edges)), np.int64)
    starts = np.unique(offsets)
    for b in range(len(edges) - 1):
        found = _scan(data, edges[b], min(edges[b + 1], len(data)), starts)
        inside = (offsets >= edges[b]) & (offsets < edges[b] + len(found)) if len(found) else np.zeros(len(offsets), bool)
        for k, bit in enumerate((_UNIT, _POINT, _MARK)):
            running = np.concatenate([[0], np.cumsum(found & bit != 0)])
            at_offset[k, inside] = at_block[k, b] + running[offsets[inside] - edges[b]]
            at_block[k, b + 1] = at_block[k, b] + running[-1]
    at_offset[:, offsets == len(data)] = at_block[:, -1:]
    return at_offset, at_block


def _places(data: np.ndarray, offsets: np.ndarray, at_block: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Second scan: for units ``wanted`` by number, the byte where they start and the code points in front of it."""
    place, points = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    starts = np.unique(offsets)
    block = np.searchsorted(at_block[0], wanted, side="right") - 1
    for b in np.unique(block).tolist():
        at = b * BLOCK
        found = _scan(data, at, min(at + BLOCK, len(data)), starts)
        own = block == b
        unit = np.flatnonzero(found & _UNIT)[wanted[own] - at_block[0, b]]
        place[own] = at + unit
        points[own] = at_block[1, b] + np.concatenate([[0], np.cumsum(found & _POINT != 0)])[unit]
    return place, points


def rearrange(texts: pa.StringArray, draws: np.ndarray, plain: int, spm: int) -> dict[str, pa.Array]:
    """Columns n, form, prefix_chars, middle_chars, output of some texts without nulls; ``draws``: four numbers a text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    at_offset, at_block = _counts(data, offsets)
    n, points, marks = np.diff(at_offset, axis=1)
    moved = (n > 0) & (marks == 0) & (draws[2] % 100 < plain)
    cuts = np.sort(draws[:2] % (n + 1), axis=0)[:, moved]
    first, last = at_offset[0, :-1][moved], n[moved]
    place, before = np.empty((2, len(last)), np.int64), np.empty((2, len(last)), np.int64)
    for k in range(2):
        end = cuts[k] == last
        place[k], before[k] = offsets[1:][moved], at_offset[1, 1:][moved]
        place[k, ~end], before[k, ~end] = _places(data, offsets, at_block, (first + cuts[k])[~end])
    prefix, middle = before[0] - at_offset[1, :-1][moved], before[1] - before[0]
    turned = draws[3][moved] % 100 < spm
    raw, parts, forms = data.tobytes(), [], np.full(len(n), "plain", object)
    forms[moved] = np.where(turned, "spm", "psm")
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    rows = zip(*(x.tolist() for x in (offsets[:-1][moved], place[0], place[1], offsets[1:][moved], turned)), strict=True)
    for lo, hi, own in zip(offsets[:-1].tolist(), offsets[1:].tolist(), moved.tolist(), strict=True):
        if not own:
            parts.append(raw[lo:hi])
            continue
        a, x, y, b, turn = next(rows)
        parts.append(b"".join([s, raw[y:b], p, raw[a:x], m, raw[x:y]] if turn else [p, raw[a:x], s, raw[y:b], m, raw[x:y]]))
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    output = pa.StringArray.from_buffers(len(parts), pa.py_buffer(ends), pa.py_buffer(b"".join(parts)))
    chars = []
    for values in (prefix, middle):
        column = np.zeros(len(n), np.int64)
        column[moved] = values
        chars.append(pa.array(column, mask=~moved))
    return {"n": pa.array(n), "form": pa.array(forms.tolist(), pa.string()), "prefix_chars": chars[0], "middle_chars": chars[1], "output": output}


def fill_in_middle(docs: DataFrame, seed: int = 1, moved: int = 90, spm: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every whole text, null as empty.

    n counts the units. Two of them, drawn by the SHA-256 of ``seed``, a colon and the doc_id, end the prefix and the middle.
    ``moved`` of 100 texts are rearranged, ``spm`` of 100 of these with the suffix in front; a text that is empty or holds
    a sentinel stays plain, and its character counts are null. A null doc_id draws as an empty string; rows that repeat
    have equal results; bytes that are no UTF-8 go through as they are, and a stray continuation byte belongs to what is in front;
    other columns are ignored; an empty table gives no rows. A map-only pass; a task holds some megabytes of texts, or one long one.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            numbers = np.array([batch.column(2 + i).to_numpy() for i in range(4)], np.int64)
            for a, b in byte_slices(texts, TEXT_BYTES):
                made = rearrange(texts.slice(a, b - a), numbers[:, a:b], moved, spm)
                yield pa.record_batch([batch.column(0).slice(a, b - a), *made.values()], ["doc_id", *made])

    small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *draws)
    return read.mapInArrow(work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of: no text holds a sentinel unless it stayed plain, so each stands once."""
    def between(a, b):
        return F.substring_index(F.substring_index(output, b, 1), a, -1)

    psm = F.concat(between(PREFIX, SUFFIX), F.substring_index(output, MIDDLE, -1), between(SUFFIX, MIDDLE))
    turned = F.concat(between(PREFIX, MIDDLE), F.substring_index(output, MIDDLE, -1), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", turned).otherwise(output)
