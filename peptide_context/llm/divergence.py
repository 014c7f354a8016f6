"""How far the sources of a language differ in their words: exact chi-square-like divergences of term shares.

The terms of a text are counted where it is read, and only sums by (lang, source, term) are moved. The kept terms of all
languages are dealt into ranges of their order, which is that of their UTF-8 bytes; inside a range the sorted terms
of a language are its dictionary, a term's place there is its id, and each group is a dense vector of counts over the ids.
Ids keep the order of the terms, so ties need no strings. Ranges are pieces of bounded size, whatever the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, materialize, small_batches, text_or_empty

SCALE = 1_000_000_000
TEXT_BYTES = 8 << 20  # of texts whose terms are counted at a time
CELLS = 1 << 20  # of a dense piece of the matrix groups x terms
RANGE_ROWS = 100_000  # rows (lang, source, term) of a range of terms, about

#: Bytes of terms as they are counted, all others as blanks.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def _folded(texts: pa.StringArray) -> pa.StringArray:
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return pa.StringArray.from_buffers(len(texts), texts.buffers()[1], pa.py_buffer(_FOLD[data].tobytes()), None, 0, texts.offset)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group of rows, and rows that hold it.

    Nulls are empty strings; a term is a run of ASCII letters and characters beyond ASCII, with A-Z in lower case."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(2), TEXT_BYTES):
                lang, source, texts = (batch.column(i).slice(a, b - a) for i in range(3))
                lists = pc.ascii_split_whitespace(_folded(texts))
                terms = pc.list_flatten(lists)
                which = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
                some = pc.greater(pc.binary_length(terms), 0)
                terms, which = terms.filter(some).dictionary_encode(), which[some.to_numpy(zero_copy_only=False)]
                code, size = terms.indices.to_numpy().astype(np.int64), max(1, len(terms.dictionary))
                langs, sources = lang.dictionary_encode(), source.dictionary_encode()
                many = len(sources.dictionary)
                group = langs.indices.to_numpy().astype(np.int64) * many + sources.indices.to_numpy()
                by_doc = np.unique(which * size + code)
                held, docs = np.unique(group[by_doc // size] * size + by_doc % size, return_counts=True)
                _, n = np.unique(group[which] * size + code, return_counts=True)
                own = held // size
                columns = [langs.dictionary.take(pa.array(own // many)), sources.dictionary.take(pa.array(own % many)), terms.dictionary.take(pa.array(held % size))]
                yield pa.record_batch([*columns, pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])

    small_batches(docs.sparkSession)
    read = docs.select(*[text_or_empty(c).alias(c) for c in ("lang", "source", "text")])
    found = read.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total), exactly for totals up to 9 * 10**15: digits of a thousand are divided in turn."""
    rest, found = count.astype(np.int64), np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        found = found * 1000 + digit
    return 1 + found


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _compare(key: tuple, rows: pa.Table, top: int) -> pa.Table:
    """One language's terms in one range: rows with a term are counts; rows without name a group, its total as n, and kept terms v."""
    head = pc.is_null(rows["term"])
    heads, rows = rows.filter(head).sort_by("source"), rows.filter(pc.invert(head))
    sources = heads["source"].combine_chunks()
    kept = int(heads["v"][0].as_py())
    totals = heads["n"].to_numpy().astype(np.int64)
    names = np.array(rows["term"].combine_chunks().cast(pa.binary()).to_pylist(), object)  # as bytes: their order is that of the ids
    dictionary = np.unique(names)
    ids = np.searchsorted(dictionary, names)
    group = pc.index_in(rows["source"].combine_chunks(), sources).to_numpy().astype(np.int64)
    n = rows["n"].to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")
    ids, group, n = ids[order], group[order], n[order]
    s, every = len(sources), totals.sum() + 2 * kept
    sums, best = np.zeros((s, s), np.int64), [[] for _ in range(s)]
    width = max(1, CELLS // s)
    for at in range(0, len(dictionary), width):
        to = min(at + width, len(dictionary))
        lo, hi = np.searchsorted(ids, [at, to])
        dense = np.bincount(group[lo:hi] * (to - at) + ids[lo:hi] - at, n[lo:hi], s * (to - at))  # whole numbers, exact as floats
        dense = dense.astype(np.int64).reshape(s, to - at)
        p = shares(dense + 2, (totals + 2 * kept)[:, None])
        q = shares(dense.sum(axis=0) + 2, every)
        for i in range(s):
            sums[i, i + 1 :] += _apart(p[i], p[i + 1 :]).sum(axis=1)
            more = np.flatnonzero((dense[i] > 0) & (p[i] > q))
            value = _apart(p[i][more], q[more])
            first = np.argsort(-value, kind="stable")[:top]
            best[i] += zip((-value[first]).tolist(), (more[first] + at).tolist(), strict=True)
    a, b = np.triu_indices(s, 1)
    picked = [(i, v, t) for i in range(s) for v, t in sorted(best[i])[:top]]
    who = pa.array([x[0] for x in picked], pa.int64())
    source = pa.concat_arrays([sources.take(pa.array(a)), sources.take(who)])
    other = pa.concat_arrays([sources.take(pa.array(b)), pa.nulls(len(picked), pa.string())])
    term = pa.concat_arrays([pa.nulls(len(a), pa.string()), pa.array(dictionary[[x[2] for x in picked]].tolist(), pa.binary()).cast(pa.string())])
    value = pa.concat_arrays([pa.array(sums[a, b]), pa.array([-x[1] for x in picked], pa.int64())])
    return pa.table({"lang": pa.array([key[0].as_py()] * len(value), pa.string()), "source": source, "other": other, "term": term, "value": value})


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) for each pair of lang and source that occurs in ``docs``.

    A language keeps the terms that ``least_docs`` of its rows hold, V in number. A group's share p of a term is
    1 + floor(10**9 * (count + 2) / (N + 2 V)), N its occurrences of kept terms; q is the other's, and a term's value is
    floor((p - q)**2 / (p + q)). Part ``pair``: item is each other source of the language, the value summed over all
    kept terms (0 where none is kept). Part ``term``: item is a term of the group with p above the share q in the whole
    language, the ``top`` greatest only. Ranks start at 1 for each group and part, ties by the item's bytes.

    Nulls in lang, source and text count as empty strings; repeated rows count each; other columns are ignored; an
    empty table gives no rows. Exact in 64-bit integers up to 9 * 10**15 occurrences a language.

    Scale: texts are read once and stay where they are; what is moved are counts by (lang, source, term), summed within
    megabytes of texts and again within tasks. A range of terms is one unit of work, held in dense pieces of bounded
    size. The result's part ``pair`` grows with the square of a language's sources, as it lists them; a task holds that
    square of sums, so some thousands of sources a language are the limit.
    """
    spark = docs.sparkSession
    counts = materialize(term_counts(docs))
    groups = docs.select(*[text_or_empty(c).alias(c) for c in ("lang", "source")]).distinct()
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("_d")).where(F.col("_d") >= least_docs).select("lang", "term")
    rows = materialize(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = rows.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    heads = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    heads = materialize(heads.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")))

    ranges = max(spark.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    ranged = materialize(rows.repartitionByRange(ranges, "lang", "term").withColumn("range", F.spark_partition_id()))
    present = ranged.select("lang", "range").distinct()
    work = ranged.withColumn("v", F.lit(None).cast("long")).unionByName(present.join(heads, "lang").withColumn("term", F.lit(None).cast("string")))
    schema = "lang string, source string, other string, term string, value long"
    found = materialize(work.groupBy("lang", "range").applyInArrow(lambda key, table: _compare(key, table, top), schema))

    half = found.where("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = half.union(half.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    pairs = heads.select("lang", "source").join(heads.select("lang", F.col("source").alias("other")), "lang").where("source <> other")
    pairs = pairs.join(both, ["lang", "source", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("value", F.lit(0)).alias("value"))
    terms = found.where("term is not null").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
