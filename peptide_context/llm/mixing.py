"""Mixing sources to target weights, by subset-sum budget fitting.

Documents are counted by exact length; each source's budget is met by a proportional share of each length, a document
being taken up to three times, and a bounded-knapsack dynamic program for the remainder; the counts per length are then
filled with documents in a seeded order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, rank_within, small_side

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn and share the total size. A target
    stops at ``most`` times its source's size; the excess goes to the others by weight, until none is above.
    That is target = min(cap, level * weight) for the one level at which the targets sum to the total: with
    the sources in the order of cap / weight, the level is the first that does not exceed the next cap.
    The windows run over one row a source, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("_w", F.element_at(turn, (place % len(weights) + 1).cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    below, above = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(below), F.lit(0.0))) / F.sum("_w").over(above))
        .withColumn("_at", F.row_number().over(by))
        .withColumn("_fits", F.when(F.col("_level") * F.col("_w") <= F.col("_cap") + 1e-9, F.struct("_at", "_level")))
        .withColumn("_level", F.coalesce(F.min("_fits").over(everything)["_level"], F.lit(float("inf"))))
    )
    return per.select("source", "source_size", F.least("_cap", F.col("_level") * F.col("_w")).alias("target"))


def _knapsack(lengths: np.ndarray, room: np.ndarray, cap: int) -> np.ndarray:
    """How many more of each length, at most ``room``, sum to ``cap`` or as near below it as can be: bounded knapsack."""
    more = np.zeros(len(lengths), dtype=np.int64)
    first = np.full(cap + 1, -1, dtype=np.int64)
    open_ = np.zeros(cap + 1, dtype=bool)
    open_[0] = True
    items: list[tuple[int, int]] = []
    for i in np.argsort(lengths, kind="stable"):
        size = int(lengths[i])
        left, step = int(min(room[i], cap // max(1, size))), 1
        while left > 0 and not open_[cap]:
            n = min(step, left)
            w = n * size
            new = np.zeros_like(open_)
            new[w:] = open_[: cap + 1 - w]
            new &= ~open_
            first[new] = len(items)
            items.append((int(i), n))
            open_ |= new
            left -= n
            step *= 2
        if open_[cap]:
            break
    at = int(np.flatnonzero(open_)[-1])
    while at:
        i, n = items[first[at]]
        more[i] += n
        at -= n * int(lengths[i])
    return more


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, reach: int = 1 << 16) -> np.ndarray:
    """How many times to take each length, at most ``counts``, so that the lengths sum to ``budget`` or as near below
    it as can be found.

    Every length gets its proportional share, the longest that fit are added while more than ``reach`` is open, and a
    bounded knapsack closes the rest. Where it cannot (few documents, all too long for the rest), less is shared and more
    left to the knapsack, down to none: what is within ``reach`` then is solved exactly. ``reach`` bounds the program's
    table, not the documents.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), dtype=np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    order, best, gap = np.argsort(-lengths, kind="stable"), None, None
    for share in (1.0, 0.9, 0.5, 0.0):
        taken = np.minimum(np.floor(counts * (share * budget / total)).astype(np.int64), counts)
        left = int(budget - (lengths * taken).sum())
        if left < 0:  # a rounding of the share
            taken = np.maximum(taken - 1, 0)
            left = int(budget - (lengths * taken).sum())
        for part in (8, 8, 8, 1):  # most of the gap is spread over the lengths, longest first
            for i in order:
                if left <= reach:
                    break
                n = min(int(counts[i] - taken[i]), max(1, (left - reach) // int(lengths[i]) // part), left // int(lengths[i]))
                if n > 0:
                    taken[i] += n
                    left -= n * int(lengths[i])
        taken = taken + _knapsack(lengths, counts - taken, int(min(left, reach)))
        left = int(budget - (lengths * taken).sum())
        if best is None or left < gap:
            best, gap = taken, left
        if not gap:
            break
    return best


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """Every row of ``docs(doc_id, text, source)`` with what the mix takes of it.

    Returns (doc_id, size, source_size, target, taken): size in words, taken a multiple of size of at most
    ``most`` times it. Null or blank texts have size 0 and nothing is taken; a null source is a source of
    its own. Rows are told apart by a seeded hash of doc_id, equal rows by their place; a repeated run takes
    the same. An empty table gives an empty result. Other columns of ``docs`` are ignored.

    Scale: one pass reads the texts and writes (doc_id, source, size, hash); counts by (source, length) are
    pre-aggregated; the program sees one row a distinct length of a source; ranks split hot lengths.
    """
    sizes = materialize(
        docs.select(
            F.col("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            F.xxhash64(F.lit(seed), F.col("doc_id")).alias("_h"),
        )
    )
    key = F.xxhash64(F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull())
    targets = materialize(source_targets(sizes, weights, most).withColumn("_source", key).withColumn("_budget", F.round("target").cast("long")))
    keyed = materialize(sizes.withColumn("_source", key))
    lengths = keyed.where("size > 0").groupBy("_source", "size").agg(F.count("*").alias("n"))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        n = pdf["n"].to_numpy(np.int64)
        took = fit_counts(pdf["size"].to_numpy(np.int64), most * n, int(pdf["_budget"].iloc[0]))
        return pd.DataFrame({"_source": pdf["_source"], "size": pdf["size"], "_each": took // n, "_more": took % n})

    take = (
        lengths.join(small_side(targets.select("_source", "_budget")), "_source")
        .groupBy("_source")
        .applyInPandas(fit, "_source long, size long, _each long, _more long")
    )
    ranked = rank_within(keyed, ["_source", "size"], "_h", ["doc_id"])
    copies = F.coalesce("_each", F.lit(0)) + F.when(F.col("rank") < F.coalesce("_more", F.lit(0)), 1).otherwise(0)
    return (
        ranked.join(small_side(materialize(take)), ["_source", "size"], "left")
        .join(small_side(targets.drop("source", "_budget")), "_source")
        .select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))
    )
