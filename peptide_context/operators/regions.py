"""Signal, pro and mature regions on precursor proteins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import dibasic_hint
from .ungapped import equal_residues, first_of


def _starts(text: str, block: str) -> Iterator[int]:
    at = text.find(block)
    while at >= 0:
        yield at
        at = text.find(block, at + 1)


def candidate_windows(precursor: str, peptide: str, allowed: int) -> np.ndarray:
    """0-based starts of the windows that may have at most ``allowed`` mismatches, in order.

    Of allowed + 1 blocks of the peptide one stands there unchanged, so only windows around such a block are returned; all
    windows, if the peptide has no more residues than mismatches are allowed.
    """
    n, m = len(precursor), len(peptide)
    if m <= allowed:
        return np.arange(n - m + 1)
    edges = [m * i // (allowed + 1) for i in range(allowed + 2)]
    found = {p - lo for lo, hi in zip(edges[:-1], edges[1:], strict=True) for p in _starts(precursor, peptide[lo:hi])}
    return np.array(sorted(w for w in found if 0 <= w <= n - m), np.int64)


def best_windows(precursors: list[str], peptides: list[str], max_mismatch_frac: float) -> list[int | None]:
    """1-based start of the leftmost window with fewest mismatches for each pair, null if there are too many; peptides are not
    empty and no longer than their precursors. The windows of all pairs are compared together."""
    allowed = [max(1, int(max_mismatch_frac * len(p))) for p in peptides]
    windows = [candidate_windows(*x) for x in zip(precursors, peptides, allowed, strict=True)]
    which = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
    start = np.concatenate([np.zeros(0, np.int64), *windows])
    sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (precursors, peptides)]
    data = [np.frombuffer("".join(x).encode("utf-32-le"), "<u4") for x in (precursors, peptides)]
    at = [np.cumsum(s) - s for s in sizes]
    same = equal_residues(data[0], at[0][which] + start, data[1], at[1][which], sizes[1][which])
    wrong = sizes[1][which] - same
    order = np.lexsort((start, wrong, which))
    order = order[first_of(which[order])]
    out: list[int | None] = [None] * len(windows)
    for k, w, s in zip(which[order].tolist(), wrong[order].tolist(), start[order].tolist(), strict=True):
        if w <= allowed[k]:
            out[k] = s + 1
    return out


def find_mature(pairs: DataFrame, max_mismatch_frac: float = 0.2) -> DataFrame:
    """Adds mature_start and mature_end (1-based, inclusive) to rows with ``precursor`` and ``peptide`` sequences.

    Exact match first, then case-insensitive, then the window of fewest mismatches if at most max(1, part of the
    length); null if nothing fits, and for empty or too long peptides. Only the sequences of rows that both matches leave
    open reach the numpy helper, which looks at windows around an unchanged block alone (``candidate_windows``).
    """
    usable = (F.length("peptide") > 0) & (F.length("peptide") <= F.length("precursor"))
    exact = F.when(usable, F.greatest(F.instr("precursor", F.col("peptide")), F.lit(0)))
    folded = F.instr(F.upper("precursor"), F.upper("peptide"))
    start = F.when(exact > 0, exact).when(usable & (folded > 0), folded)
    located = pairs.withColumn("mature_start", start)

    @F.arrow_udf("int")
    def search(precursors: pa.Array, peptides: pa.Array) -> pa.Array:
        at = np.flatnonzero(precursors.is_valid().to_numpy(zero_copy_only=False))
        found = np.zeros(len(precursors), np.int32)
        for i in range(0, len(at), 1000):
            part = pa.array(at[i : i + 1000])
            found[at[i : i + 1000]] = [x or 0 for x in best_windows(precursors.take(part).to_pylist(), peptides.take(part).to_pylist(), max_mismatch_frac)]
        return pa.array(found, mask=found == 0)

    left = F.col("mature_start").isNull() & usable
    both = located.withColumn("mature_start", F.coalesce("mature_start", search(F.when(left, F.col("precursor")), F.when(left, F.col("peptide")))))
    return both.withColumn("mature_end", (F.col("mature_start") + F.length("peptide") - 1).cast("int"))


def define_regions(map_: DataFrame, precursors: DataFrame, peptides: DataFrame, signal: DataFrame, dibasic: tuple[str, ...] = ("KR", "RR", "RK", "KK")) -> DataFrame:
    """Region table of mapped peptides: map_(peptide_id, precursor_id, gene_symbol), sequences (id, seq), signal (acc, signal_end).

    Peptides whose sequence, precursor or place is missing are dropped; no signal row means signal_end 0; without a
    pro-region pro_start and pro_end are 0.
    """
    prec = precursors.select(F.col("id").alias("precursor_id"), F.col("seq").alias("precursor"))
    pep = peptides.select(F.col("id").alias("peptide_id"), F.col("seq").alias("peptide"))
    pairs = map_.select("peptide_id", "precursor_id", "gene_symbol").join(prec, "precursor_id").join(pep, "peptide_id")
    found = find_mature(pairs).where("mature_start is not null")
    found = found.join(signal.withColumnRenamed("acc", "precursor_id"), "precursor_id", "left")
    se = F.coalesce("signal_end", F.lit(0))
    has_pro = F.col("mature_start") - 1 >= se + 1
    return found.select(
        "peptide_id", "precursor_id", "gene_symbol", F.length("precursor").alias("precursor_len"), se.alias("signal_end"),
        "mature_start", "mature_end", F.when(has_pro, se + 1).otherwise(0).alias("pro_start"),
        F.when(has_pro, F.col("mature_start") - 1).otherwise(0).alias("pro_end"),
        dibasic_hint(F.col("precursor"), F.col("mature_start"), dibasic).alias("dibasic_hint"),
    )
