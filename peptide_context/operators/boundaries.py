"""Mature boundaries predicted from cut sites alone, their accuracy, and cut sites on the genome."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import FLANK, PROTEASE_MOTIFS, ROLE_PRIORITY
from ..functions.motifs import Located, Motifs
from ..functions.sequences import count_of, slices
from .cleavage import letter_table
from .components import materialize, small_side
from .genemodel import bonds_to_genome
from .ungapped import first_of


def predict_mature_start(precursors: DataFrame, candidates: DataFrame, signal: DataFrame, min_mature: int = 5, max_mature: int = 120) -> DataFrame:
    """(precursor_id, seq_len, signal_end, mature_start, kr_before, sel_score) for every precursor (id, seq).

    Of the cuts behind the signal whose remainder is min to max long, the best by role priority + 3 * score + 2 * basic
    share of the remainder + 0.5 for remainders up to 60; ties go to the earlier motif, then the earlier bond. Without
    any, the residue behind the signal, score 0. kr_before counts K and R in front of the start. The cuts are those of
    ``scan_cleavage`` and bring their own counts, so no sequence is moved; max_by combines before the shuffle by precursor.
    """
    signal = signal.withColumnRenamed("acc", "precursor_id")
    base = precursors.select(F.col("id").alias("precursor_id"), "seq").join(signal, "precursor_id", "left")
    base = base.select("precursor_id", F.length("seq").alias("seq_len"), F.coalesce("signal_end", F.lit(0)).alias("signal_end"), count_of(F.left("seq", F.coalesce("signal_end", F.lit(0))), "KR").alias("kr_signal"))
    tail = F.col("seq_len") - F.col("bond")
    near = candidates.where((tail >= min_mature) & (tail <= max_mature))
    near = near.select("precursor_id", "role", "bond", "motif_ord", "score", "kr_before", tail.alias("tail"), ((F.col("kr_total") - F.col("kr_before")) / tail).alias("basic"))
    rows = near.join(base.select("precursor_id", "signal_end"), "precursor_id").where("bond > signal_end")
    priority = F.lit(1.0)
    for role, weight in ROLE_PRIORITY.items():
        priority = F.when(F.col("role") == role, weight).otherwise(priority)
    value = priority + 3.0 * F.col("score") + 2.0 * F.col("basic") + F.when((F.col("tail") >= min_mature) & (F.col("tail") <= 60), 0.5).otherwise(0.0)
    rows = rows.withColumn("value", value)
    best = rows.groupBy("precursor_id").agg(F.max_by(F.struct("bond", "value", "kr_before"), F.struct("value", -F.col("motif_ord"), -F.col("bond"))).alias("b"))
    start = F.coalesce(F.col("b.bond"), F.col("signal_end")) + 1
    return base.join(best, "precursor_id", "left").select(
        "precursor_id", "seq_len", "signal_end", start.alias("mature_start"), F.coalesce("b.kr_before", "kr_signal").alias("kr_before"), F.coalesce("b.value", F.lit(0.0)).alias("sel_score")
    )


def with_counts(cuts: DataFrame, seqs: DataFrame) -> DataFrame:
    """Cuts (precursor_id, bond) from elsewhere than ``scan_cleavage``, with the counts it gives, from sequences (precursor_id, seq)."""
    rows = cuts.join(seqs.select("precursor_id", F.col("seq").alias("_s")), "precursor_id")
    counts = {f"{k.lower()}_{n}": count_of(s, k) for k in ("KR", "DE") for n, s in (("before", F.left("_s", F.col("bond"))), ("total", F.col("_s")))}
    return rows.withColumns({"seq_len": F.length("_s"), **counts}).drop("_s")


def trim_cterm(starts: DataFrame, candidates: DataFrame, min_mature: int = 5, max_mature: int = 120, cterm: bool = True, min_tail: int = 3) -> DataFrame:
    """Adds mature_end and mature_end_source to ``predict_mature_start``.

    The last cut behind the mature start that leaves a tail of at least ``min_tail``, a mature part of min to max
    residues, a net anionic tail, and a mature part more basic than the tail; else the end of the protein. ``starts`` should be
    a written table: it has a row a protein and goes to the cuts by broadcast if it is small, so that these are not moved. Starts
    that bring sequences instead of counts (precursor_id, seq, mature_start) are taken too, with cuts of any kind.
    """
    if "kr_before" not in starts.columns:
        candidates = candidates if "kr_before" in candidates.columns else with_counts(candidates, starts)
        starts = starts.withColumns({"seq_len": F.length("seq"), "kr_before": count_of(F.left("seq", F.col("mature_start") - 1), "KR")})
    if not cterm:
        return starts.withColumn("mature_end", F.col("seq_len")).withColumn("mature_end_source", F.lit("terminus"))
    own = small_side(starts.select("precursor_id", "mature_start", F.col("kr_before").alias("kr_start")))
    rows = candidates.select("precursor_id", "bond", "seq_len", "kr_before", "kr_total", "de_before", "de_total").join(own, "precursor_id")
    size, n = F.col("bond") - F.col("mature_start") + 1, F.col("seq_len") - F.col("bond")
    rows = rows.where((F.col("bond") > F.col("mature_start")) & (n >= min_tail) & (size >= min_mature) & (size <= max_mature))
    basic = (F.col("kr_total") - F.col("kr_before")) / n
    fits = ((F.col("de_total") - F.col("de_before")) / n > basic) & ((F.col("kr_before") - F.col("kr_start")) / size > basic)
    ends = rows.where(fits).groupBy("precursor_id").agg(F.max("bond").alias("cut"))
    joined = starts.join(ends, "precursor_id", "left")
    source = F.when(F.col("cut").isNull(), "terminus").otherwise("cterm_cut")
    return joined.withColumn("mature_end", F.coalesce("cut", "seq_len")).withColumn("mature_end_source", source).drop("cut")


def predict_boundaries(precursors, candidates, signal, min_mature: int = 5, max_mature: int = 120, cterm: bool = True, min_tail: int = 3) -> DataFrame:
    """The region table predicted for every precursor; pro coordinates are 0 where no pro-region is left. ``candidates`` are read
    twice, and should be a written table."""
    starts = materialize(predict_mature_start(precursors, candidates, signal, min_mature, max_mature))
    full = trim_cterm(starts, candidates, min_mature, max_mature, cterm, min_tail)
    has = F.col("mature_start") - 1 >= F.col("signal_end") + 1
    return full.select(
        F.concat("precursor_id", F.lit("_pred")).alias("peptide_id"), "precursor_id", F.lit(".").alias("gene_symbol"),
        F.col("seq_len").alias("precursor_len"), "signal_end", "mature_start", "mature_end",
        F.when(has, F.col("signal_end") + 1).otherwise(0).alias("pro_start"), F.when(has, F.col("mature_start") - 1).otherwise(0).alias("pro_end"),
        F.lit(".").alias("dibasic_hint"), "sel_score", "mature_end_source",
    )


def predict_regions(precursors: DataFrame, signal: DataFrame, source, min_mature: int = 5, max_mature: int = 120, min_tail: int = 3) -> DataFrame:
    """``predict_boundaries`` on the sites of ``scan_scored_sites``, protein by protein in one pass: no site leaves it.

    ``source`` is a matrix or a logistic regression on windows. Ids of ``precursors`` (id, seq) and of ``signal`` (acc, signal_end) are
    taken to be unique. Signals go to the proteins by broadcast if they are small, else the two are joined by shuffle.
    """
    patterns, table = [(p, o) for _, _, p, o, *_ in PROTEASE_MOTIFS], letter_table(source)
    weight = np.array([ROLE_PRIORITY.get(m[1], 1.0) for m in PROTEASE_MOTIFS], np.float64)

    def predict(seqs: list[str], signal_end: np.ndarray, motifs: Motifs) -> list[pa.Array]:
        x = Located(motifs, seqs, FLANK)
        score, bond, which = x.scores(table), x.bond, x.which
        basic, acid = x.running("KR"), x.running("DE")
        first, last = x.start, x.start + x.size
        tail = x.size[which] - bond
        kr_tail, de_tail = basic[last[which]] - basic[first[which] + bond], acid[last[which]] - acid[first[which] + bond]
        value = weight[x.motif] + 3.0 * score + 2.0 * (kr_tail / tail) + np.where((tail >= min_mature) & (tail <= 60), 0.5, 0.0)
        at = np.flatnonzero((tail >= min_mature) & (tail <= max_mature) & (bond > signal_end[which]))
        at = at[np.lexsort((bond[at], x.motif[at], -value[at], which[at]))]
        at = at[first_of(which[at])]
        cut, best = signal_end.copy(), np.zeros(len(seqs))
        cut[which[at]], best[which[at]] = bond[at], value[at]
        kr_start = basic[first + np.clip(cut, 0, x.size)] - basic[first]
        size = bond - cut[which]
        part = (bond > cut[which] + 1) & (tail >= min_tail) & (size >= min_mature) & (size <= max_mature)
        kr = kr_tail[part] / tail[part]
        mature = (basic[first[which] + bond] - basic[first[which]] - kr_start[which])[part] / size[part]
        fits = (de_tail[part] / tail[part] > kr) & (mature > kr)
        end = np.zeros(len(seqs), np.int64)
        np.maximum.at(end, which[part][fits], bond[part][fits])
        number = lambda v: pa.array(v, pa.int32())
        return [number(x.size), number(signal_end), number(cut + 1), pa.array(best), number(np.where(end > 0, end, x.size)), pa.array(np.where(end > 0, "cterm_cut", "terminus").tolist(), pa.string())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        motifs = Motifs(patterns)
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), 1 << 18):
                ends = batch.column(2).slice(at, len(part)).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = batch.column(0).slice(at, len(part))
                at += len(part)
                yield pa.record_batch([ids, *predict(part.to_pylist(), ends, motifs)], names)

    names = ["precursor_id", "seq_len", "signal_end", "mature_start", "sel_score", "mature_end", "mature_end_source"]
    schema = "precursor_id string, seq_len int, signal_end int, mature_start int, sel_score double, mature_end int, mature_end_source string"
    own = small_side(materialize(signal.select(F.col("acc").alias("id"), "signal_end")))
    rows = precursors.select("id", "seq").join(own, "id", "left").select(F.col("id").cast("string"), "seq", F.coalesce("signal_end", F.lit(0)).cast("int").alias("signal_end"))
    has = F.col("mature_start") - 1 >= F.col("signal_end") + 1
    return rows.mapInArrow(work, schema).select(
        F.concat("precursor_id", F.lit("_pred")).alias("peptide_id"), "precursor_id", F.lit(".").alias("gene_symbol"),
        F.col("seq_len").alias("precursor_len"), "signal_end", "mature_start", "mature_end",
        F.when(has, F.col("signal_end") + 1).otherwise(0).alias("pro_start"), F.when(has, F.col("mature_start") - 1).otherwise(0).alias("pro_end"),
        F.lit(".").alias("dibasic_hint"), "sel_score", "mature_end_source",
    )


def boundary_accuracy(pred: DataFrame, truth: DataFrame, candidates: DataFrame, tol: int = 2, corrected: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, summary) of predicted against true mature starts, truth(precursor_id, mature_start, ord), last ``ord`` wins.

    A start is hit within ``tol``; it is covered if any cut's bond lies within ``tol`` of the start itself (of the bond
    before it, if ``corrected``). Only precursors with a prediction count; the summary's rates are null if there is none.
    """
    true = truth.groupBy("precursor_id").agg(F.max_by("mature_start", "ord").alias("true_mature_start"))
    rows = true.join(pred.select("precursor_id", F.col("mature_start").alias("pred_mature_start")), "precursor_id")
    aim = F.col("true_mature_start") - (1 if corrected else 0)
    near = rows.join(candidates.select("precursor_id", "bond"), "precursor_id").where(F.abs(F.col("bond") - aim) <= tol)
    near = near.select("precursor_id").distinct().withColumn("scanner_covered", F.lit(1))
    hit = F.when(F.abs(F.col("pred_mature_start") - F.col("true_mature_start")) <= tol, 1).otherwise(0)
    rows = rows.join(near, "precursor_id", "left").select(
        "precursor_id", "true_mature_start", "pred_mature_start", hit.alias("boundary_hit"), F.coalesce("scanner_covered", F.lit(0)).alias("scanner_covered")
    )
    return rows, rows.agg(F.count("*").alias("n"), F.avg("boundary_hit").alias("accuracy"), F.avg("scanner_covered").alias("scanner_recall"))


def cutsites_bed(scored: DataFrame, units: DataFrame) -> DataFrame:
    """One-base BED rows of candidate cuts: name is enzyme|precursor|cutAfterN|residue. Unmapped cuts give no row."""
    keys = ["protein", "enzyme", "bond", "p1_residue", "score"]
    placed = bonds_to_genome(scored.withColumnRenamed("precursor_id", "protein").select(*keys), units, keys)
    name = F.concat_ws("|", "enzyme", "protein", F.concat(F.lit("cutAfter"), "bond"), "p1_residue")
    return placed.select("chrom", "start0", "end0", name.alias("name"), "score", "strand")
