"""Protease cut sites on proteins: scan, junction windows, position weight matrices, rescoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import AMINO_ACIDS, FLANK, HYDROPATHY, POSITION_LABELS, PROTEASE_MOTIFS
from ..functions.digests import drawn_places
from ..functions.motifs import SITES, scan, scan_scored
from ..functions.sequences import count_of, full_window, logistic, residue_counts
from .window_fit import LETTERS, feature_table


def scan_cleavage(precursors: DataFrame, motifs: list[tuple] = PROTEASE_MOTIFS, flank: int = FLANK) -> DataFrame:
    """Cut sites of motifs on proteins (id, seq): leftmost non-overlapping matches of each motif (enzyme, role, pattern,
    cut offset, ..), patterns in Python's syntax.

    (precursor_id, enzyme, role, bond, p1_residue, window, window8, seq_len, motif_ord, score, kr_before, kr_total, de_before,
    de_total): the bond lies behind residue ``bond``, 1 <= bond < length. All motifs run as one automaton over slices of the sequences,
    and only bonds come out. They carry their windows, and how many of K and R, and of D and E, stand in front of them and in the
    whole protein, so that no later step needs the sequence. Score is 1. Null sequences have no sites.
    """
    patterns = [(p, o) for _, _, p, o, *_ in motifs]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scan(batches, patterns, flank)

    kinds = ", ".join(f"{c} {'string' if t == pa.string() else 'int'}" for c, t in SITES.items())
    found = precursors.select(F.col("id").cast("string"), F.col("seq").cast("string")).mapInArrow(work, f"precursor_id string, {kinds}")
    name = lambda i: F.element_at(F.array(*[F.lit(m[i]) for m in motifs]), F.col("motif_ord") + 1)
    return found.select(
        "precursor_id", name(0).alias("enzyme"), name(1).alias("role"), "bond", "p1_residue", "window", "window8", "seq_len", "motif_ord",
        F.lit(1.0).alias("score"), "kr_before", "kr_total", "de_before", "de_total",
    )


def junction_windows(precursors: DataFrame, regions: DataFrame, flank: int = FLANK) -> DataFrame:
    """(peptide_id, precursor_id, junction, window): full windows at the bonds pro to mature and signal to pro."""
    prec = precursors.select(F.col("id").alias("precursor_id"), "seq")
    ms, se = F.col("mature_start") - 1, F.col("signal_end")
    sides = F.array(
        F.struct(F.lit("pro_mature").alias("junction"), full_window(F.col("seq"), ms, flank).alias("window")),
        F.struct(F.lit("signal_pro").alias("junction"), F.when(se > 0, full_window(F.col("seq"), se, flank)).alias("window")),
    )
    rows = regions.join(prec, "precursor_id").select("peptide_id", "precursor_id", F.explode(sides).alias("j"))
    return rows.select("peptide_id", "precursor_id", "j.*").where("window is not null")


def motif_pfm(windows: DataFrame, top: int = 3) -> DataFrame:
    """(junction, pos, label, rank, aa, freq): the ``top`` residues at each place of the windows, ties by letter."""
    counts = windows.select("junction", F.posexplode(F.split("window", "")).alias("pos", "aa")).groupBy("junction", "pos", "aa").agg(F.count("*").alias("n"))
    group = Window.partitionBy("junction", "pos")
    ranked = counts.withColumn("freq", F.col("n") / F.sum("n").over(group)).withColumn("rank", F.row_number().over(group.orderBy(F.col("n").desc(), "aa")))
    label = F.element_at(F.array(*[F.lit(x) for x in POSITION_LABELS]), F.col("pos") + 1)
    return ranked.where(F.col("rank") <= top).select("junction", (F.col("pos") + 1).alias("pos"), label.alias("label"), "rank", "aa", "freq")


def background(precursors: DataFrame) -> DataFrame:
    """(aa, freq): residue frequencies over all sequences, one added to each of the 20 counts.

    Residues are counted in one pass a sequence, and summed in one aggregate: no explode, one row a task to shuffle.
    """
    counts = precursors.select(residue_counts(F.col("seq")).alias("c"))
    sums = counts.agg(*[F.coalesce(F.sum(F.col("c")[i].cast("long")), F.lit(0)).alias(a) for i, a in enumerate(AMINO_ACIDS)])
    total = sum((F.col(a) for a in AMINO_ACIDS), F.lit(len(AMINO_ACIDS)))
    pairs = F.array(*[F.struct(F.lit(a).alias("aa"), ((F.col(a) + 1) / total).alias("freq")) for a in AMINO_ACIDS])
    return sums.select(F.explode(pairs).alias("p")).select("p.*")


def build_pwm(windows: DataFrame, bg: DataFrame, length: int = 2 * FLANK) -> DataFrame:
    """(pos, aa, logodds): log2 of smoothed residue frequency over background for each place, 1-based."""
    letters = windows.where(F.length("window") == length).select(F.posexplode(F.split("window", "")).alias("p", "aa"))
    counts = letters.where(F.col("aa").isin(*AMINO_ACIDS)).groupBy((F.col("p") + 1).alias("pos"), "aa").agg(F.count("*").alias("n"))
    places = bg.withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(length))))
    grid = places.join(counts, ["pos", "aa"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    grid = grid.withColumn("total", F.sum("n").over(Window.partitionBy("pos")))
    share = (F.col("n") + 0.5) / (F.col("total") + 0.5 * len(AMINO_ACIDS))
    return grid.select("pos", "aa", F.log2(share / F.col("freq")).alias("logodds"))


def pwm_array(pwm: DataFrame, length: int = 2 * FLANK) -> DataFrame:
    """The matrix as one row with an array: the log-odds of residue r at place i stand at 128 * (i - 1) + its code, 0 where there are none."""
    key = (F.col("pos") - 1) * 128 + F.ascii("aa")
    known = pwm.agg(F.map_from_entries(F.collect_list(F.struct(key.cast("int"), "logodds"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(128 * length - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return known.select(every.alias("_pwm"))


def pwm_score(window: Column, pwm: Column, length: int = 2 * FLANK) -> Column:
    """Sum of log-odds over a window by the array of ``pwm_array``, unknown residues 0; null if the window has another length."""
    total = F.lit(0.0)
    for i in range(1, length + 1):
        code = F.least(F.ascii(F.substring(window, F.lit(i), F.lit(1))), F.lit(127))
        total = total + F.get(pwm, code + 128 * (i - 1))
    return F.when(F.length(window) == length, total)


def pwm_scored(df: DataFrame, pwm: DataFrame, window: str) -> DataFrame:
    """``df`` with the PWM score of a column of windows as ``score``. The matrix is one row, and is broadcast as that."""
    rows = df.join(F.broadcast(pwm_array(pwm)))
    return rows.withColumn("score", pwm_score(F.col(window), F.col("_pwm"))).drop("_pwm")


def score_sites(candidates: DataFrame, pwm: DataFrame) -> DataFrame:
    """Candidates with their score replaced: logistic of the PWM score of their full window, 0 where it runs off an end.

    Sites carry their windows, so no sequence is joined.
    """
    return pwm_scored(candidates, pwm, "window8").withColumn("score", F.coalesce(logistic(F.col("score")), F.lit(0.0)))


def score_sites_model(candidates: DataFrame, model) -> DataFrame:
    """Candidates with the probability of a fitted window classifier as score, 0 where the window runs off an end."""
    from pyspark.ml.functions import vector_to_array

    full = candidates.withColumn("features", feature_vector(window_features(F.coalesce("window8", F.lit("X" * 2 * FLANK)))))
    scored = model.transform(full)
    p = F.when(F.col("window8").isNotNull(), vector_to_array("probability")[1]).otherwise(0.0)
    return scored.select(*[c for c in candidates.columns if c != "score"], p.alias("score"))


def letter_table(source) -> np.ndarray:
    """A matrix (pos, aa, logodds), or a logistic regression on ``window_features``, as numbers a place and code of a letter,
    and a constant behind them. Window features are sums over the window's letters, so that a model is a matrix as well."""
    table = np.zeros(128 * 2 * FLANK + 1)
    if isinstance(source, DataFrame):
        for r in source.collect():
            table[128 * (r["pos"] - 1) + ord(r["aa"])] = r["logodds"]
        return table
    letters = feature_table() @ source.coefficients.toArray()
    for i in range(2 * FLANK):
        for k, aa in enumerate(AMINO_ACIDS):
            table[128 * i + ord(aa)] = letters[i * LETTERS + k]
    table[-1] = source.intercept
    return table


def scan_scored_sites(precursors: DataFrame, source, motifs: list[tuple] = PROTEASE_MOTIFS, flank: int = FLANK) -> DataFrame:
    """(precursor_id, enzyme, role, bond, motif_ord, score): ``scan_cleavage`` and ``score_sites`` by a matrix, or ``score_sites_model``
    by a logistic regression, in one pass over the proteins: no window leaves it."""
    patterns, table = [(p, o) for _, _, p, o, *_ in motifs], letter_table(source)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scan_scored(batches, patterns, flank, table)

    found = precursors.select(F.col("id").cast("string"), F.col("seq").cast("string")).mapInArrow(work, "precursor_id string, motif_ord int, bond int, score double")
    name = lambda i: F.element_at(F.array(*[F.lit(m[i]) for m in motifs]), F.col("motif_ord") + 1)
    return found.select("precursor_id", name(0).alias("enzyme"), name(1).alias("role"), "bond", "motif_ord", "score")


def negative_windows(precursors: DataFrame, regions: DataFrame, per_pos: int = 3, tol: int = 2, seed: int = 0, flank: int = FLANK) -> DataFrame:
    """(precursor_id, bond, window): drawn windows away from true bonds, ``per_pos`` for each true bond (at least one).

    Bonds from flank to length - flank - 1 and farther than ``tol`` from every true bond are ordered by the MD5 of
    (precursor, bond, seed); the first ones are taken. The digests are made in numpy, many bonds at a time, from ids and lengths alone.
    """
    ms, se = F.col("mature_start"), F.col("signal_end")
    own = F.array_compact(F.array(F.when(ms > 1, ms - 1), F.when(se > 0, se)))
    truth = regions.groupBy("precursor_id").agg(F.flatten(F.collect_list(own)).alias("bonds"))
    rows = precursors.select(F.col("id").alias("precursor_id"), "seq").join(truth, "precursor_id").where(F.length("seq") > 2 * flank)

    @F.arrow_udf("array<int>")
    def draw(ids: pa.Array, sizes: pa.Array, bonds: pa.Array) -> pa.Array:
        names, true, drawn = ids.cast(pa.binary()).to_pylist(), bonds.to_pylist(), []
        for at in range(0, len(names), 1000):
            part = slice(at, at + 1000)
            ends = [n - flank for n in sizes[part].to_pylist()]
            near = [sorted({k for b in t for k in range(b - tol, b + tol + 1)}) for t in true[part]]
            drawn += drawn_places(names[part], [flank] * len(ends), ends, near, [max(len(t), 1) * per_pos for t in true[part]], seed)
        return pa.array(drawn, pa.list_(pa.int32()))

    some = draw(F.col("precursor_id").cast("string"), F.length("seq"), F.col("bonds").cast("array<int>"))
    taken = rows.select("precursor_id", "seq", F.explode(some).alias("bond"))
    return taken.select("precursor_id", "bond", full_window(F.col("seq"), F.col("bond"), flank).alias("window"))


def window_features(window: Column, length: int = 2 * FLANK) -> Column:
    """Array of 165 doubles: 20 indicators a place, then basic share, mean hydropathy, and flags of P1 and P1'."""
    at = lambda i: F.substring(window, F.lit(i), F.lit(1))
    hot = [F.when(at(i) == a, 1.0).otherwise(0.0) for i in range(1, length + 1) for a in AMINO_ACIDS]
    kd = sum((count_of(window, a) * F.lit(HYDROPATHY[a]) for a in AMINO_ACIDS), F.lit(0.0))
    flag = lambda i, letters: F.when(at(i).isin(*letters), 1.0).otherwise(0.0)
    p1 = length // 2
    return F.array(*hot, count_of(window, "KR") / length, kd / length, flag(p1, "KR"), flag(p1, "AGSCT"), flag(p1 + 1, "FWY"))


def feature_vector(features: Column) -> Column:
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(features)
