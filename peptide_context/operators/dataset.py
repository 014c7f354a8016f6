"""Labelled records: positives from regions, decoys, negatives, and their feature vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ENZYME_FIELDS, LOCUS_FIELDS
from ..functions.sequences import aa_composition, residue_counts, seeded_rank_key, seq_stats

LEVELS = ["M1", "M2", "M3", "M4", "M5", "M6"]
_PREFIXES = {"M1": ("m1_",), "M2": ("m2pro_", "m2_"), "M3": ("m3prec_", "m3_"), "M6": ("m6p_", "m6g_")}
_NAMES = {"M4": ENZYME_FIELDS, "M5": LOCUS_FIELDS}


def cut_context(scored: DataFrame, strong: float = 0.5) -> DataFrame:
    """(precursor_id, cut_score, n_strong_cuts): best cut score (at least 0) and number of strong cuts."""
    score = F.coalesce("score", F.lit(0.0))
    return scored.groupBy("precursor_id").agg(F.greatest(F.max(score), F.lit(0.0)).alias("cut_score"), F.sum(F.when(score >= strong, 1).otherwise(0)).cast("int").alias("n_strong_cuts"))


def assemble_positives(peptides: DataFrame, regions: DataFrame, precursors: DataFrame, cuts: DataFrame | None = None, locus: DataFrame | None = None) -> DataFrame:
    """One record a region: sequences, flags and context fields; what is missing is empty or 0.

    Enzyme, transporter, density and neighbour fields are 0 unless ``locus`` (by peptide_id) brings them.
    """
    rows = regions.select("peptide_id", "precursor_id", "signal_end", "mature_start", "dibasic_hint")
    rows = rows.join(peptides.select(F.col("id").alias("peptide_id"), F.col("seq").alias("mature_seq")), "peptide_id", "left")
    rows = rows.join(precursors.select(F.col("id").alias("precursor_id"), F.col("seq").alias("precursor_seq")), "precursor_id", "left")
    if cuts is not None:
        rows = rows.join(cuts, "precursor_id", "left")
    if locus is not None:
        rows = rows.join(locus, "peptide_id", "left")
    value = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in rows.columns else F.lit(0)
    se, ms, prec = F.col("signal_end"), F.col("mature_start"), F.coalesce("precursor_seq", F.lit(""))
    pro = F.when(ms > se + 1, F.substring(prec, se + 1, ms - 1 - se)).otherwise("")
    numbers = [*ENZYME_FIELDS, *LOCUS_FIELDS]
    return rows.select(
        F.col("peptide_id").alias("id"), F.coalesce("mature_seq", F.lit("")).alias("mature_seq"), pro.alias("pro_seq"), prec.alias("precursor_seq"),
        F.when(se > 0, 1).otherwise(0).alias("has_signal"), se.alias("signal_len"),
        F.when(F.col("dibasic_hint").isin(".", ""), 0).otherwise(1).alias("has_dibasic"), *[value(c).cast("double").alias(c) for c in numbers],
    )


def shuffled_decoys(positives: DataFrame, per_pos: int = 1, seed: int = 0) -> DataFrame:
    """(id, label 0, mature_seq, precursor_seq): ``per_pos`` permutations of each mature sequence.

    The residues are sorted by the MD5 of (id, draw, place, seed), inside the row.
    """
    rows = positives.select(F.col("id").alias("own"), "mature_seq", F.explode(F.sequence(F.lit(0), F.lit(per_pos - 1))).alias("i"))
    keyed = lambda c, p: F.struct(seeded_rank_key(F.col("own"), F.col("i"), p, F.lit(seed)).alias("h"), c.alias("c"))
    order = F.array_sort(F.transform(F.split("mature_seq", ""), keyed))
    mixed = F.array_join(F.transform(order, lambda x: x["c"]), "")
    rows = rows.select("own", "i", mixed.alias("s"))
    return rows.select(F.concat("own", F.lit("_shuf"), "i").alias("id"), F.lit(0).alias("label"), F.col("s").alias("mature_seq"), F.col("s").alias("precursor_seq"))


def make_dataset(positives: DataFrame, negatives: DataFrame | None = None, per_pos: int = 1, seed: int = 0) -> DataFrame:
    """Positives (1), decoys (0) and other sequences (id, seq) as ``neg_<id>`` (0); fields that they lack are null."""
    out = positives.withColumn("label", F.lit(1))
    if per_pos > 0:
        out = out.unionByName(shuffled_decoys(positives, per_pos, seed), allowMissingColumns=True)
    if negatives is not None:
        other = negatives.select(F.concat(F.lit("neg_"), "id").alias("id"), F.lit(0).alias("label"), F.col("seq").alias("mature_seq"), F.col("seq").alias("precursor_seq"))
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def method_features(dataset: DataFrame, keep: tuple[str, ...] = ("id", "label")) -> DataFrame:
    """The feature columns of each record, in their order: mature (29), pro (10), precursor (11), enzyme (4), locus (7),
    then any embedding columns. Absent, null or unreadable numbers are 0."""
    have = set(dataset.columns)
    text = lambda c: F.col(c) if c in have else F.lit("")
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    # residues are counted once a sequence; all statistics come from the counts
    seqs = {c: F.upper(F.coalesce(text(c), F.lit(""))) for c in ("mature_seq", "pro_seq", "precursor_seq")}
    counts = {c: F.col(f"_n_{c}") for c in seqs}
    return dataset.withColumns({f"_n_{c}": residue_counts(x) for c, x in seqs.items()}).select(
        *[c for c in keep if c in have],
        *seq_stats(text("mature_seq"), "m1", counts["mature_seq"]), *aa_composition(text("mature_seq"), "m1", counts["mature_seq"]),
        *seq_stats(text("pro_seq"), "m2pro", counts["pro_seq"]), number("has_dibasic").alias("m2_has_dibasic"),
        *seq_stats(text("precursor_seq"), "m3prec", counts["precursor_seq"]), number("has_signal").alias("m3_has_signal"), number("signal_len").alias("m3_signal_len"),
        *[number(c).alias(c) for c in (*ENZYME_FIELDS, *LOCUS_FIELDS)],
        *[number(c).alias(c) for c in dataset.columns if c.startswith(_PREFIXES["M6"])],
    )


def cumulative_columns(columns: list[str], level: str) -> list[str]:
    """The feature columns of all blocks up to ``level``, in feature order."""
    upto = LEVELS[: LEVELS.index(level) + 1]
    prefixes = tuple(p for lv in upto for p in _PREFIXES.get(lv, ()))
    names = {n for lv in upto for n in _NAMES.get(lv, ())}
    return [c for c in dict.fromkeys(columns) if c in names or c.startswith(prefixes)]
