"""Gene models: best model of a protein, coding units, projection of residues onto the genome, sequence fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import revcomp


def best_gene_model(mrna: DataFrame, cds: DataFrame) -> DataFrame:
    """The mRNA of the highest score of each protein, of those that have CDS rows; ties go to the least ``ord``."""
    with_cds = mrna.where("protein is not null").join(cds.select("mrna_id").distinct(), "mrna_id", "left_semi")
    best = F.max_by(F.struct("mrna_id", "chrom", "strand", "score"), F.struct(F.col("score"), -F.col("ord"))).alias("r")
    return with_cds.groupBy("protein").agg(best).select("protein", "r.*")


def coding_units(models: DataFrame, cds: DataFrame) -> DataFrame:
    """CDS segments of best models in translation order, with their offsets in the coding sequence.

    (protein, chrom, strand, off_start, off_end, base0, total): offsets are 0-based inclusive, base0 is the genomic
    base (1-based) of off_start. The first segment's phase is skipped; segments without usable bases are dropped.
    """
    rows = models.join(cds, "mrna_id")
    key = F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    order = Window.partitionBy("protein").orderBy(key, "end")
    rows = rows.withColumn("skip", F.when(F.row_number().over(order) == 1, F.col("phase")).otherwise(0))
    rows = rows.withColumn("usable", F.col("end") - F.col("start") + 1 - F.col("skip")).withColumn("_key", key)
    rows = rows.where("usable > 0")
    order = Window.partitionBy("protein").orderBy("_key", "end")
    before = F.coalesce(F.sum("usable").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = F.when(F.col("strand") == "-", F.col("end") - F.col("skip")).otherwise(F.col("start") + F.col("skip"))
    rows = rows.withColumn("off_start", before).withColumn("base0", base)
    rows = rows.withColumn("total", F.sum("usable").over(Window.partitionBy("protein")))
    return rows.select("protein", "chrom", "strand", "off_start", (F.col("off_start") + F.col("usable") - 1).alias("off_end"), "base0", "total")


def aa_intervals_to_genome(intervals: DataFrame, units: DataFrame) -> DataFrame:
    """BED pieces of residue intervals: rows (protein, aa_start, aa_end, ...) join their protein's coding units.

    Adds chrom, strand, start0, end0; intervals that no unit covers give no row. An equi-join on the protein; its few
    units are compared inside it.
    """
    nt0 = (F.col("aa_start") - 1) * 3
    nt1 = F.least(F.col("aa_end") * 3 - 1, F.col("total") - 1)
    rows = intervals.join(units, "protein").withColumn("_a", nt0).withColumn("_b", nt1)
    rows = rows.where("_a <= _b and off_end >= _a and off_start <= _b")
    lo = F.greatest("_a", "off_start") - F.col("off_start")
    hi = F.least("_b", "off_end") - F.col("off_start")
    plus = F.col("strand") == "+"
    start0 = F.when(plus, F.col("base0") + lo - 1).otherwise(F.col("base0") - hi - 1)
    end0 = F.when(plus, F.col("base0") + hi).otherwise(F.col("base0") - lo)
    return rows.withColumn("start0", start0).withColumn("end0", end0).drop("_a", "_b", "off_start", "off_end", "base0", "total")


def bonds_to_genome(bonds: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """The base at the 3' end of the codon before each bond: rows with ``keys``, protein and bond.

    Returns keys, chrom, strand, start0, end0; bonds outside the model give no row.
    """
    spans = bonds.withColumn("aa_start", F.col("bond")).withColumn("aa_end", F.col("bond"))
    pieces = aa_intervals_to_genome(spans, units)
    per = pieces.groupBy(*keys, "chrom", "strand").agg(F.min("start0").alias("_s"), F.max("end0").alias("_e"))
    plus = F.col("strand") == "+"
    return per.select(*keys, "chrom", "strand", F.when(plus, F.col("_e") - 1).otherwise(F.col("_s")).alias("start0"), F.when(plus, F.col("_e")).otherwise(F.col("_s") + 1).alias("end0"))


def method_blocks(regions: DataFrame, units: DataFrame) -> DataFrame:
    """Exon-wise BED rows of mature (1), pro (2) and pro + mature or mature alone (3) of each peptide.

    (method, chrom, start0, end0, name, strand); name is peptide|TAG|precursor|exN, N by ascending position.
    """
    one = lambda m, tag, a, b: F.struct(F.lit(m).alias("method"), F.lit(tag).alias("tag"), a.alias("aa_start"), b.alias("aa_end"))
    ms, me, ps, pe = (F.col(c) for c in ("mature_start", "mature_end", "pro_start", "pro_end"))
    has = (ps > 0) & (pe >= ps)
    spans = F.array_compact(F.array(one(1, "AMP", ms, me), F.when(has, one(2, "PRO", ps, pe)), one(3, "PRO_AMP", F.when(has, ps).otherwise(ms), me)))
    rows = regions.select("peptide_id", F.col("precursor_id").alias("protein"), F.explode(spans).alias("s")).select("peptide_id", "protein", "s.*")
    pieces = aa_intervals_to_genome(rows, units)
    by = Window.partitionBy("peptide_id", "method", "protein").orderBy("start0", "end0")
    name = F.concat_ws("|", "peptide_id", "tag", "protein", F.concat(F.lit("ex"), F.row_number().over(by)))
    return pieces.select("method", "chrom", "start0", "end0", name.alias("name"), "strand", "peptide_id")


def locus_envelope(regions: DataFrame, models: DataFrame, cds: DataFrame) -> DataFrame:
    """First to last CDS base of each peptide's gene model, introns included: (peptide_id, chrom, start0, end0, name, strand)."""
    span = cds.groupBy("mrna_id").agg((F.min("start") - 1).alias("start0"), F.max("end").alias("end0"))
    loci = models.join(span, "mrna_id").withColumnRenamed("protein", "precursor_id")
    name = F.concat_ws("|", "peptide_id", F.lit("LOCUS"), "precursor_id")
    return regions.select("peptide_id", "precursor_id").join(loci, "precursor_id").select("peptide_id", "chrom", "start0", "end0", name.alias("name"), "strand")


def fetch_sequence(intervals: DataFrame, chunks: DataFrame, key: str, chunk_len: int) -> DataFrame:
    """Strand-aware sequence of BED-like intervals (key, chrom, start0, end0, strand) from genome chunks of ``chunk_len``.

    Intervals are exploded over the chunks they touch and joined on (chrom, chunk_id); pieces are put together in
    order. A start below 0 is cut off; where the genome ends the sequence ends. Intervals without any base give no row.
    """
    start, end = F.greatest(F.col("start0"), F.lit(0)), F.col("end0")
    ok = intervals.where(end > start).withColumn("_s", start)
    ids = F.sequence(F.floor(F.col("_s") / chunk_len), F.floor((F.col("end0") - 1) / chunk_len))
    touched = ok.select(key, "chrom", "_s", "end0", "strand", F.explode(ids).alias("chunk_id"))
    rows = touched.join(chunks, ["chrom", "chunk_id"])
    lo = F.greatest(F.col("_s") - F.col("chunk_id") * chunk_len, F.lit(0))
    hi = F.least(F.col("end0") - F.col("chunk_id") * chunk_len, F.lit(chunk_len))
    piece = F.substring(F.col("seq"), (lo + 1).cast("int"), (hi - lo).cast("int"))
    parts = rows.groupBy(key, "strand").agg(F.array_sort(F.collect_list(F.struct("chunk_id", piece.alias("p")))).alias("a"))
    seq = F.array_join(F.transform("a", lambda x: x["p"]), "")
    return parts.select(key, oriented(seq, F.col("strand")).alias("seq")).where("seq <> ''")


def oriented(seq: Column, strand: Column) -> Column:
    return F.when(strand == "-", revcomp(seq)).otherwise(seq)
