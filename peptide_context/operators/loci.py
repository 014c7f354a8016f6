"""Loci of the enzymes and transporters that process a precursor, and features of loci."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import FAMILY_RULES
from ..functions.sequences import count_of
from .genemodel import fetch_sequence


def enzyme_rules(map_: DataFrame, rules: list[tuple[str, str, str]] = FAMILY_RULES) -> DataFrame:
    """(role, gene, families) that the rows of map_(gene_symbol, stitle) ask for.

    A rule's pattern is searched, case-insensitively, in symbol and title; rules with the pattern ``.*`` apply only to
    rows that no other rule matches. Each pattern is a literal, compiled once; rows are exploded over their matches
    without a join.
    """
    symbol = F.when(F.coalesce("gene_symbol", F.lit("")) == "", ".").otherwise(F.col("gene_symbol"))
    hay = F.concat(symbol, F.lit(" "), F.coalesce("stitle", F.lit("")))
    ask = lambda role, gene: F.struct(F.lit(role).alias("role"), F.lit(gene).alias("gene"))
    own = [F.when(F.regexp_like(hay, F.lit(f"(?i){p}")), ask(r, g)) for p, r, g in rules if p != ".*"]
    default = [ask(r, g) for p, r, g in rules if p == ".*"]
    matched = F.array_compact(F.array(*own))
    asked = F.when(F.size(matched) > 0, matched).otherwise(F.array(*default))
    rows = map_.select(symbol.alias("family"), F.explode(asked).alias("a")).select("family", "a.*").distinct()
    named = F.when(~F.col("family").isin("", "."), F.col("family"))
    return rows.groupBy("role", "gene").agg(F.array_sort(F.collect_set(named)).alias("families"))


def enzyme_loci(requested: DataFrame, genes: DataFrame) -> DataFrame:
    """Requested genes with their coordinates; status ``ok`` or ``not_found_in_gff``."""
    rows = requested.join(genes, requested["gene"] == genes["symbol"], "left")
    status = F.when(F.col("symbol").isNull() | (F.col("gene") == "."), "not_found_in_gff").otherwise("ok")
    return rows.select("role", "gene", "chrom", "start", "end", "strand", F.array_join("families", ",").alias("requested_by_families"), status.alias("status"))


def enzyme_sequences(loci: DataFrame, chunks: DataFrame, chunk_len: int) -> DataFrame:
    """(name, families, seq) of the loci found; name is gene|role|chrom:start-end|strand."""
    place = F.concat(F.col("chrom"), F.lit(":"), F.col("start"), F.lit("-"), F.col("end"))
    named = loci.where("status = 'ok'").withColumn("name", F.concat_ws("|", "gene", "role", place, "strand"))
    spans = named.select("name", "chrom", (F.col("start") - 1).alias("start0"), F.col("end").alias("end0"), "strand")
    return fetch_sequence(spans, chunks, "name", chunk_len).join(named.select("name", F.col("requested_by_families").alias("families")), "name")


def locus_features(envelopes: DataFrame, regions: DataFrame, models: DataFrame, cds: DataFrame, chunks: DataFrame, chunk_len: int) -> DataFrame:
    """(peptide_id, locus_len_bp, intron_frac, gc_locus, n_exons) of each peptide's locus envelope.

    intron_frac is the share of the envelope outside CDS; gc_locus the share of G and C in the fetched sequence, 0 where
    the genome has none of it.
    """
    coding = cds.groupBy("mrna_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("coding"), F.count("*").cast("int").alias("n_exons"))
    own = regions.select("peptide_id", F.col("precursor_id").alias("protein")).join(models.select("protein", "mrna_id"), "protein").join(coding, "mrna_id")
    seqs = fetch_sequence(envelopes, chunks, "peptide_id", chunk_len)
    rows = envelopes.join(own.select("peptide_id", "coding", "n_exons"), "peptide_id").join(seqs, "peptide_id", "left")
    length = F.col("end0") - F.col("start0")
    gc = F.coalesce(count_of(F.upper("seq"), "GC") / F.length("seq"), F.lit(0.0))
    return rows.select("peptide_id", length.alias("locus_len_bp"), (1 - F.col("coding") / length).alias("intron_frac"), gc.alias("gc_locus"), "n_exons")


LEAST_LEVEL, MOST_LEVEL = 12, 40  # nested bins of 2**12 to 2**40 bases


def _level(lo: Column, hi: Column) -> Column:
    """The level of the smallest nested bin that holds the places lo to hi."""
    apart = F.length(F.bin(lo.bitwiseXOR(hi)))  # bits from the highest in which they differ
    return F.greatest(F.when(lo == hi, 0).otherwise(apart), F.lit(LEAST_LEVEL)).cast("int")


def nested_bins(df: DataFrame, lo: Column, hi: Column, above: int | None) -> DataFrame:
    """``df`` with (level, bin) of the one bin that holds the places lo to hi (from 0, both included), or, with ``above``, a row for each
    bin that holds that bin, from ``above`` levels over it (0: itself too) to the top.

    Bins nest: two either share no place, or one holds the other. So spans that share a place stand in bins of which one
    holds the other, and a span gives as many rows as there are levels at most, however long it is.
    """
    low, high = F.greatest(lo, F.lit(0)).cast("long"), F.greatest(hi, lo, F.lit(0)).cast("long")
    level = _level(low, high)
    levels = F.array(level) if above is None else F.sequence(F.least(level + above, F.lit(MOST_LEVEL + 1)), F.lit(MOST_LEVEL + 1))
    rows = df.withColumn("_lo", low).withColumn("level", F.explode(levels)).where(F.col("level") <= MOST_LEVEL)
    return rows.withColumn("bin", F.expr("shiftright(_lo, level)")).drop("_lo")


def near_genes(loci: DataFrame, genes: DataFrame, window: int) -> DataFrame:
    """(peptide_id, start0, end0, symbol, gap): each gene (symbol, chrom, start, end) at most ``window`` bases from a locus
    (peptide_id, chrom, start0, end0), the gap 0 where they overlap; each pair once.

    Joined on nested bins: loci in their one bin with genes in all bins that hold theirs, and the other way round.
    """
    left = loci.select("peptide_id", "chrom", "start0", "end0")
    right = genes.select("symbol", "chrom", (F.col("start") - 1).alias("g0"), F.col("end").alias("g1"))
    wide = lambda above: nested_bins(left, F.col("start0") - window, F.col("end0") + window, above)
    own = lambda above: nested_bins(right, F.col("g0"), F.col("g1"), above)
    keys = ["chrom", "level", "bin"]
    met = wide(None).join(own(0), keys).unionByName(wide(1).join(own(None), keys))
    gap = F.greatest(F.col("g0") - F.col("end0"), F.col("start0") - F.col("g1"), F.lit(0))
    return met.withColumn("gap", gap).where(F.col("gap") <= window).select("peptide_id", "start0", "end0", "symbol", "gap")


def neighbourhood(loci: DataFrame, genes: DataFrame, enzymes: list[str], transporters: list[str], amps: list[str], window: int = 100_000) -> DataFrame:
    """Genes within ``window`` bases of each locus (peptide_id, chrom, start0, end0), by gap between the intervals.

    (peptide_id, enzyme_present, enzyme_dist_kb, transporter_present, gene_density, neighbor_amp_count): density is
    genes per kilobase of the widened locus; distances are 0 where intervals overlap and null without an enzyme.
    Loci and genes meet in nested bins (``near_genes``), so that neither long loci nor long genes are copied over many bins.
    """
    near = near_genes(loci, genes, window)
    is_in = lambda names: F.col("symbol").isin(*names)
    some = lambda c: F.max(F.when(c, 1).otherwise(0))
    per = near.groupBy("peptide_id").agg(
        some(is_in(enzymes)).alias("enzyme_present"), (F.min(F.when(is_in(enzymes), F.col("gap"))) / 1000.0).alias("enzyme_dist_kb"),
        some(is_in(transporters)).alias("transporter_present"), F.count("*").alias("_n"),
        F.sum(F.when(is_in(amps), 1).otherwise(0)).cast("int").alias("neighbor_amp_count"),
    )
    kb = (F.col("end0") - F.col("start0") + 2 * window) / 1000.0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return loci.select("peptide_id", "start0", "end0").join(per, "peptide_id", "left").select(
        "peptide_id", zero("enzyme_present").alias("enzyme_present"), "enzyme_dist_kb", zero("transporter_present").alias("transporter_present"),
        (zero("_n") / kb).alias("gene_density"), zero("neighbor_amp_count").alias("neighbor_amp_count"),
    )
