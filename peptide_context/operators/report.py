"""Counts of what each step of the gene-context run produced."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of the methods in the outputs.
METHODS = {1: "method1_amp", 2: "method2_propeptide", 3: "method3_pro_plus_amp"}


def pipeline_summary(map_: DataFrame, regions: DataFrame, blocks: DataFrame, envelopes: DataFrame, loci: DataFrame) -> DataFrame:
    """(stage, count): mapped peptides, regions, records of each method."""
    named = [("peptides_mapped_to_precursor", map_), ("regions_defined", regions)]
    named += [(f"{name}_records", blocks.where(F.col("method") == m)) for m, name in METHODS.items()]
    named += [("method5_locus_records", envelopes), ("method4_enzyme_records", loci.where("status = 'ok'"))]
    return reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("stage"), F.count("*").alias("count")) for n, df in named])


def feature_map(regions: DataFrame, blocks: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Region rows with flags for the methods in which the peptide has a record."""
    seen = blocks.select("peptide_id", "method").union(envelopes.select("peptide_id", F.lit(5)))
    flags = seen.groupBy("peptide_id").agg(*[F.max(F.when(F.col("method") == m, 1).otherwise(0)).alias(f"has_m{m}") for m in (1, 2, 3, 5)])
    cols = ["peptide_id", "precursor_id", "gene_symbol", "precursor_len", "signal_end", "mature_start", "mature_end", "pro_start", "pro_end"]
    return regions.select(*cols).join(flags, "peptide_id", "left").select(*cols, *[F.coalesce(f"has_m{m}", F.lit(0)).alias(f"has_m{m}") for m in (1, 2, 3, 5)])
