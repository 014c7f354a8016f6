"""Promoters of genes, transcription-factor motifs in them, and motifs that co-regulated genes share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import IUPAC, TF_MOTIFS
from .genemodel import fetch_sequence


def promoter_windows(genes: DataFrame, up: int = 1000, down: int = 200) -> DataFrame:
    """Genes with p_start and p_end (1-based, inclusive): ``up`` bases before and ``down`` behind the start of
    transcription on the gene's strand; the start is not below 1."""
    minus = F.col("strand") == "-"
    start = F.when(minus, F.col("end") - down).otherwise(F.col("start") - up)
    end = F.when(minus, F.col("end") + up).otherwise(F.col("start") + down)
    return genes.withColumn("p_start", F.greatest(start, F.lit(1))).withColumn("p_end", end)


def coreg_pairs(map_: DataFrame, loci: DataFrame) -> DataFrame:
    """(amp_gene, partner_gene, partner_role): a locus with each mapped gene symbol among its families."""
    amps = map_.select(F.col("gene_symbol").alias("amp_gene")).where("amp_gene is not null and amp_gene not in ('', '.')").distinct()
    families = F.transform(F.split("requested_by_families", ","), F.trim)
    rows = loci.select(F.explode(families).alias("amp_gene"), F.col("gene").alias("partner_gene"), F.col("role").alias("partner_role"))
    return rows.join(amps, "amp_gene", "left_semi").distinct()


def wanted_genes(map_: DataFrame, loci: DataFrame) -> DataFrame:
    """(gene, role): mapped genes with role ``amp``, and partner genes with their role (of several, the greatest)."""
    amps = map_.select(F.col("gene_symbol").alias("gene"), F.lit("amp").alias("role"), F.lit(1).alias("own"))
    amps = amps.where("gene is not null and gene not in ('', '.')")
    both = amps.unionByName(loci.where("gene <> '.'").select("gene", "role", F.lit(0).alias("own")))
    return both.groupBy("gene").agg(F.max_by("role", F.struct("own", "role")).alias("role"))


def promoter_sequences(wanted: DataFrame, genes: DataFrame, chunks: DataFrame, chunk_len: int, up: int = 1000, down: int = 200) -> DataFrame:
    """(gene, role, chrom, p_start, p_end, strand, seq): promoter DNA on the gene's strand, of genes in the index.

    p_end is cut off at the end of the chromosome, so that places in the sequence map back right on both strands.
    """
    ends = chunks.groupBy("chrom").agg(F.max(F.col("chunk_id") * chunk_len + F.length("seq")).alias("_len"))
    rows = promoter_windows(wanted.join(genes, wanted["gene"] == genes["symbol"]).join(ends, "chrom"), up, down)
    rows = rows.withColumn("p_end", F.least("p_end", "_len")).select("gene", "role", "chrom", "p_start", "p_end", "strand")
    spans = rows.select("gene", "chrom", (F.col("p_start") - 1).alias("start0"), F.col("p_end").alias("end0"), "strand")
    return rows.join(fetch_sequence(spans, chunks, "gene", chunk_len), "gene")


_BASES = {"A": 1, "C": 2, "G": 4, "T": 8}


def motif_masks(consensus: str) -> np.ndarray:
    """A bit mask of allowed bases for each place; an unknown code allows all four."""
    return np.array([sum(_BASES[b] for b in IUPAC.get(c, "ACGT")) for c in consensus.upper()], dtype=np.uint8)


def reverse_masks(masks: np.ndarray) -> np.ndarray:
    """The masks of the reverse complement."""
    swap = {1: 8, 2: 4, 4: 2, 8: 1}
    return np.array([sum(swap[b] for b in swap if m & b) for m in masks[::-1]], dtype=np.uint8)


def tfbs_hits(promoters: DataFrame, motifs: list[tuple[str, str]] = TF_MOTIFS, max_mismatch: int = 1) -> DataFrame:
    """Every place of both orientations of each motif with at most ``max_mismatch`` mismatches, overlapping ones too.

    (gene, role, tf, motif_orient, promoter_offset, chrom, start0, end0, matched_seq). Bases are four-bit masks, so any
    other letter of the sequence, N included, mismatches everything. The scan is one numpy pass a motif over a batch.
    """
    code = np.zeros(256, dtype=np.uint8)
    for b, bit in _BASES.items():
        code[ord(b)] = bit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [(tf, o, m) for tf, c in motifs for o, m in (("+", motif_masks(c)), ("-", reverse_masks(motif_masks(c))))]
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in ("gene", "role", "chrom", "p_start", "p_end", "strand", "seq")}
            out: list[list] = [[] for _ in range(9)]
            for gene, role, chrom, ps, pe, strand, seq in zip(*cols.values(), strict=True):
                seq = seq.upper()
                text = code[np.frombuffer(seq.encode("latin-1", "replace"), dtype=np.uint8)]
                for tf, orient, masks in sets:
                    n, w = len(text), len(masks)
                    if n < w:
                        continue
                    wrong = np.zeros(n - w + 1, dtype=np.int16)
                    for j, m in enumerate(masks):
                        wrong += (text[j : n - w + 1 + j] & m) == 0
                    for i in np.flatnonzero(wrong <= max_mismatch).tolist():
                        s0 = ps + i - 1 if strand != "-" else pe - i - w
                        for column, value in zip(out, (gene, role, tf, orient, i, chrom, s0, s0 + w, seq[i : i + w]), strict=True):
                            column.append(value)
            kinds = [pa.string()] * 4 + [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    names = ["gene", "role", "tf", "motif_orient", "promoter_offset", "chrom", "start0", "end0", "matched_seq"]
    schema = "gene string, role string, tf string, motif_orient string, promoter_offset int, chrom string, start0 long, end0 long, matched_seq string"
    return promoters.select("gene", "role", "chrom", "p_start", "p_end", "strand", "seq").mapInArrow(run, schema)


def tfbs_bed(hits: DataFrame) -> DataFrame:
    """BED6 rows of motif hits: name is factor|gene|role."""
    name = F.concat_ws("|", "tf", "gene", "role")
    return hits.select("chrom", "start0", "end0", name.alias("name"), F.lit(".").alias("score"), F.lit(".").alias("strand"))


def tf_sets(hits: DataFrame) -> DataFrame:
    """(gene, tfs): the factors with a hit, sorted."""
    return hits.groupBy("gene").agg(F.array_sort(F.collect_set("tf")).alias("tfs"))


def shared_signatures(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Shared and one-sided factors of each pair, joined by commas, or "."."""
    none = F.array().cast("array<string>")
    a = sets.select(F.col("gene").alias("amp_gene"), F.col("tfs").alias("_a"))
    p = sets.select(F.col("gene").alias("partner_gene"), F.col("tfs").alias("_p"))
    rows = pairs.select("amp_gene", "partner_gene", "partner_role").join(a, "amp_gene", "left").join(p, "partner_gene", "left")
    rows = rows.withColumn("_a", F.coalesce("_a", none)).withColumn("_p", F.coalesce("_p", none))
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(F.array_sort(c), ",")).otherwise(".")
    both = F.array_intersect("_a", "_p")
    return rows.select(
        "amp_gene", "partner_gene", "partner_role", joined(both).alias("shared_tfs"), F.size(both).alias("n_shared"),
        joined(F.array_except("_a", "_p")).alias("amp_only_tfs"), joined(F.array_except("_p", "_a")).alias("partner_only_tfs"),
    )
