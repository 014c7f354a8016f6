"""Whole runs from files to files: peptides to genomic DNA, cleavage sites, the regulatory layer, and the predictor.

Each function reads its inputs by Spark, writes tables in the folder ``out`` and returns nothing. Steps that several
outputs need are written once as Parquet and read again, and are removed when the run ends.

``paths`` names the inputs: peptides, proteome (FASTA), signal, alignment, annotation (GFF-like), genome (FASTA), and optionally rules,
motifs and tf_motifs (tables of families, cleavage motifs and binding motifs instead of the fixed ones).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import FAMILY_RULES, PROTEASE_MOTIFS, TF_MOTIFS
from ..operators import boundaries, cleavage, dataset, embed, genemodel, homology, loci, ml, regions, regulatory, report
from ..operators.components import materialize, step
from ..sources import readers, writers

CHUNK = 1 << 16
METHODS = report.METHODS | {5: "method5_locus"}


class Run:
    """The steps that the runs share, each made and written once, when it is first asked for."""

    def __init__(self, spark: SparkSession, paths: dict[str, str]):
        self.spark, self.paths, self._made = spark, paths, {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = materialize(make())
        return self._made[name]

    @property
    def rules(self) -> list[tuple[str, str, str]]:
        return readers.family_rules(self.spark, self.paths["rules"]) if "rules" in self.paths else FAMILY_RULES

    @property
    def peptides(self) -> DataFrame:
        return self._once("peptides", lambda: homology.clean_peptides(readers.read_fasta(self.spark, self.paths["peptides"]).select("id", "seq", "ord")))

    @property
    def best(self) -> DataFrame:
        proteome = readers.read_fasta(self.spark, self.paths["proteome"], "last").select("id", "seq", "title")
        return self._once("best", lambda: homology.best_precursor(homology.homology_hits(self.peptides, proteome)))

    @property
    def map(self) -> DataFrame:
        return self.best.select("peptide_id", "precursor_id", "gene_symbol", "stitle")

    @property
    def precursors(self) -> DataFrame:
        return self._once("precursors", lambda: homology.unique_precursors(self.best))

    @property
    def signal(self) -> DataFrame:
        return self._once("signal", lambda: readers.read_signal(self.spark, self.paths["signal"]))

    @property
    def regions(self) -> DataFrame:
        return self._once("regions", lambda: regions.define_regions(self.map, self.precursors, self.peptides, self.signal))

    @property
    def cds(self) -> DataFrame:
        return self._once("cds", lambda: readers.read_gff(self.spark, self.paths["alignment"])[1])

    @property
    def models(self) -> DataFrame:
        return self._once("models", lambda: genemodel.best_gene_model(readers.read_gff(self.spark, self.paths["alignment"])[0], self.cds))

    @property
    def units(self) -> DataFrame:
        return self._once("units", lambda: genemodel.coding_units(self.models, self.cds))

    @property
    def envelopes(self) -> DataFrame:
        return self._once("envelopes", lambda: genemodel.locus_envelope(self.regions, self.models, self.cds))

    @property
    def chunks(self) -> DataFrame:
        return self._once("chunks", lambda: readers.read_genome(self.spark, self.paths["genome"], CHUNK))

    @property
    def genes(self) -> DataFrame:
        return self._once("genes", lambda: readers.read_gene_index(self.spark, self.paths["annotation"]))

    @property
    def loci(self) -> DataFrame:
        return self._once("loci", lambda: loci.enzyme_loci(loci.enzyme_rules(self.map, self.rules), self.genes))

    @property
    def sites(self) -> DataFrame:
        motifs = readers.cleavage_motifs(self.spark, self.paths["motifs"]) if "motifs" in self.paths else PROTEASE_MOTIFS
        return self._once("sites", lambda: cleavage.scan_cleavage(self.precursors, motifs))

    @property
    def windows(self) -> DataFrame:
        return self._once("windows", lambda: cleavage.junction_windows(self.precursors, self.regions))

    @property
    def pwm(self) -> DataFrame:
        return self._once("pwm", lambda: cleavage.build_pwm(self.windows, cleavage.background(self.precursors)))

    def cut_model(self):
        """(model or None, metrics), fitted once."""
        if "cut_model" not in self._made:
            pos = self.windows.select(F.concat_ws("|", "peptide_id", "junction").alias("id"), "window")
            neg = cleavage.negative_windows(self.precursors, self.regions).select(F.concat_ws("|", "precursor_id", "bond").alias("id"), "window")
            self._made["cut_model"] = ml.cut_model(pos, materialize(neg), pwm=self.pwm)
        return self._made["cut_model"]

    @property
    def scored(self) -> DataFrame:
        """Sites by the model, or by the matrix where there is too little for a model."""
        model, _ = self.cut_model()
        return self._once("scored", lambda: cleavage.score_sites(self.sites, self.pwm) if model is None else cleavage.score_sites_model(self.sites, model))


def map_features(spark: SparkSession, paths: dict[str, str], out: str) -> None:
    """Peptides to the DNA of their features: homology/peptide_to_precursor and precursors.fa, regions/regions_aa, methods/<name>
    as BED and FASTA, methods/method4_enzyme as a table too, and the report tables."""
    with step(spark):
        own = Run(spark, paths)
        writers.write_table(own.best.drop("full_sseq", "ord"), f"{out}/homology/peptide_to_precursor", ["peptide_id"])
        writers.write_fasta(own.precursors, f"{out}/homology/precursors.fa")
        writers.write_table(own.regions, f"{out}/regions/regions_aa", ["peptide_id"])
        blocks = materialize(genemodel.method_blocks(own.regions, own.units))
        for n, name in METHODS.items():
            bed = own.envelopes if n == 5 else blocks.where(F.col("method") == n)
            writers.write_bed(bed, f"{out}/methods/{name}.bed")
            writers.write_fasta(genemodel.fetch_sequence(bed, own.chunks, "name", CHUNK), f"{out}/methods/{name}.fa", "name", "seq", None)
        writers.write_table(own.loci, f"{out}/methods/method4_enzyme", ["role", "gene"])
        writers.write_fasta(loci.enzyme_sequences(own.loci, own.chunks, CHUNK), f"{out}/methods/method4_enzyme.fa", "name", "seq")
        writers.write_table(report.pipeline_summary(own.map, own.regions, blocks, own.envelopes, own.loci), f"{out}/report/pipeline_summary", ["stage"])
        writers.write_table(report.feature_map(own.regions, blocks, own.envelopes), f"{out}/report/precursor_feature_map", ["peptide_id"])


def cleavage_sites(spark: SparkSession, paths: dict[str, str], out: str) -> None:
    """Cut sites of the precursors, windows at the junctions and their motifs, the learned matrix and model with metrics, rescored
    sites, predicted regions and their accuracy, a genome track; all below cleavage/."""
    with step(spark):
        own = Run(spark, paths)
        writers.write_table(own.sites.drop("window8", "score"), f"{out}/cleavage/candidate_sites", ["precursor_id", "bond", "enzyme"])
        for junction in ("pro_mature", "signal_pro"):
            rows = own.windows.where(F.col("junction") == junction).select(F.concat_ws("|", "peptide_id", "precursor_id").alias("id"), "window")
            writers.write_fasta(rows, f"{out}/cleavage/denovo/{junction}.fa", "id", "window", None)
        writers.write_table(cleavage.motif_pfm(own.windows), f"{out}/cleavage/motif_report", ["junction", "pos", "rank"])
        writers.save_pwm(own.pwm, f"{out}/cleavage/pwm")
        model, metrics = own.cut_model()
        writers.write_table(metrics, f"{out}/cleavage/metrics")
        if model is not None:
            writers.save_model(model, [f"f{i}" for i in range(165)], f"{out}/cleavage/model")
        writers.write_table(own.scored.drop("window8"), f"{out}/cleavage/candidate_sites_scored", ["precursor_id", "bond", "enzyme"])
        predicted = materialize(boundaries.predict_boundaries(own.precursors, own.scored, own.signal))
        writers.write_table(predicted, f"{out}/cleavage/predicted_regions", ["precursor_id"])
        truth = own.regions.select("precursor_id", "mature_start", F.col("peptide_id").alias("ord"))
        rows, summary = boundaries.boundary_accuracy(predicted, truth, own.scored)
        writers.write_table(rows, f"{out}/cleavage/boundary_accuracy", ["precursor_id"])
        writers.write_table(summary, f"{out}/cleavage/boundary_summary")
        writers.write_bed(boundaries.cutsites_bed(own.scored, own.units), f"{out}/cleavage/cutsites.bed")


def regulatory_layer(spark: SparkSession, paths: dict[str, str], out: str, up: int = 1000, down: int = 200, max_mismatch: int = 1) -> None:
    """Promoters of the peptides' genes and of the genes that process them, binding motifs there, and what each pair of genes shares;
    all below regulatory/: promoters.fa, pairs, tfbs_hits, tfbs.bed, shared_signatures."""
    motifs = readers.tf_motifs(spark, paths["tf_motifs"]) if "tf_motifs" in paths else TF_MOTIFS
    with step(spark):
        own = Run(spark, paths)
        pairs = materialize(regulatory.coreg_pairs(own.map, own.loci))
        promoters = materialize(regulatory.promoter_sequences(regulatory.wanted_genes(own.map, own.loci), own.genes, own.chunks, CHUNK, up, down))
        hits = materialize(regulatory.tfbs_hits(promoters, motifs, max_mismatch))
        writers.write_table(pairs, f"{out}/regulatory/pairs", ["amp_gene", "partner_gene", "partner_role"])
        header = F.concat_ws("|", "gene", "role", "chrom", "p_start", "p_end", "strand")
        writers.write_fasta(promoters.select(header.alias("id"), "seq"), f"{out}/regulatory/promoters.fa", width=None)
        writers.write_table(hits, f"{out}/regulatory/tfbs_hits", ["gene", "tf", "promoter_offset", "motif_orient"])
        writers.write_bed(regulatory.tfbs_bed(hits), f"{out}/regulatory/tfbs.bed")
        writers.write_table(regulatory.shared_signatures(pairs, regulatory.tf_sets(hits)), f"{out}/regulatory/shared_signatures", ["amp_gene", "partner_gene", "partner_role"])


def _locus_context(own: Run, window: int) -> DataFrame:
    """The locus and neighbourhood fields of each peptide."""
    named = lambda role: sorted({gene for _, r, gene in own.rules if r == role and gene != "."})
    symbols = [r[0] for r in own.map.where("gene_symbol not in ('', '.')").select("gene_symbol").distinct().limit(10_001).collect()]
    if len(symbols) > 10_000:
        raise ValueError("a run has at most 10000 gene symbols of its own")
    near = loci.neighbourhood(own.envelopes, own.genes, named("enzyme"), named("transporter"), symbols, window)
    return loci.locus_features(own.envelopes, own.regions, own.models, own.cds, own.chunks, CHUNK).join(near, "peptide_id", "left")


def predictor(
    spark: SparkSession, paths: dict[str, str], out: str, cv: int = 5, trees: int = 300, kind: str = "rf", threshold: float = 0.5,
    decoys: int = 1, dims: tuple[int, int] = (32, 32), window: int = 100_000,
) -> None:
    """Positives from the mapped regions with the scores of their cut sites and their loci, decoys and other sequences; k-mer embeddings of
    all mature sequences and of the positives' loci; ablation over M1 to M6, models, and scores of new peptides.

    ``paths`` also names negatives and queries (FASTA). Written: dataset (with all fields and embeddings), model/ablation, model/metrics,
    model/model_m1 and model_full, predictions.
    """
    with step(spark):
        own = Run(spark, paths)
        positives = dataset.assemble_positives(own.peptides, own.regions, own.precursors, dataset.cut_context(own.scored), _locus_context(own, window))
        other = readers.read_fasta(spark, paths["negatives"]).select("id", "seq")
        rows = materialize(dataset.make_dataset(materialize(positives), other, decoys))
        proteins = embed.kmer_vectors(rows.select("id", "mature_seq"), "mature_seq", dims[0], 2).select("id", "vec", F.lit(0).alias("ord"))
        dna = genemodel.fetch_sequence(own.envelopes, own.chunks, "peptide_id", CHUNK).withColumnRenamed("peptide_id", "id")
        dna = embed.kmer_vectors(dna, "seq", dims[1], 3).select("id", "vec", F.lit(0).alias("ord"))
        full = materialize(embed.merge_embeddings(rows, [(proteins, "m6p_", dims[0]), (dna, "m6g_", dims[1])]))
        writers.write_table(full, f"{out}/dataset", ["id"])
        features = materialize(dataset.method_features(full))
        writers.write_table(ml.ablation(features, cv, 0, kind, trees), f"{out}/model/ablation", ["level"])
        small, large, metrics = ml.train_models(features, cv, 0, kind, trees)
        writers.write_table(metrics, f"{out}/model/metrics")
        columns = [c for c in features.columns if c not in ("id", "label")]
        for model, level, name in ((small, "M1", "model_m1"), (large, "M6", "model_full")):
            if model is not None:
                writers.save_model(model, dataset.cumulative_columns(columns, level), f"{out}/model/{name}")
        if small is not None:
            model, _ = readers.load_model(spark, f"{out}/model/model_m1")
            scores = ml.predict_peptides(readers.read_fasta(spark, paths["queries"]).select("id", "seq"), model, threshold)
            writers.write_table(scores, f"{out}/predictions", ["id"])
