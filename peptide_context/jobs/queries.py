"""The registered queries: each applies an operator to its whole domain table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.constants import FAMILY_RULES
from ..operators import boundaries as B
from ..operators import cleavage as C
from ..operators import dataset as D
from ..operators import embed as E
from ..operators import genemodel as G
from ..operators import homology as H
from ..operators import loci as E1
from ..operators import ml as L
from ..operators import regions as R
from ..operators import regulatory as T
from ..operators import report as P
from ..operators.components import materialize, scratch
from ..operators.forest import score_forest
from ..sources import readers as IN
from ..sources import writers as W
from ..sources.readers import signal_ends
from . import adapters as A
from .saved import saved_forest

QUERIES = {}
PLACES = 6


def query(f):
    QUERIES[f"q_{f.__name__}"] = f
    return f


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at the sink to six places, so that other engines' sums compare equal; -0 becomes 0."""
    return df.select(*[(F.round(c, PLACES) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# domain steps that several queries share


def _signal(s, d):
    return signal_ends(A.signal_rows(s, d))


def _regions(s, d):
    return R.define_regions(A.mapping(s, d), A.proteins(s, d), A.peptides(s, d), _signal(s, d))


def _sites(s, d):
    return C.scan_cleavage(A.proteins(s, d))


def _kept_sites(s, d):
    """Sites that several steps of a query use: scanned once, and kept."""
    return materialize(_sites(s, d))


def _windows(s, d):
    return C.junction_windows(A.proteins(s, d), _regions(s, d))


def _pwm(s, d):
    return C.build_pwm(_windows(s, d), C.background(A.proteins(s, d)))


def _scored(s, d):
    return C.score_sites(_sites(s, d), _pwm(s, d))


def _models(s, d):
    return G.best_gene_model(A.mrna(s, d), A.cds(s, d))


def _units(s, d):
    return G.coding_units(_models(s, d), A.cds(s, d))


def _envelopes(s, d):
    """Every reading of what this gives scans all line items twice, and all texts twice; see to it that it is read once."""
    return G.locus_envelope(_regions(s, d), _models(s, d), A.cds(s, d))


def _blocks(s, d):
    return G.method_blocks(_regions(s, d), _units(s, d))


def _loci(s, d):
    return E1.enzyme_loci(E1.enzyme_rules(A.mapping(s, d)), A.gene_index(s, d))


def _all_promoters(s, d):
    """Promoters of every gene of the index."""
    every = A.gene_index(s, d).select(F.col("symbol").alias("gene"), F.lit("gene").alias("role"))
    return T.promoter_sequences(every, A.gene_index(s, d), A.genome(s, d), A.CHUNK)


def _positives(s, d):
    regions, models, proteins = materialize(_regions(s, d)), materialize(_models(s, d)), materialize(A.proteins(s, d))
    envelopes = materialize(G.locus_envelope(regions, models, A.cds(s, d)))
    locus = E1.locus_features(envelopes, regions, models, A.cds(s, d), A.genome(s, d), A.CHUNK)
    pwm = C.build_pwm(C.junction_windows(proteins, regions), C.background(proteins))
    cuts = D.cut_context(C.score_sites(C.scan_cleavage(proteins), pwm))
    return D.assemble_positives(A.peptides(s, d), regions, proteins, cuts, locus)


def _labelled(s, d):
    """(id, label, features): labelled documents as mature and precursor sequences, whole, as q_predict_peptides scores
    them; pro regions where define_regions finds one; vectors as M6."""
    labels = A.table(s, d, "labels").select(F.col("doc_id").alias("n"), F.col("quality").alias("label"))
    rows = A.proteins(s, d).join(labels, "n").where("label is not null")
    vec = A.table(s, d, "embeddings").select(F.concat(F.lit("P"), "vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("vec_id").alias("ord"))
    pro = _regions(s, d).where("pro_start > 0").groupBy(F.col("precursor_id").alias("id")).agg(F.min_by(F.struct("pro_start", "pro_end"), "peptide_id").alias("pro"))
    rows = rows.join(pro, "id", "left")
    pro_seq = F.coalesce(F.substring("seq", F.col("pro.pro_start"), F.col("pro.pro_end") - F.col("pro.pro_start") + 1), F.lit(""))
    rows = rows.select("id", "label", F.col("seq").alias("mature_seq"), pro_seq.alias("pro_seq"), F.col("seq").alias("precursor_seq"))
    return D.method_features(E.merge_embeddings(rows, [(vec, "m6p_", 64)]))


# homology and regions


@query
def clean_peptides(s: SparkSession, d: str) -> DataFrame:
    return H.clean_peptides(A.peptides(s, d))


@query
def cluster_peptides(s, d):
    return H.cluster_peptides(A.peptides(s, d))


@query
def homology_hits(s, d):
    hits = H.homology_hits(A.peptides(s, d), A.proteins(s, d))
    return rounded(hits.drop("bitscore", "evalue", "stitle", "full_sseq", "ord"))


@query
def homology_precursors(s, d):
    """Search and best hit in one: what the search finds goes to the choice of precursors."""
    hits = H.homology_hits(A.peptides(s, d), A.proteins(s, d))
    return rounded(H.best_precursor(hits).drop("full_sseq", "ord"))


@query
def best_precursor(s, d):
    return rounded(H.best_precursor(A.hits(s, d)).drop("full_sseq", "ord"))


@query
def gene_symbol(s, d):
    return A.hits(s, d).select("qseqid", "sseqid", "ord", S.gene_symbol(F.col("stitle")).alias("gene_symbol"))


@query
def unique_precursors(s, d):
    return H.unique_precursors(H.best_precursor(A.hits(s, d)))


@query
def find_mature(s, d):
    prec = A.proteins(s, d).select("n", F.col("seq").alias("precursor"))
    pairs = prec.join(A.peptides(s, d).select(F.col("ord").alias("n"), F.col("seq").alias("peptide")), "n")
    return R.find_mature(pairs).select("n", "mature_start", "mature_end")


@query
def define_regions(s, d):
    return _regions(s, d).drop("dibasic_hint")


@query
def dibasic_hint(s, d):
    return _regions(s, d).select("peptide_id", "mature_start", "dibasic_hint")


# gene models


@query
def best_gene_model(s, d):
    return _models(s, d)


@query
def coding_units(s, d):
    return _units(s, d)


@query
def aa_interval_to_genome(s, d):
    spans = _regions(s, d).select("peptide_id", F.col("precursor_id").alias("protein"), F.col("mature_start").alias("aa_start"), F.col("mature_end").alias("aa_end"))
    return G.aa_intervals_to_genome(spans, _units(s, d))


@query
def bond_to_genome(s, d):
    bonds = _regions(s, d).select("peptide_id", F.col("precursor_id").alias("protein"), F.col("mature_end").alias("bond"))
    return G.bonds_to_genome(bonds, _units(s, d), ["peptide_id", "protein", "bond"])


@query
def method_blocks(s, d):
    return _blocks(s, d).drop("peptide_id")


@query
def locus_envelope(s, d):
    return _envelopes(s, d)


@query
def fetch_sequence(s, d):
    return G.fetch_sequence(_envelopes(s, d), A.genome(s, d), "peptide_id", A.CHUNK)


@query
def revcomp(s, d):
    return A.genome(s, d).select("chrom", "chunk_id", S.revcomp(F.col("seq")).alias("seq"))


# enzyme loci


@query
def enzyme_rules(s, d):
    return E1.enzyme_rules(A.mapping(s, d)).select("role", "gene", F.array_join("families", ",").alias("families"))


@query
def enzyme_loci(s, d):
    return _loci(s, d)


@query
def enzyme_sequences(s, d):
    return E1.enzyme_sequences(_loci(s, d), A.genome(s, d), A.CHUNK)


# cleavage


@query
def scan_cleavage(s, d):
    return _sites(s, d).select("precursor_id", "enzyme", "role", "bond", "p1_residue", "score")


@query
def site_window(s, d):
    return _sites(s, d).select("precursor_id", "enzyme", "bond", "window")


@query
def junction_windows(s, d):
    return _windows(s, d)


@query
def motif_pfm(s, d):
    return rounded(C.motif_pfm(_windows(s, d)))


@query
def background(s, d):
    return rounded(C.background(A.proteins(s, d)))


@query
def pwm(s, d):
    return rounded(_pwm(s, d))


@query
def pwm_score(s, d):
    return rounded(C.pwm_scored(_windows(s, d), _pwm(s, d), "window").select("peptide_id", "junction", "score"))


@query
def negative_windows(s, d):
    return C.negative_windows(A.proteins(s, d), _regions(s, d))


@query
def window_features(s, d):
    rows = _windows(s, d).select("peptide_id", "junction", C.window_features(F.col("window")).alias("f"))
    ones = F.array_join(F.transform(F.slice("f", 1, 160), lambda x: x.cast("int").cast("string")), "")
    tail = [F.col("f")[160 + i].alias(n) for i, n in enumerate(("cation", "hydropathy", "p1_basic", "p1_small", "p1p_aromatic"))]
    return rounded(rows.select("peptide_id", "junction", ones.alias("onehot"), *tail))


@query
def auc(s, d):
    pos, neg = _bonds(s, d)
    both = pos.select("window", F.lit(1).alias("label")).union(neg.select("window", F.lit(0)))
    # scores to six places: sums of other engines then tie in the same rows
    scored = C.pwm_scored(both, _matrix(s, d, pos), "window").select("label", F.round("score", PLACES).alias("score"))
    return rounded(L.auc(materialize(scored)))


def _bonds(s, d):
    """(windows at bonds that are cut, windows at others), each (id, window)."""
    regions = materialize(_regions(s, d))
    pos = C.junction_windows(A.proteins(s, d), regions).select(F.concat_ws("|", "peptide_id", "junction").alias("id"), "window")
    neg = C.negative_windows(A.proteins(s, d), regions).select(F.concat_ws("|", "precursor_id", "bond").alias("id"), "window")
    return materialize(pos), materialize(neg)


def _matrix(s, d, windows):
    """The matrix of windows that are written already, written itself."""
    return materialize(C.build_pwm(windows, C.background(A.proteins(s, d))))


@query
def cut_model(s, d):
    pos, neg = _bonds(s, d)
    return L.cut_model(pos, neg, pwm=_matrix(s, d, pos))[1]


@query
def cut_model_optimum(s, d):
    """The fit of the cut model is settled: what it implies for every window feature is what the cut windows show."""
    return L.cut_model_optimum(*_bonds(s, d)).select("term", (F.round("moment", 4) + 0.0).alias("moment"))


@query
def score_sites_model(s, d):
    """Sites rescored by the cut model instead of the matrix."""
    model = L.fit_cut_model(*_bonds(s, d))
    return C.scan_scored_sites(A.proteins(s, d), model).select("precursor_id", "enzyme", "bond", "score")


@query
def score_sites(s, d):
    return rounded(_scored(s, d).select("precursor_id", "enzyme", "bond", "score"))


@query
def predict_mature_start(s, d):
    return rounded(B.predict_mature_start(A.proteins(s, d), _sites(s, d), _signal(s, d)).select("precursor_id", "signal_end", "mature_start", "sel_score"))


@query
def trim_cterm(s, d):
    sites = _kept_sites(s, d)
    starts = materialize(B.predict_mature_start(A.proteins(s, d), sites, _signal(s, d)))
    return B.trim_cterm(starts, sites).select("precursor_id", "mature_start", "mature_end", "mature_end_source")


@query
def predicted_regions(s, d):
    """The flagship: boundaries predicted for every protein from rescored cut sites."""
    found = B.predict_regions(A.proteins(s, d), _signal(s, d), _matrix(s, d, materialize(_windows(s, d))))
    return rounded(found.withColumn("sel_score", F.round("sel_score", 3)))


def _accuracy(s, d):
    sites = _kept_sites(s, d)
    pred = B.predict_boundaries(A.proteins(s, d), sites, _signal(s, d))
    truth = _regions(s, d).select("precursor_id", "mature_start", F.col("peptide_id").alias("ord"))
    return B.boundary_accuracy(pred, truth, sites)


@query
def boundary_accuracy(s, d):
    return _accuracy(s, d)[0]


@query
def boundary_summary(s, d):
    return rounded(_accuracy(s, d)[1])


@query
def cutsites_bed(s, d):
    return B.cutsites_bed(_sites(s, d), _units(s, d))


# regulation


@query
def promoter_windows(s, d):
    return T.promoter_windows(A.gene_index(s, d)).select("symbol", "chrom", "p_start", "p_end", "strand")


@query
def coreg_pairs(s, d):
    return T.coreg_pairs(A.mapping(s, d), _loci(s, d))


@query
def wanted_genes(s, d):
    return T.wanted_genes(A.mapping(s, d), _loci(s, d))


@query
def promoter_sequences(s, d):
    return T.promoter_sequences(T.wanted_genes(A.mapping(s, d), _loci(s, d)), A.gene_index(s, d), A.genome(s, d), A.CHUNK)


@query
def tfbs_hits(s, d):
    return T.tfbs_hits(_all_promoters(s, d)).drop("role")


@query
def tfbs_bed(s, d):
    return T.tfbs_bed(T.tfbs_hits(_all_promoters(s, d)))


@query
def tf_sets(s, d):
    return T.tf_sets(T.tfbs_hits(_all_promoters(s, d))).select("gene", F.array_join("tfs", ",").alias("tfs"))


@query
def shared_signatures(s, d):
    return T.shared_signatures(T.coreg_pairs(A.mapping(s, d), _loci(s, d)), T.tf_sets(T.tfbs_hits(_all_promoters(s, d))))


# sources and sinks: tables written in the formats of files, and read back


def _lines(df, *fields):
    text = F.concat_ws("\t", *[F.coalesce(F.col(f).cast("string"), F.lit("")) if isinstance(f, str) else f for f in fields])
    return df.select(text.alias("value"))


def _written(s, df):
    path = scratch(s)
    df.write.text(path)
    return path


@query
def read_fasta(s, d):
    path = scratch(s)
    W.write_fasta(A.proteins(s, d), path)
    return IN.read_fasta(s, path).select("id", "seq")


@query
def read_genome(s, d):
    """Chromosomes as FASTA lines, a line a chunk, each behind its header: written in order, a chromosome in no row."""
    path = scratch(s)
    W.write_genome(A.genome(s, d), path)
    return IN.read_genome(s, path, A.CHUNK)


@query
def read_promoters(s, d):
    path = scratch(s)
    name = F.concat_ws("|", "gene", "role", "chrom", "p_start", "p_end", "strand")
    W.write_fasta(_all_promoters(s, d).select(name.alias("id"), "seq"), path)
    return IN.read_promoters(s, path)


@query
def read_hits(s, d):
    one = F.lit("1")
    path = _written(s, _lines(A.hits(s, d), "qseqid", "sseqid", "pident", "length", "qlen", "slen", one, "length", one, "length", "evalue", "bitscore", "stitle", "full_sseq"))
    rows = IN.read_hits(s, path).select("qseqid", "sseqid", "pident", "length", "qlen", "slen", "evalue", "bitscore", "stitle", "full_sseq")
    return rounded(rows)


@query
def read_gff(s, d):
    dot, text = F.lit("."), lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    target = text("ID=", F.col("mrna_id"), ";Target=", F.col("protein"), " 1 9")
    mrna = _lines(A.mrna(s, d), "chrom", dot, F.lit("mRNA"), F.lit("1"), F.lit("9"), "score", "strand", dot, target)
    cds = _lines(A.cds(s, d), F.lit("c"), dot, F.lit("CDS"), "start", "end", dot, F.lit("+"), "phase", text("Parent=", F.col("mrna_id")))
    mrna, cds = IN.read_gff(s, _written(s, mrna.union(cds)))
    return rounded(mrna.drop("ord").join(cds, "mrna_id"))


@query
def read_gene_index(s, d):
    dot = F.lit(".")
    name = F.concat(F.lit("ID=g;Name="), F.col("symbol"))
    return IN.read_gene_index(s, _written(s, _lines(A.gene_index(s, d), "chrom", dot, F.lit("gene"), "start", "end", dot, "strand", dot, name)))


@query
def read_signal(s, d):
    return IN.read_signal(s, _written(s, _lines(A.signal_rows(s, d), "acc", F.lit("p"), "type", F.lit("1"), "end")))


@query
def read_rules(s, d):
    """Rules of a file, and what they ask for of the mapped peptides."""
    path = _written(s, s.createDataFrame([("\t".join(r),) for r in [("# pattern", "role", "gene"), *FAMILY_RULES]], "value string").coalesce(1))
    rules = IN.family_rules(s, path)
    return E1.enzyme_rules(A.mapping(s, d), rules).select("role", "gene", F.array_join("families", ",").alias("families"))


@query
def read_table(s, d):
    path, rows = scratch(s), _regions(s, d).drop("dibasic_hint")
    W.write_table(rows, path, ["peptide_id"])
    return IN.read_table(s, path, rows.schema)


@query
def read_bed(s, d):
    path = scratch(s)
    W.write_bed(_blocks(s, d), path)
    schema = "chrom string, start0 long, end0 long, name string, score string, strand string"
    return s.read.schema(schema).csv(path, sep="\t").drop("score")


@query
def load_pwm(s, d):
    path = scratch(s)
    W.save_pwm(_pwm(s, d), path)
    return rounded(IN.load_pwm(s, path))


# reports


@query
def pipeline_summary(s, d):
    return P.pipeline_summary(A.mapping(s, d), _regions(s, d), _blocks(s, d), _envelopes(s, d), _loci(s, d))


@query
def feature_map(s, d):
    return P.feature_map(_regions(s, d), _blocks(s, d), _envelopes(s, d))


# datasets, features, embeddings


@query
def cut_context(s, d):
    return rounded(D.cut_context(_scored(s, d)))


@query
def assemble_positives(s, d):
    return rounded(_positives(s, d))


@query
def shuffled_decoys(s, d):
    pos = A.peptides(s, d).select("id", F.col("seq").alias("mature_seq"))
    return D.shuffled_decoys(pos, 2)


@query
def make_dataset(s, d):
    pos = A.peptides(s, d).select("id", F.col("seq").alias("mature_seq"), F.col("seq").alias("precursor_seq"))
    other = A.table(s, d, "benchmark").selectExpr("concat('b', item_id) AS id", "upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '')) AS seq")
    return D.make_dataset(pos, other, 1).select("id", "label", "mature_seq", "precursor_seq")


@query
def seq_stats(s, d):
    return rounded(A.proteins(s, d).select("id", *S.seq_stats(F.col("seq"), "m1")))


@query
def aa_composition(s, d):
    return rounded(A.proteins(s, d).select("id", *S.aa_composition(F.col("seq"), "m1")))


@query
def method_features(s, d):
    return rounded(D.method_features(_positives(s, d)))


@query
def cumulative_columns(s, d):
    columns = _labelled(s, d).columns
    rows = [(level, len(D.cumulative_columns(columns, level))) for level in D.LEVELS]
    return A.table(s, d, "labels").agg(F.count("*").alias("n_rows")).join(F.broadcast(s.createDataFrame(rows, "level string, n_features int")))


@query
def kmer_embedding(s, d):
    vec = E.kmer_vectors(A.proteins(s, d), dim=32, k=2)
    return vec.select("id", F.array_join(F.transform("vec", lambda x: F.round(x * 10000).cast("long").cast("string")), ",").alias("vec"))


@query
def dna_embedding(s, d):
    """Embeddings of the loci's DNA, by k-mers of 3."""
    seqs = G.fetch_sequence(_envelopes(s, d), A.genome(s, d), "peptide_id", A.CHUNK)
    vec = E.kmer_vectors(seqs, dim=30, k=3)
    return vec.select("peptide_id", F.array_join(F.transform("vec", lambda x: F.round(x * 10000).cast("long").cast("string")), ",").alias("vec"))


@query
def merge_embeddings(s, d):
    vec = A.table(s, d, "embeddings").select(F.concat(F.lit("P"), "vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("vec_id").alias("ord"))
    return rounded(E.merge_embeddings(A.proteins(s, d).select("id"), [(vec, "m6p_", 64)]))


@query
def locus_features(s, d):
    return rounded(E1.locus_features(_envelopes(s, d), _regions(s, d), _models(s, d), A.cds(s, d), A.genome(s, d), A.CHUNK))


@query
def neighbourhood(s, d):
    # written once: loci are read three times, and each reading would be a plan of its own over all line items
    loci = materialize(_envelopes(s, d))
    return rounded(E1.neighbourhood(loci, A.gene_index(s, d), ["PRTN3", "KLK5", "MMP7", "FURIN", "CTSD"], ["ABCA1"], ["CAMP", "DEFA1", "DEFB4A", "HTN1", "DCD"], 1000))


# models


@query
def cv_folds(s, d):
    rows = A.table(s, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label")).where("label is not null")
    return L.cv_folds(rows)


@query
def standardize(s, d):
    cols = ["m1_charge", "m1_hydropathy", "m1_aromatic"]
    return rounded(L.standardize(A.proteins(s, d).select("id", *S.seq_stats(F.col("seq"), "m1")).select("id", *cols), cols))


@query
def logreg(s, d):
    rows = _labelled(s, d)
    cols = D.cumulative_columns(rows.columns, "M1")
    return L.scored(L.fit(rows, cols, "logreg"), rows, cols).select("id", "label", "score")


@query
def logreg_optimum(s, d):
    """The fit of q_logreg is settled: what it implies for every column, over the column's greatest number, is what the positives show."""
    rows = materialize(_labelled(s, d))
    cols = D.cumulative_columns(rows.columns, "M1")
    most = rows.agg(*[F.max(F.abs(c)).alias(c) for c in cols])
    most = most.select(F.explode(F.array(F.struct(F.lit("intercept").alias("term"), F.lit(1.0).alias("most")), *[F.struct(F.lit(c).alias("term"), F.col(c).alias("most")) for c in cols])).alias("m")).select("m.*")
    found = L.optimum(L.fit(rows, cols, "logreg", tol=1e-12), rows, cols).join(F.broadcast(most), "term")
    return found.select("term", (F.round(F.col("moment") / F.when(F.col("most") > 0, F.col("most")).otherwise(1.0), 4) + 0.0).alias("moment"))


@query
def random_forest(s, d):
    rows = _labelled(s, d)
    cols = D.cumulative_columns(rows.columns, "M1")
    return L.scored(L.fit(rows, cols, "rf"), rows, cols).select("id", "label", "score")


@query
def ablation(s, d):
    return L.ablation(_labelled(s, d))


@query
def train_models(s, d):
    return L.train_models(_labelled(s, d))[2]


@query
def predict_peptides(s, d):
    """Every protein scored by the forest that is kept as a table."""
    return L.predict_peptides(A.proteins(s, d).select("id", "seq"), saved_forest(s))


@query
def fit_and_predict(s, d):
    rows = _labelled(s, d)
    model = L.fit(rows, D.cumulative_columns(rows.columns, "M1"), "logreg")
    return L.predict_peptides(A.proteins(s, d).select("id", "seq"), model)


@query
def forest_scores(s, d):
    """The labelled rows by the kept forest, walked as a table of nodes."""
    rows = _labelled(s, d)
    return rounded(score_forest(rows, saved_forest(s)).select("id", "label", "score"))


@query
def embed_backend(s, d):
    """The embedding hook with a small user function: residue fractions."""

    def fractions(seqs):
        import numpy as np

        return np.array([[q.count(a) / max(1, len(q)) for a in "ACDE"] for q in seqs])

    vec = E.embed(A.proteins(s, d), fractions)
    return rounded(vec.select("id", *[F.col("vec")[i].alias(f"v{i}") for i in range(4)]))


@query
def embed_windows(s, d):
    """A model that each worker loads once, on windows of 500 residues that overlap by 100."""

    def load():
        import numpy as np

        letters = "ACDE"

        def fractions(seqs):
            return np.array([[q.count(a) / max(1, len(q)) for a in letters] for q in seqs])

        return fractions

    vec = E.embed(A.proteins(s, d), factory=load, window=500, overlap=100)
    return rounded(vec.select("id", *[F.col("vec")[i].alias(f"v{i}") for i in range(4)]))
