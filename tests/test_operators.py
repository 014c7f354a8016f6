"""Golden micro-cases of the gene-context operators, worked by hand, and independent plain-Python checks."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from peptide_context.functions import sequences as S
from peptide_context.functions.constants import PROTEASE_MOTIFS, TF_MOTIFS
from peptide_context.operators import boundaries as B
from peptide_context.operators import cleavage as C
from peptide_context.operators import dataset as D
from peptide_context.operators import embed as E
from peptide_context.operators import genemodel as G
from peptide_context.operators import homology as H
from peptide_context.operators import loci as LO
from peptide_context.operators import ml as L
from peptide_context.operators import regions as R
from peptide_context.operators import regulatory as T


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, S.revcomp(F.col("s")), s="ACGTNacg") == "cgtNACGT"
    assert one(spark, S.gene_symbol(F.col("s")), s="x GN=CAMP OS=h") == "CAMP"
    assert one(spark, S.gene_symbol(F.col("s")), s="x GN= y") == ""
    assert one(spark, S.gene_symbol(F.col("s")), s="xGN=A") == "."
    assert one(spark, S.dibasic_hint(F.col("s"), F.lit(5)), s="MAKRGG") == "KR"
    assert one(spark, S.dibasic_hint(F.col("s"), F.lit(2)), s="KRGG") == "."
    assert one(spark, S.site_window(F.col("s"), F.lit(2)), s="ABCDEFGH") == "AB|CDEF"
    assert one(spark, S.full_window(F.col("s"), F.lit(3)), s="ABCDEFGH") is None
    assert one(spark, S.full_window(F.col("s"), F.lit(4)), s="ABCDEFGH") == "ABCDEFGH"
    assert one(spark, S.logistic(F.col("s")), s=1e9) == 1.0
    assert one(spark, S.logistic(F.lit(None).cast("double")), s=1.0) is None
    row = spark.range(1).select(*S.seq_stats(F.lit(""), "a")).first()
    assert all(v == 0.0 for v in row)


def test_scan_cases(spark):
    seqs = frame(spark, "id string, seq string", ("a", "AKRRA"), ("b", "AAK"), ("c", "AKPAKG"))
    sites = {(r["precursor_id"], r["enzyme"], r["bond"]) for r in C.scan_cleavage(seqs).collect()}
    assert ("a", "PCSK_dibasic", 3) in sites and ("a", "PCSK_dibasic", 4) not in sites
    assert not any(p == "b" and e == "KLK5" for p, e, _ in sites)
    assert {b for p, e, b in sites if (p, e) == ("c", "KLK5")} == {5}


def test_scan_equals_finditer(spark):
    rng = random.Random(1)
    seqs = [(f"s{i}", "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY" + "RK" * 4) for _ in range(rng.randint(0, 90)))) for i in range(40)]
    want = set()
    for sid, seq in seqs:
        for n, (_, _, p, off, _) in enumerate(PROTEASE_MOTIFS):
            want |= {(sid, n, m.start() + off) for m in re.finditer(p, seq) if 1 <= m.start() + off < len(seq)}
    df = frame(spark, "id string, seq string", *seqs)
    for got in (C.scan_cleavage(df), C.scan_cleavage(df.repartition(3), [m[:4] for m in PROTEASE_MOTIFS])):
        assert {(r["precursor_id"], r["motif_ord"], r["bond"]) for r in got.collect()} == want


def test_find_mature(spark):
    rows = [("AAACDEFGAAA", "CDWFG", 4), ("AAACDEFGAAA", "WWWFG", None), ("MKLV", "lv", 3), ("MK", "MKL", None), ("MK", "", None), ("AAMKAA", "MK", 3)]
    df = frame(spark, "n int, precursor string, peptide string", *[(i, a, b) for i, (a, b, _) in enumerate(rows)])
    got = {r["n"]: r["mature_start"] for r in R.find_mature(df).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(rows)}


def test_regions(spark):
    map_ = frame(spark, "peptide_id string, precursor_id string, gene_symbol string", ("p", "P", "G"), ("q", "P", "."), ("r", "none", "."))
    prec = frame(spark, "id string, seq string", ("P", "M" * 10 + "KLVWWW"))
    pep = frame(spark, "id string, seq string", ("p", "KLV"), ("q", "YYYYY"), ("r", "A"))
    sig = frame(spark, "acc string, signal_end int", ("P", 10))
    got = R.define_regions(map_, prec, pep, sig).collect()
    assert [(r["peptide_id"], r["mature_start"], r["mature_end"], r["pro_start"], r["pro_end"]) for r in got] == [("p", 11, 13, 0, 0)]


def units(spark, strand, *cds):
    mrna = frame(spark, "mrna_id int, protein string, chrom string, strand string, score double, ord long", (1, "P", "c", strand, 5.0, 1), (2, "P", "c", strand, 9.0, 2))
    return G.coding_units(G.best_gene_model(mrna, cds_of(spark, *cds)), cds_of(spark, *cds))


def cds_of(spark, *cds):
    return frame(spark, "mrna_id int, start long, end long, phase int", *[(1, *c) for c in cds])


def test_projection(spark):
    span = frame(spark, "protein string, aa_start int, aa_end int", ("P", 2, 3))
    got = G.aa_intervals_to_genome(span, units(spark, "+", (101, 107, 1), (201, 206, 0))).collect()
    assert sorted((r["start0"], r["end0"]) for r in got) == [(104, 107), (200, 203)]
    first = frame(spark, "protein string, aa_start int, aa_end int", ("P", 1, 1))
    got = G.aa_intervals_to_genome(first, units(spark, "-", (101, 109, 0))).collect()
    assert [(r["start0"], r["end0"]) for r in got] == [(106, 109)]
    bond = frame(spark, "protein string, bond int", ("P", 1))
    got = G.bonds_to_genome(bond, units(spark, "-", (101, 109, 0)), ["protein", "bond"]).first()
    assert (got["start0"], got["end0"]) == (106, 107)


def test_fetch_over_chunks(spark):
    genome = "ACGTNACGTTGCAAGT"
    chunks = frame(spark, "chrom string, chunk_id long, seq string", *[("c", i, genome[4 * i : 4 * i + 4]) for i in range(4)])
    rng = random.Random(2)
    spans = [(f"k{i}", "c", rng.randint(-2, 14), 0, rng.choice("+-")) for i in range(30)]
    spans = [(k, c, s, s + rng.randint(1, 9), x) for k, c, s, _, x in spans]
    got = {r["k"]: r["seq"] for r in G.fetch_sequence(frame(spark, "k string, chrom string, start0 long, end0 long, strand string", *spans), chunks, "k", 4).collect()}
    swap = str.maketrans("ACGT", "TGCA")
    for k, _, s, e, x in spans:
        want = genome[max(0, s) : max(0, e)]
        assert got.get(k, "") == (want.translate(swap)[::-1] if x == "-" else want)


def test_rules_fall_back(spark):
    rows = frame(spark, "gene_symbol string, stitle string", ("XYZ", "nothing"), ("CAMP", "x"), ("A", "human Defensin 1"))
    got = {(r["role"], r["gene"]): r["families"] for r in LO.enzyme_rules(rows).collect()}
    assert got[("transporter", "ABCA1")] == ["XYZ"] and got[("enzyme", "PRTN3")] == ["CAMP"] and got[("enzyme", "MMP7")] == ["A"]
    assert got[("enzyme", "FURIN")] == ["A", "XYZ"]


def test_promoter_minus(spark):
    gene = frame(spark, "symbol string, chrom string, start long, end long, strand string", ("g", "c", 500, 900, "-"))
    r = T.promoter_windows(gene, 100, 20).first()
    assert (r["p_start"], r["p_end"]) == (880, 1000)


def test_tfbs(spark):
    cols = "gene string, role string, chrom string, p_start long, p_end long, strand string, seq string"
    rng = random.Random(3)
    seqs = ["TGACTCA", "TGANTCA"] + ["".join(rng.choice("ACGTN") for _ in range(60)) for _ in range(5)]
    df = frame(spark, cols, *[(f"g{i}", "r", "c", 11, 10 + len(s), "+", s) for i, s in enumerate(seqs)])
    exact = T.tfbs_hits(df, [("AP1", "TGASTCA")], 0).where("gene in ('g0', 'g1')").collect()
    assert sorted((r["gene"], r["motif_orient"], r["promoter_offset"], r["start0"]) for r in exact) == [("g0", "+", 0, 10), ("g0", "-", 0, 10)]
    from peptide_context.functions.constants import IUPAC

    comp = dict(zip("ACGT", "TGCA", strict=True))
    want = set()
    for i, s in enumerate(seqs):
        for tf, cons in TF_MOTIFS:
            sets = [IUPAC[c] for c in cons]
            for o, ss in (("+", sets), ("-", ["".join(comp[b] for b in x) for x in reversed(sets)])):
                for k in range(len(s) - len(ss) + 1):
                    if sum(s[k + j] not in x for j, x in enumerate(ss)) <= 1:
                        want.add((f"g{i}", tf, o, k))
    assert {(r["gene"], r["tf"], r["motif_orient"], r["promoter_offset"]) for r in T.tfbs_hits(df).collect()} == want


def test_auc(spark):
    rows = frame(spark, "score double, label int", (0.5, 1), (0.9, 1), (0.5, 0), (0.1, 0))
    assert L.auc(rows).first()["auc"] == pytest.approx(0.875)
    assert L.auc(rows.where("label = 1")).first()["auc"] is None
    rng = random.Random(4)
    data = [(rng.randint(0, 30) / 10, rng.randint(0, 1)) for _ in range(400)]
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert L.auc(frame(spark, "score double, label int", *data).repartition(7)).first()["auc"] == pytest.approx(want)


def test_cterm_trim(spark):
    seq = "MAAAAKRKKKRDDDD"
    starts = frame(spark, "precursor_id string, seq string, signal_end int, mature_start int, sel_score double", ("P", seq, 5, 6, 0.0))
    cuts = frame(spark, "precursor_id string, bond int", ("P", 11), ("P", 11))
    got = B.trim_cterm(starts, cuts).first()
    assert (got["mature_end"], got["mature_end_source"]) == (11, "cterm_cut")
    assert B.trim_cterm(starts, cuts, cterm=False).first()["mature_end"] == len(seq)


def test_no_candidates(spark):
    prec = frame(spark, "id string, seq string", ("P", "GGGG"))
    none = C.scan_cleavage(prec.where("false"))
    sig = frame(spark, "acc string, signal_end int", ("P", 2))
    r = B.predict_boundaries(prec, none, sig).first()
    assert (r["mature_start"], r["sel_score"], r["mature_end"], r["pro_start"]) == (3, 0.0, 4, 0)


def test_best_hit_ties(spark):
    cols = "qseqid string, sseqid string, pident double, length int, qlen int, slen int, evalue double, bitscore double, stitle string, full_sseq string, ord long"
    hits = frame(spark, cols, ("q", "b", 95.0, 9, 10, 50, 0.0, 7.0, "t", "A-C", 2), ("q", "a", 95.0, 9, 10, 50, 0.0, 7.0, "t", "AC", 1), ("q", "c", 80.0, 9, 10, 50, 0.0, 99.0, "t", "X", 0))
    assert H.best_precursor(hits).first()["precursor_id"] == "a"
    assert H.unique_precursors(H.best_precursor(hits)).first()["seq"] == "AC"


def test_homology_and_clusters(spark):
    pep = frame(spark, "id string, seq string, ord long", ("p", "ACDEFGHIKL", 1), ("q", "ACDEFGHIKL", 2), ("r", "ACDEFGHIKM", 3), ("s", "WWWWYYYY", 4))
    prot = frame(spark, "id string, seq string", ("P", "MMACDEFGHIKLMM"), ("Q", "GGGG"))
    got = {(r["qseqid"], r["sseqid"], r["same"], r["sstart"]) for r in H.homology_hits(pep, prot).collect()}
    assert got == {("p", "P", 10, 3), ("q", "P", 10, 3), ("r", "P", 9, 3)}
    assert {r["id"] for r in H.clean_peptides(pep).collect()} == {"p", "r", "s"}
    assert {(r["id"], r["representative"]) for r in H.cluster_peptides(pep).collect()} == {("p", "p"), ("q", "p"), ("r", "p"), ("s", "s")}


def test_pwm_sums_to_one(spark):
    w = frame(spark, "window string", ("ACDEFGHI",), ("ACDEKGHI",))
    bg = C.background(frame(spark, "seq string", ("ACDEFGHIKL",)))
    rows = C.build_pwm(w, bg).join(bg, "aa").groupBy("pos").agg(F.sum(F.col("freq") * F.pow(F.lit(2.0), "logodds")).alias("s")).collect()
    assert len(rows) == 8 and all(r["s"] == pytest.approx(1.0) for r in rows)


def test_embedding(spark):
    seqs = [("a", "ACDEACD"), ("b", "A"), ("c", "")]
    got = {r["id"]: r["vec"] for r in E.kmer_vectors(frame(spark, "id string, seq string", *seqs), dim=30, k=2).collect()}
    for sid, s in seqs:
        v = [0.0] * 30
        for i in range(len(s) - 1):
            v[int(hashlib.md5(s[i : i + 2].encode()).hexdigest(), 16) % 30] += 1
        n = sum(x * x for x in v) ** 0.5 or 1.0
        assert got[sid] == pytest.approx([x / n for x in v])


def test_dataset(spark):
    pos = frame(spark, "id string, mature_seq string", ("a", "ACDEFGHIKL"))
    decoys = D.shuffled_decoys(pos, 3).collect()
    assert len(decoys) == 3 and all(sorted(r["mature_seq"]) == sorted("ACDEFGHIKL") for r in decoys)
    feats = D.method_features(D.make_dataset(pos, per_pos=1))
    assert len(D.cumulative_columns(feats.columns, "M1")) == 29 and len(D.cumulative_columns(feats.columns, "M5")) == 61
    assert feats.where("m2pro_len <> 0 or n_exons <> 0").count() == 0


def test_folds(spark):
    rows = frame(spark, "id int, label int", *[(i, int(i % 3 == 0)) for i in range(60)])
    got = L.cv_folds(rows, 5).groupBy("label", "fold").count().collect()
    assert sorted(r["count"] for r in got) == [4] * 5 + [8] * 5
    z = L.standardize(frame(spark, "a double, b double", (1.0, 2.0), (3.0, 2.0)), ["a", "b"]).collect()
    assert [r["b"] for r in z] == [0.0, 0.0]


def test_models(spark):
    rng = random.Random(5)
    rows = [(f"i{i}", y, "".join(rng.choice("KRLW" if y else "DEGS") for _ in range(20))) for i, y in enumerate([0, 1] * 20)]
    feats = D.method_features(frame(spark, "id string, label int, mature_seq string", *rows))
    table = {r["level"]: r for r in L.ablation(feats, cv=2, kind="logreg").collect()}
    assert table[1]["cv_roc_auc"] > 0.95 and table[6]["n_features"] == 61
    model = L.fit(feats, D.cumulative_columns(feats.columns, "M1"), "rf", trees=5)
    calls = L.predict_peptides(frame(spark, "id string, seq string", ("x", "KKRRLLWW"), ("y", "DDEEGGSS")), model)
    assert {r["id"]: r["call"] for r in calls.collect()} == {"x": "AMP", "y": "non-AMP"}
