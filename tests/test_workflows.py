"""Whole runs on small files, and the readers and writers they rest on."""

import random

from pyspark.sql import functions as F

from peptide_context.functions.sequences import revcomp
from peptide_context.jobs import workflows
from peptide_context.sources import readers as R

CODON = dict(zip("ACDEFGHIKLMNPQRSTVWY", "GCT TGT GAT GAA TTT GGT CAT ATT AAA CTG ATG AAT CCT CAG CGT TCT ACT GTT TGG TAT".split(), strict=True))


def wrapped(name, seq, width=50):
    return f">{name}\n" + "\n".join(seq[i : i + width] for i in range(0, len(seq), width)) + "\n"


def test_genome_chunks(spark, tmp_path):
    rng = random.Random(1)
    seqs = {f"c{i}": "".join(rng.choice("ACGTN") for _ in range(n)) for i, n in enumerate((7, 60, 4000, 61, 2500))}
    (tmp_path / "a.fa").write_text("".join(wrapped(f"{k} note", s, 61) for k, s in list(seqs.items())[:3]))
    (tmp_path / "b.fa").write_text("\n" + "".join(wrapped(k, s, 70) for k, s in list(seqs.items())[3:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("300", before):  # many splits a file, and one
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = {(r["chrom"], r["chunk_id"]): r["seq"] for r in R.read_genome(spark, str(tmp_path / "*.fa"), 100).collect()}
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert got == {(k, i): s[100 * i : 100 * i + 100] for k, s in seqs.items() for i in range(-(-len(s) // 100))}


def inputs(tmp_path):
    rng = random.Random(3)
    residue = lambda n, letters="ACDEFGHILMNPQSTVWY": "".join(rng.choice(letters) for _ in range(n))
    proteins, peptides, genome, gff = {}, {}, {}, []
    for i in range(12):
        mature = residue(25, "KRLWGCFI")
        seq = "M" + residue(20) + residue(15) + "KR" + mature + "RR" + residue(6)
        proteins[f"P{i}"], peptides[f"pep{i}"] = seq, mature
        dna, minus = "".join(CODON[a] for a in seq), i % 2
        flank = "".join(rng.choice("ACGT") for _ in range(1500))
        body = dna[:60] + "GTAAGT" * 5 + dna[60:]
        genome[f"c{i}"] = flank + body + flank
        exons = [(1501, 1560), (1591, 1590 + len(dna) - 60)]
        if minus:
            n = len(genome[f"c{i}"])
            genome[f"c{i}"] = genome[f"c{i}"][::-1].translate(str.maketrans("ACGT", "TGCA"))
            exons = [(n - b + 1, n - a + 1) for a, b in exons]
        strand = "-" if minus else "+"
        gff.append(f"c{i}\tm\tmRNA\t1\t9\t90\t{strand}\t.\tID=m{i};Target=P{i} 1 9")
        gff += [f"c{i}\tm\tCDS\t{a}\t{b}\t.\t{strand}\t0\tParent=m{i}" for a, b in exons]
    files = {
        "peptides": "".join(wrapped(k, s) for k, s in peptides.items()), "proteome": "".join(wrapped(f"{k} protein GN=CAMP", s) for k, s in proteins.items()),
        "signal": "".join(f"P{i}\ts\tSignal peptide\t1\t21\n" for i in range(12)), "alignment": "\n".join(gff) + "\n",
        "annotation": "c1\te\tgene\t100\t180\t.\t+\t.\tID=1;Name=PRTN3\nc2\te\tgene\t1501\t1600\t.\t-\t.\tID=2;Name=CAMP\n", "genome": "".join(wrapped(k, s) for k, s in genome.items()),
        "rules": "# pattern\trole\tgene\nCAMP\tenzyme\tPRTN3\n.*\tenzyme\tFURIN\n", "motifs": "# x\nFURIN\tconvertase\tR.[KR]R\t4\nPCSK\tconvertase\t[KR][KR]\t2\tnote\n",
        "tf_motifs": "# x\nONE\tTTGCR\tnote\nTWO\tGGWCC\nRARE\tAAAAAAAAAAAAAAAAAAAA\n",
        "negatives": "".join(wrapped(f"n{i}", residue(30, "DEGSNQ")) for i in range(12)), "queries": wrapped("x", "KRLWGCFIKRLWGKRLLW") + wrapped("y", "DEGSNQDEGSNQ"),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    return {k: str(tmp_path / k) for k in files}, peptides, genome


def test_map_features(spark, tmp_path):
    paths, peptides, genome = inputs(tmp_path)
    out = str(tmp_path / "out")
    workflows.map_features(spark, paths, out)
    got = {}
    for r in R.read_fasta(spark, f"{out}/methods/method1_amp.fa").orderBy("id").collect():
        got.setdefault(r["id"].split("|")[0], []).append(r["seq"])
    for k, s in peptides.items():
        want = "".join(CODON[a] for a in s)
        assert "".join(got[k]) in (want, "".join(reversed(got[k]))) and "".join(sorted("".join(got[k]))) == "".join(sorted(want))
    stages = {r["stage"]: r["count"] for r in R.read_table(spark, f"{out}/report/pipeline_summary", "stage string, count long").collect()}
    assert stages["peptides_mapped_to_precursor"] == 12 and stages["method5_locus_records"] == 12 and stages["method4_enzyme_records"] == 1
    mapped = R.read_table(spark, f"{out}/homology/peptide_to_precursor", "peptide_id string, precursor_id string, gene_symbol string, pident double, query_cov double, precursor_len int, evalue double, stitle string").collect()
    assert {(r["peptide_id"], r["precursor_id"], r["gene_symbol"], r["pident"], r["query_cov"], r["precursor_len"]) for r in mapped} == {(f"pep{i}", f"P{i}", "CAMP", 100.0, 1.0, 71) for i in range(12)}
    regions = spark.read.csv(f"{out}/regions/regions_aa", sep="\t", header=True, inferSchema=True).collect()
    assert {(r["peptide_id"], r["signal_end"], r["mature_start"], r["mature_end"], r["pro_start"], r["pro_end"], r["dibasic_hint"]) for r in regions} == {(f"pep{i}", 21, 39, 63, 22, 38, "KR") for i in range(12)}
    loci = spark.read.csv(f"{out}/methods/method4_enzyme", sep="\t", header=True, inferSchema=True).collect()
    assert [(r["role"], r["gene"], r["chrom"], r["start"], r["end"], r["requested_by_families"], r["status"]) for r in loci] == [("enzyme", "PRTN3", "c1", 100, 180, "CAMP", "ok")]
    enzyme = R.read_fasta(spark, f"{out}/methods/method4_enzyme.fa").collect()
    assert [r["seq"] for r in enzyme] == [genome["c1"][99:180]]
    assert spark.range(1).select(revcomp(F.lit("ACGTN"))).first()[0] == "NACGT"


def test_cleavage_and_predictor(spark, tmp_path):
    paths, peptides, _ = inputs(tmp_path)
    out = str(tmp_path / "out")
    workflows.cleavage_sites(spark, paths, out)
    summary = spark.read.csv(f"{out}/cleavage/boundary_summary", sep="\t", header=True, inferSchema=True).first()
    assert summary["n"] == 12 and summary["accuracy"] > 0.7
    assert spark.read.text(f"{out}/cleavage/cutsites.bed").count() >= 12
    metrics = {r["metric"]: r["value"] for r in spark.read.csv(f"{out}/cleavage/metrics", sep="\t", header=True, inferSchema=True).collect()}
    assert metrics["n_positives"] == 24 and metrics["pwm_auc"] > 0.9 and set(metrics) == {"n_positives", "n_negatives", "pwm_auc", "ml_cv_auc"}
    windows = {r["id"]: r["seq"] for r in R.read_fasta(spark, f"{out}/cleavage/denovo/pro_mature.fa").collect()}
    proteome = {r["id"]: r["seq"] for r in R.read_fasta(spark, paths["proteome"]).collect()}
    assert windows == {f"pep{i}|P{i}": proteome[f"P{i}"][34:42] for i in range(12)}
    workflows.predictor(spark, paths, out, cv=2, trees=8)
    data = spark.read.csv(f"{out}/dataset", sep="\t", header=True, inferSchema=True).toPandas().set_index("id")
    own = data[data.label == 1]
    assert len(own) == 12 and (own.cut_score > 0.5).all() and (own.n_strong_cuts > 0).all() and (own.n_exons == 2).all()
    lengths = {r["id"]: len(r["seq"]) for r in R.read_fasta(spark, paths["proteome"]).collect()}
    assert (own.locus_len_bp == [3 * lengths["P" + i.removeprefix("pep")] + 30 for i in own.index]).all()
    assert own.loc["pep1", "enzyme_present"] == 1 and own.loc["pep1", "enzyme_dist_kb"] > 0 and own.loc["pep3", "enzyme_present"] == 0
    assert own.loc["pep2", "neighbor_amp_count"] == 1 and own.loc["pep2", "gene_density"] > 0
    p, g = (own[[c for c in own if c.startswith(x)]].to_numpy() for x in ("m6p_", "m6g_"))
    assert p.shape[1] == g.shape[1] == 32 and abs((p**2).sum(axis=1) - 1).max() < 1e-9 and abs((g**2).sum(axis=1) - 1).max() < 1e-9
    assert (data[data.label == 0][[c for c in data if c.startswith("m6g_")]] == 0).all().all()
    levels = {r["method_set"]: r["n_features"] for r in spark.read.csv(f"{out}/model/ablation", sep="\t", header=True, inferSchema=True).collect()}
    assert levels["M1"] == 29 and levels["M1..M5"] == 61 and levels["M1..M6"] == 125
    calls = {r["id"]: r["call"] for r in R.read_table(spark, f"{out}/predictions", "id string, length int, amp_probability double, call string").collect()}
    assert calls["y"] == "non-AMP"
    model, columns = R.load_model(spark, f"{out}/model/model_full")
    assert model.numFeatures == len(columns) and columns[0].startswith("m1_")


def test_regulatory_layer(spark, tmp_path):
    paths, _, genome = inputs(tmp_path)
    out = str(tmp_path / "out")
    workflows.regulatory_layer(spark, paths, out, max_mismatch=0)
    spans = {"PRTN3": ("enzyme", "c1", 1, 300, "+"), "CAMP": ("amp", "c2", 1400, 2600, "-")}
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    seqs = {}
    for gene, (_, chrom, a, b, strand) in spans.items():
        dna = genome[chrom][a - 1 : b]
        seqs[gene] = flip(dna) if strand == "-" else dna
    got = {(r["gene"], r["role"], r["chrom"], r["start"], r["end"], r["strand"]): r["seq"] for r in R.read_promoters(spark, f"{out}/regulatory/promoters.fa").collect()}
    assert got == {(g, *s): seqs[g] for g, s in spans.items()}
    hits, found = [], {}
    for gene, (role, chrom, a, b, strand) in spans.items():
        for tf, sets in (("ONE", ["T", "T", "G", "C", "AG"]), ("TWO", ["G", "G", "AT", "C", "C"])):
            back = [flip(x) for x in reversed(sets)]
            for orient, want in (("+", sets), ("-", back)):
                for i in range(len(seqs[gene]) - 4):
                    if all(c in w for c, w in zip(seqs[gene][i : i + 5], want, strict=True)):
                        s0 = a - 1 + i if strand == "+" else b - i - 5
                        hits.append((gene, role, tf, orient, i, chrom, s0, s0 + 5, seqs[gene][i : i + 5]))
                        found.setdefault(gene, set()).add(tf)
    schema = "gene string, role string, tf string, motif_orient string, promoter_offset int, chrom string, start0 long, end0 long, matched_seq string"
    assert sorted(map(tuple, R.read_table(spark, f"{out}/regulatory/tfbs_hits", schema).collect())) == sorted(hits) and len(hits) > 5
    bed = [r["value"].split("\t") for r in spark.read.text(f"{out}/regulatory/tfbs.bed").collect()]
    assert sorted(bed) == sorted([c, str(s), str(e), f"{tf}|{g}|{role}", ".", "."] for g, role, tf, _, _, c, s, e, _ in hits)
    joined = lambda x: ",".join(sorted(x)) or "."
    a, p = found.get("CAMP", set()), found.get("PRTN3", set())
    rows = [tuple(r) for r in spark.read.csv(f"{out}/regulatory/shared_signatures", sep="\t", header=True).collect()]
    assert rows == [("CAMP", "PRTN3", "enzyme", joined(a & p), str(len(a & p)), joined(a - p), joined(p - a))]
    assert [tuple(r) for r in spark.read.csv(f"{out}/regulatory/pairs", sep="\t", header=True).collect()] == [("CAMP", "PRTN3", "enzyme")]


def test_runs_leave_no_scratch(spark, tmp_path):
    import os

    from peptide_context.operators.components import scratch

    paths, _, _ = inputs(tmp_path)
    folder = os.path.dirname(scratch(spark)).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    workflows.regulatory_layer(spark, paths, str(tmp_path / "out"))
    assert set(os.listdir(folder)) == before
