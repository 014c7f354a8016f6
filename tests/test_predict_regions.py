"""Boundaries predicted in one pass, against those from written sites."""

import random

from pyspark.sql import functions as F

from peptide_context.operators import boundaries as B
from peptide_context.operators import cleavage as C


def test_one_pass_predicts_what_written_sites_do(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"P{i}", "".join(rng.choice("ACDEFGKRKRDEWLM") for _ in range(rng.choice([1, 7, 30, 90, 300])))) for i in range(120)]
    proteins = spark.createDataFrame([*rows, ("Pé", "éKRKRAAAAAAAKKDDDDEEE"), ("none", "CCCCCCCCC")], "id string, seq string").localCheckpoint()
    signal = spark.createDataFrame([(f"P{i}", rng.choice([0, 5, 20, 400])) for i in range(0, 120, 2)], "acc string, signal_end int").localCheckpoint()
    pwm = spark.createDataFrame([(i, a, 0.3 * i - 0.9 * (a == "K") - 1) for i in range(1, 9) for a in "KRDWA"], "pos int, aa string, logodds double")
    want = B.predict_boundaries(proteins, C.score_sites(C.scan_cleavage(proteins), pwm), signal)
    want = want.withColumn("sel_score", F.round("sel_score", 9)).collect()
    written = []
    monkeypatch.setattr(B, "materialize", lambda df, f=B.materialize: written.append(df.columns) or f(df))
    got = B.predict_regions(proteins, signal, pwm)
    assert sorted(got.withColumn("sel_score", F.round("sel_score", 9)).collect()) == sorted(want)
    assert written == [["id", "signal_end"]]  # before, every site was written, with its windows
    assert {r["mature_end_source"] for r in want} == {"terminus", "cterm_cut"}
