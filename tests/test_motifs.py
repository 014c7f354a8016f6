"""The motif automaton against re, over random sequences, user patterns, odd letters, overlapping runs; matrices as arrays."""

import random
import re

import pytest
from pyspark.sql import functions as F

from peptide_context.functions.constants import PROTEASE_MOTIFS
from peptide_context.functions.motifs import Motifs
from peptide_context.operators import cleavage as C

MORE = [("two", "x", "K[KR]?R", 2), ("many", "x", "(?:KR)+", 2), ("not", "x", "[^KR][KR].(?=[^P][AC])", 1), ("far", "x", "AAAAAA", 3), ("before", "x", "R", 0), ("behind", "x", "K", 9)]


def by_hand(seq, motifs, flank=4):
    seq = seq or ""
    out = []
    for n, (_, _, pattern, offset, *_) in enumerate(motifs):
        for m in re.finditer(pattern, seq):
            b = m.start() + offset
            if 1 <= b < len(seq):
                full = seq[b - flank : b + flank] if b >= flank and b + flank <= len(seq) else None
                count = lambda s, k: sum(s.count(c) for c in k)
                out.append((n, b, seq[b - 1], f"{seq[max(0, b - flank) : b]}|{seq[b : b + flank]}", full, len(seq), count(seq[:b], "KR"), count(seq, "KR"), count(seq[:b], "DE"), count(seq, "DE")))
    return sorted(out)


def sequences():
    rng = random.Random(8)
    seqs = ["".join(rng.choice("KRPA" if i % 2 else "ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randint(0, 90))) for i in range(150)]
    return seqs + ["", None, "K" * 3_000, "KR" * 500, "kkRR", "AKéRRKR", "KR\nKRR", "K\0RRKR", "AAAAAAAAAAAAAAAAA", "R", "RK", "日本KRKR"]


@pytest.mark.parametrize("motifs", [PROTEASE_MOTIFS, PROTEASE_MOTIFS + MORE, MORE[1:2], []])
def test_sites_as_re_finds_them(spark, motifs):
    rows = [(f"s{i}", s, 1) for i, s in enumerate(sequences())]
    df = spark.createDataFrame(rows, "id string, seq string, bond int").repartition(3)
    got = {}
    columns = ["motif_ord", "bond", "p1_residue", "window", "window8", "seq_len", "kr_before", "kr_total", "de_before", "de_total"]
    for r in C.scan_cleavage(df, motifs).select("precursor_id", *columns).collect() if motifs else []:
        got.setdefault(r["precursor_id"], []).append(tuple(r)[1:])
    for i, s, _ in rows:
        assert sorted(got.get(i, []), key=repr) == sorted(by_hand(s, motifs), key=repr), s


def test_places_in_one_batch():
    seqs = [s or "" for s in sequences()]
    m = Motifs([(p, o) for _, _, p, o, *_ in PROTEASE_MOTIFS])
    assert len(m.simple) == 9
    found = sorted(zip(*(x.tolist() for x in m.find(seqs)), strict=True))
    assert found == sorted((k, r[0], r[1]) for k, s in enumerate(seqs) for r in by_hand(s, PROTEASE_MOTIFS))


def test_matrix_as_array(spark):
    rng = random.Random(1)
    pwm = {(p, a): rng.uniform(-3, 3) for p in range(1, 9) for a in "ACDEFGHIKLMNPQRSTVWY" if rng.random() < 0.9}
    table = spark.createDataFrame([(p, a, v) for (p, a), v in pwm.items()], "pos int, aa string, logodds double")
    windows = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWYXé*") for _ in range(8)) for _ in range(200)] + [None, "", "ACD", "ACDEFGHIK"]
    rows = C.pwm_scored(spark.createDataFrame([(w,) for w in windows], "w string"), table, "w").collect()
    for r in rows:
        want = sum(pwm.get((i + 1, a), 0.0) for i, a in enumerate(r["w"])) if r["w"] is not None and len(r["w"]) == 8 else None
        assert r["score"] == (want if want is None else pytest.approx(want))
    empty = C.pwm_scored(spark.createDataFrame([("ACDEFGHI",)], "w string"), table.where("false"), "w").first()
    assert empty["score"] == 0.0 and C.score_sites(C.scan_cleavage(spark.createDataFrame([("a", "MKRAAKRAAAAA")], "id string, seq string")), table).where(F.col("score") > 0).count() > 0
