"""Homology search and clusters against brute force: repeats, lower case, common k-mers, chains, short copies."""

import random

import pytest

from peptide_context.operators import homology as H
from peptide_context.operators import ungapped

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def diagonals(a, b):
    """(d, equal residues, overlap) of every way to lay a beside b."""
    for d in range(1 - len(a), len(b)):
        lo, hi = max(0, -d), min(len(a), len(b) - d)
        yield d, sum(a[i] == b[i + d] for i in range(lo, hi)), hi - lo


def greedy(rows, least=0.9, k=4):
    """(id -> representative), one peptide after the other."""
    rows = [(i, s.upper() if s else None) for i, s in rows]
    found, reps = {}, []
    first = {}
    for i, s in sorted((r for r in rows if r[1]), key=lambda r: r[0]):
        first.setdefault(s, i)
    for s, i in sorted(first.items(), key=lambda r: (-len(r[0]), r[1])):
        own = next((r for r, t in reps if len(s) >= k and any(n >= least * len(s) for _, n, _ in diagonals(s, t))), None)
        found[i] = own or i
        if own is None:
            reps.append((i, s))
    return {i: found[first[s]] if s else i for i, s in rows}


def peptides(seed=4):
    rng = random.Random(seed)
    rows = []
    for f in range(25):  # families of near copies, parts and chains
        base = [rng.choice(LETTERS[:6] if f % 3 == 0 else LETTERS) for _ in range(rng.randint(4, 40))]
        for m in range(rng.randint(1, 8)):
            base = list(base)
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = rng.choice(LETTERS)
            cut = "".join(base)[rng.randint(0, 3) : len(base) - rng.randint(0, 3)]
            rows.append((f"f{f:02}m{m}", cut.lower() if m % 4 == 3 else cut))
    chain = [[rng.choice(LETTERS) for _ in range(20)]]
    for step in range(9):  # each within 90 % of the next; the ends far apart
        nxt = list(chain[-1])
        for i in (step, step + 10):
            nxt[i] = rng.choice([c for c in LETTERS if c != nxt[i]])
        chain.append(nxt)
    rows += [(f"c{i:02}", "".join(s)) for i, s in enumerate(chain)]
    return rows + [("s1", "AK"), ("s2", "AK"), ("s3", "ak"), ("s4", "RF"), ("w", None), ("x", None), ("e", ""), ("z1", "GGGGGGGGGGGG"), ("z2", "GGGGGGGG")]


def test_clusters_as_one_by_one(spark):
    rows = peptides()
    got = {r["id"]: r["representative"] for r in H.cluster_peptides(spark.createDataFrame(rows, "id string, seq string")).collect()}
    assert got == greedy(rows)
    assert got["c05"] != "c00" and got["s3"] == "s1" and got["z2"] == "z1"
    assert H.cluster_peptides(spark.createDataFrame([], "id string, seq string")).count() == 0


def by_hand(peps, prots, k=5, seeds=2, top=5):
    out = set()
    for q, a in peps:
        a, found = a.upper(), []
        for t, b in prots:
            b = (b or "").upper()
            best = None
            for d, same, overlap in diagonals(a, b):
                n = sum(a[i : i + k] == b[i + d : i + d + k] and 0 <= i + d for i in range(len(a) - k + 1))
                if n >= max(1, min(seeds, len(a) - k + 1)) and (best is None or n > best[0]):
                    best = (n, d, same, overlap)
            if best:
                found.append((-best[2], t, best))
        out |= {(q, t, n, d, same, overlap, r + 1) for r, (_, t, (n, d, same, overlap)) in enumerate(sorted(found)[:top])}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_hits_by_hand(spark, monkeypatch, small):
    rng = random.Random(9)
    prots = [(f"P{i:02}", "".join(rng.choice("ACDEGK" if i % 2 else LETTERS) for _ in range(rng.randint(5, 120)))) for i in range(40)]
    prots += [("same1", prots[3][1]), ("same2", prots[3][1].lower()), ("poly", "K" * 80), ("none", None), ("empty", "")]
    peps = [(f"p{i:02}", (s := rng.choice(prots[:40])[1])[(a := rng.randint(0, 20)) : a + rng.randint(5, 30)]) for i in range(30)]
    peps += [("poly", "KKKKKKKKKK"), ("short", "KKKK"), ("five", "KKKKK"), ("tie", prots[3][1][:12]), ("lower", prots[5][1][:9].lower())]
    if small:  # pieces of few hits, units of few residues
        monkeypatch.setattr(H, "BLOCK_RESIDUES", 100)
        monkeypatch.setattr(H, "LANE_RESIDUES", 300)
    a, b = (spark.createDataFrame(x, "id string, seq string") for x in (peps, prots))
    got = {(r["qseqid"], r["sseqid"], r["seeds"], r["diagonal"], r["same"], r["length"], r["ord"]) for r in H.homology_hits(a, b).collect()}
    assert got == by_hand(peps, prots)
    assert H.homology_hits(a.where("false"), b).count() == 0 and H.homology_hits(a, b.where("false")).count() == 0


def test_pieces_of_few_hits(monkeypatch):
    rng = random.Random(2)
    seqs = [bytes(rng.choice(b"ACD") for _ in range(rng.randint(0, 30))) for _ in range(20)]
    queries, targets = ungapped.Texts(seqs[:12], 3), ungapped.Texts(seqs, 3)
    whole = sorted(zip(*(np_.tolist() for np_ in map(_joined, zip(*ungapped.Index(queries).diagonals(targets), strict=True))), strict=True))
    monkeypatch.setattr(ungapped, "HITS", 5)
    monkeypatch.setattr(ungapped, "RESIDUES", 7)
    parts = sorted(zip(*(np_.tolist() for np_ in map(_joined, zip(*ungapped.Index(queries).diagonals(targets), strict=True))), strict=True))
    assert whole == parts and len(whole) > 100


def _joined(parts):
    import numpy as np

    return np.concatenate(parts)


def test_hits_ignore_case(spark):
    pep, prot = (spark.createDataFrame(x, "id string, seq string") for x in ([("p", "acdefghikl")], [("P", "MMACDEFGHIKLMM"), ("Q", "mmacdefghiklmm")]))
    got = {(r["qseqid"], r["sseqid"], r["same"]) for r in H.homology_hits(pep, prot).collect()}
    assert got == {("p", "P", 10), ("p", "Q", 10)}
    assert {r["sseqid"] for r in H.homology_hits(pep, prot, ignore_case=False).collect()} == {"Q"}
    assert H.homology_hits(pep, prot, max_evalue=1e-9).count() == 0


def test_broadcasts_go_by_bytes(spark):
    from pyspark.sql import functions as F

    from peptide_context.operators.components import small_side

    few = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array_repeat(F.lit(1), 500).alias("a"))
    hinted = lambda df, most: "broadcast" in small_side(df, most)._jdf.queryExecution().logical().toString().lower()
    assert hinted(few, 100_000) and not hinted(few, 40_000)
    assert hinted(few.select("id"), 1_000) and not hinted(few.select("id"), 300)


def test_steps_drop_their_tables(spark):
    import os

    from peptide_context.operators.components import materialize, scratch, step

    before = materialize(spark.range(3))
    with step(spark) as keep:
        inner = materialize(spark.range(5))
        kept = keep(inner.where("id > 1"))
        folder = os.path.dirname(scratch(spark))
    assert kept.count() == 3 and before.count() == 3 and not os.path.exists(folder.removeprefix("file:"))
