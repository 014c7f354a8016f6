"""Negative windows drawn by digests that are made many at a time."""

import hashlib
import random

from pyspark.sql import functions as F

from peptide_context.functions.digests import drawn_places
from peptide_context.jobs import adapters as A
from peptide_context.operators import cleavage as C


def brute(name, lo, hi, without, count):
    return sorted((k for k in range(lo, hi) if k not in without), key=lambda k: hashlib.md5(b"%s|%d|0" % (name, k)).hexdigest())[:count]


def test_draws_are_those_of_whole_digests():
    rng = random.Random(1)
    names = [f"P{rng.choice([1, 22, 333, 51281, 4444444, 10**30, 10**45])}".encode() for _ in range(60)] + [b"", b"x" * 60, "é".encode()]
    los = [rng.choice([0, 4, 7]) for _ in names]
    his = [lo + rng.choice([0, 1, 5, 200, 3000]) for lo in los]
    his[5] = 140_000
    without = [[rng.randrange(100) for _ in range(rng.choice([0, 5, 10]))] for _ in names]
    count = [rng.choice([0, 1, 3, 6, 12]) for _ in names]
    got = drawn_places(names, los, his, without, count, 0)
    assert got == [brute(*x) for x in zip(names, los, his, without, count, strict=True)]


def test_negative_windows_without_a_digest_a_row(spark):
    rng = random.Random(2)
    seqs = {f"P{i}": "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n)) for i, n in enumerate([8, 9, 30, 400, 70_000])}
    proteins = spark.createDataFrame(list(seqs.items()), "id string, seq string")
    regions = spark.createDataFrame([(p, 12, 6) for p in seqs] + [("P3", 1, 0), ("P3", 200, 6)], "precursor_id string, mature_start int, signal_end int")
    found = C.negative_windows(proteins, regions)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan  # before, each row sorted a digest a bond in an interpreted expression
    got = sorted(tuple(r) for r in found.collect())
    bonds = {p: [11, 6] for p in seqs} | {"P3": [11, 6, 199, 6]}
    want = []
    for p, s in seqs.items():
        near = {k for b in bonds[p] for k in range(b - 2, b + 3)}
        want += [(p, k, s[k - 4 : k + 4]) for k in brute(p.encode(), 4, len(s) - 4, near, 3 * len(bonds[p]))] if len(s) > 8 else []
    assert got == sorted(want)


def test_proteins_are_the_letters_that_are_residues(spark, monkeypatch):
    texts = [(1, "aB c-Dß éKK\U0001f600x"), (2, None), (3, "  123 bjoxuz"), (4, "ſKK\0\nWy")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(A, "table", lambda s, d, name: docs)
    old = "regexp_replace(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '')), '[^ACDEFGHIKLMNPQRSTVWY]', '')"
    want = docs.select(F.concat(F.lit("P"), "doc_id"), F.expr(old).alias("seq"), "doc_id").where("seq <> ''")
    plan = A.proteins(spark, "")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan  # before, two patterns went over every text
    assert sorted(A.proteins(spark, "").collect()) == sorted(want.collect())
