"""Windows of fewest mismatches, nested bins and embedding models against plain loops."""

import os
import random

import numpy as np
import pytest

from peptide_context.operators import embed as E
from peptide_context.operators import loci as LO
from peptide_context.operators import regions as R


def plain_scan(text, pattern, frac):
    n, m = len(text), len(pattern)
    wrong = [sum(a != b for a, b in zip(text[i : i + m], pattern, strict=True)) for i in range(n - m + 1)]
    at = min(range(len(wrong)), key=lambda i: (wrong[i], i))
    return at + 1 if wrong[at] <= max(1, int(frac * m)) else None


@pytest.mark.parametrize("letters", ["AC", "ACDEFGHIKLMNPQRSTVWYé"])
def test_windows_as_the_plain_scan(letters):
    rng = random.Random(5)
    pairs = []
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 120)))
        at = rng.randrange(len(text))
        pattern = list(text[at : at + rng.randint(1, 40)])
        for _ in range(rng.randint(0, len(pattern) // 3 + 1)):
            pattern[rng.randrange(len(pattern))] = rng.choice(letters)
        pairs.append((text, "".join(pattern)))
    for frac in (0.0, 0.2, 0.5):
        assert R.best_windows(*map(list, zip(*pairs, strict=True)), frac) == [plain_scan(t, p, frac) for t, p in pairs]
    assert R.best_windows([], [], 0.2) == []


def test_few_windows_are_looked_at():
    rng = random.Random(6)
    text = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(20_000))
    pattern = text[700:718] + "W" + text[719:730]
    found = R.candidate_windows(text, pattern, 3)
    assert 700 in found and len(found) < 200


def test_near_genes_by_hand(spark):
    rng = random.Random(7)

    def span(most):
        lo = rng.choice([0, 4095, 4096, 1 << 20, rng.randrange(1 << 21)]) + rng.randint(-3, 3)
        return max(0, lo), max(0, lo) + rng.choice([1, 2, 500, 5_000, most])

    loci = [(f"p{i}", f"c{i % 2}", *span(1_200_000)) for i in range(60)]
    genes = [(f"g{i}", f"c{i % 2}", lo + 1, hi) for i, (lo, hi) in enumerate(span(2_000_000) for _ in range(80))]
    left = spark.createDataFrame(loci, "peptide_id string, chrom string, start0 long, end0 long")
    right = spark.createDataFrame(genes, "symbol string, chrom string, start long, end long")
    for window in (0, 100, 70_000):
        want = sorted((p, g, gap) for p, c, s, e in loci for g, d, a, b in genes if c == d and (gap := max(a - 1 - e, s - b, 0)) <= window)
        assert sorted((r["peptide_id"], r["symbol"], r["gap"]) for r in LO.near_genes(left, right, window).collect()) == want


def test_a_long_gene_gives_few_rows(spark):
    from pyspark.sql import functions as F

    one = spark.createDataFrame([("g", 5, 90_000_000)], "symbol string, a long, b long")
    assert LO.nested_bins(one, F.col("a"), F.col("b"), 0).count() <= LO.MOST_LEVEL
    assert LO.nested_bins(one, F.col("a"), F.col("b"), None).count() == 1


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        import numpy as np

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return lambda seqs: np.array([[len(q), q.count("K")] for q in seqs], float)

    rows = [(i, "K" * (i % 7) + "A" * (i % 11)) for i in range(200)] + [(200, None), (201, "")]
    df = spark.createDataFrame(rows, "id long, seq string").repartition(40)
    got = {r["id"]: r["vec"] for r in E.embed(df, factory=load).collect()}
    assert got == {i: [len(s or ""), (s or "").count("K")] for i, s in rows}
    assert 1 <= len(os.listdir(folder)) <= spark.sparkContext.defaultParallelism < 40


def test_long_sequences_in_windows(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("AK") for _ in range(n))) for i, n in enumerate([0, 1, 9, 10, 11, 13, 14, 17, 100, 101, 1000])]
    share = lambda seqs: np.array([[q.count("K") / max(1, len(q))] for q in seqs])
    df = spark.createDataFrame(rows, "id long, seq string")
    got = {r["id"]: r["vec"][0] for r in E.embed(df, share, window=10, overlap=3, batch=4).collect()}
    for i, s in rows:
        cut = [s] if len(s) <= 10 else [s[k : k + 10] for k in range(0, len(s) - 3, 7)]
        assert "".join(c[3 if j else 0 :] for j, c in enumerate(cut)) == s  # nothing is left out
        assert got[i] == pytest.approx(sum(c.count("K") for c in cut) / max(1, sum(map(len, cut))))
    for wrong in ({}, {"fn": share, "factory": lambda: share}, {"fn": share, "window": 5, "overlap": 5}):
        with pytest.raises(ValueError):
            E.embed(df, **wrong)
