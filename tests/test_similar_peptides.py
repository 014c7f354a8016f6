"""Similar peptides by undamaged blocks, against all pairs."""

import random

import pytest

from peptide_context.operators import homology as H


def brute(rows, least):
    found = set()
    for a, x in rows:
        for b, y in rows:
            if a != b and len(x) >= 4 and (len(y) > len(x) or (len(y) == len(x) and b < a)):
                same = max(sum(x[i] == y[i + d] for i in range(len(x)) if 0 <= i + d < len(y)) for d in range(-len(x) + 1, len(y)))
                if same >= len(x) * least - 1e-9:
                    found.add((a, b))
    return found


@pytest.mark.parametrize("least", [0.9, 1.0])
def test_all_pairs_and_few_candidates(spark, monkeypatch, least):
    rng = random.Random(6)
    words = ["".join(rng.choice("ACDEFGHIK") for _ in range(5)) for _ in range(12)]
    rows = []
    for i in range(90):
        s = "".join(rng.choice(words) for _ in range(9))[: rng.choice([4, 5, 9, 10, 11, 12, 19, 20, 29, 30, 40])]
        rows.append((f"a{i}", s))
        t = list(s + rng.choice(["", "W", "WYWYW"]))
        for _ in range(rng.choice([0, 1, 2, 4])):
            t[rng.randrange(len(t))] = "Y"
        rows.append((f"b{i}", "".join(t)[rng.choice([0, 0, 1]) :]))
    written = []
    monkeypatch.setattr(H, "materialize", lambda df, f=H.materialize: written.append(f(df)) or written[-1])
    got = H.similar_peptides(spark.createDataFrame(rows, "id string, seq string").localCheckpoint(), least)
    assert {tuple(r) for r in got.collect()} == brute(rows, least)
    assert sum(w.count() for w in written) < 5000  # before, every k-mer was written, and what meets by one of up to 17 rare ones
