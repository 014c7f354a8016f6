"""Removal of repeated passages against brute force: long texts in segments, nulls, repeats, clashing columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

dedup = pytest.importorskip("peptide_context.llm.suffix_dedup")


def brute(texts, length=400):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def rows():
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghé") for _ in range(n))
    passages = [word(n) for n in (390, 400, 401, 640, 1500)]
    texts = [word(rng.randint(0, 900)) + p + word(rng.randint(0, 300)) for p in passages for _ in range(rng.randint(2, 6))]
    texts += ["ab" * 900, "x" * 3000, "x" * 399, "", None, passages[4][:800] + passages[4][:800]]
    texts += [word(700), word(5000) + passages[3] + word(4000) + passages[3]]
    return [(k if k % 7 else None, t) for k, t in enumerate(texts)] + [(1, texts[1]), (1, texts[1]), (None, texts[0])]


@pytest.mark.parametrize("segment", [1 << 18, 700])
def test_against_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(dedup, "SEGMENT", segment)
    own = rows()
    docs = spark.createDataFrame(own, "doc_id long, text string").withColumn("rk", F.lit(1)).withColumn("lo", F.lit("x")).withColumn("g", F.lit(2))
    got = dedup.remove_repeats(docs.repartition(4)).withColumn("sha", F.sha2("kept", 256)).collect()
    want = Counter((i, *w) for (i, _), w in zip(own, brute([(t or "").encode() for _, t in own]), strict=True))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in got) == want


def test_very_long_text(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range(1_200_000))
    texts = [long, "q" * 100 + long[700_000:700_450] + "r" * 100, long[5:404]]
    got = {r["doc_id"]: r for r in dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(got[i]["n_removed"], got[i]["n_spans"]) for i in range(3)] == [(450, 1), (450, 1), (0, 0)]
    assert bytes(got[0]["kept"]).decode() == long[:700_000] + long[700_450:]
