"""The query of operator 4 on planted passages of more than 50 words: its columns against brute force."""

import hashlib
import random
from collections import Counter

import pytest

registry = pytest.importorskip("peptide_context.llm.registry")


def planted():
    """(text, bytes of the passage that it shares with others, 0 without one)."""
    rng = random.Random(4)
    words = lambda n, size: " ".join("".join(rng.choice("abcdefghé") for _ in range(size)) for _ in range(n))
    out = []
    for n, size in ((51, 4), (55, 5), (51, 8), (60, 7), (90, 6)):
        passage = words(n, size)
        out += [(f"{words(rng.randint(5, 120), 6)}\n{passage}\n{words(rng.randint(5, 120), 6)}", len(passage.encode())) for _ in range(3)]
    return out + [(words(n, 6), 0) for n in (1, 50, 60, 200, 400)]


def test_columns_of_planted_passages(spark, tmp_path):
    own = planted()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(own)] + [(99, None)], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op4_suffix_dedup"](spark, str(tmp_path))
    kinds = [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    assert got.dtypes[:5] == kinds
    got = {r["doc_id"]: r for r in got.collect()}
    texts = [t.encode() for t, _ in own] + [b""]
    seen = Counter(t[k : k + 400] for t in texts for k in range(len(t) - 399))
    for (i, t), shared in zip(enumerate(texts), [n for _, n in own] + [0], strict=True):
        r = got[99 if i == len(own) else i]
        gone = sorted({b for k in range(len(t) - 399) if seen[t[k : k + 400]] > 1 for b in range(k, k + 400)})
        kept = bytes(c for b, c in enumerate(t) if b not in set(gone)) if gone else t
        runs = sum(b - 1 not in set(gone) for b in gone)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(t), len(gone), runs)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert (r["n_removed"] > 0) == (shared >= 398)  # with the line feeds at its ends
    assert sum(r["n_removed"] > 0 for r in got.values()) == 9 and len(got) == len(texts)
