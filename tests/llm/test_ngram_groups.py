"""The Jaccard join against brute force on groups of near copies, shared passages and odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

join = pytest.importorskip("peptide_context.llm.ngram_join")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    sets = {}
    for i, t in rows:
        if i is not None and shingles(t):
            sets.setdefault(frozenset(shingles(t)), []).append(i)
    keys, ids = list(sets), [min(v) for v in sets.values()]
    comp = list(range(len(keys)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if 100 * len(keys[a] & keys[b]) >= 80 * len(keys[a] | keys[b]):
                comp[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return {keys[k]: least[find(k)] for k in range(len(keys))}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 4000)}"
    passages = [[word() for _ in range(60)] for _ in range(4)]
    rows = []
    for n, copies in ((40, 30), (90, 60), (160, 40), (7, 6), (400, 12)):
        base = [word() for _ in range(n)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, max(1, n // 35))):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.2:
                t += [word() for _ in range(rng.randint(1, n // 4 + 1))]
            rows.append(" ".join(t))
    for _ in range(60):  # little else than passages that others hold as well
        parts = rng.sample(passages, rng.randint(1, 4))
        rows.append(" ".join([w for p in parts for w in p] + [word() for _ in range(rng.randint(0, 40))]))
    rows += [" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(40)]
    rows += [rows[3], rows[40], rows[40].upper(), None, "", " \n", "one", "one", "ONE"]
    rng.shuffle(rows)
    return [(None if k % 41 == 0 else k, t) for k, t in enumerate(rows)] + [(17, rows[17]), (17, "another text of seven words here now")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    want = components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("comp", F.lit(1)).repartition(5)
    got = join.link(docs).collect()
    text = {}
    for i, t in rows:
        text.setdefault(i, []).append(t)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
            continue
        sets = [frozenset(shingles(t)) for t in text[r["doc_id"]]]
        assert (r["n_shingles"], r["component_id"]) in {(len(s), want.get(s, r["doc_id"])) for s in sets}
    assert len({v for v in want.values()}) < len(want) - 50


def test_shown_tokens_suffice():
    for a in range(1, 700):
        for b in range(a, a * 5 // 4 + 2):
            both = -(-4 * (a + b) // 9)
            if both <= a:
                for x in (a, b):  # the one whose list ends first
                    found = join.shown(x) - (x - both)
                    assert found >= join.needed(a) and found >= join.needed(b)


def test_very_long_text(spark):
    rng = random.Random(4)
    words = [f"v{rng.randint(0, 10**7)}" for _ in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-9000])), (3, " ".join(words[: len(words) // 2])), (4, "x" * 1_500_000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (199_996, 1), 2: (190_996, 1), 3: (99_996, 3), 4: (1, 4)}


def test_many_buckets(spark, monkeypatch):
    """More buckets than a chunk has tokens: rows of a token each, and the same components."""
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, join.link(docs).collect()), key=repr)
    monkeypatch.setattr(join, "PER_BUCKET", 1)
    monkeypatch.setattr(join, "CHUNK", 1000)
    monkeypatch.setattr(join, "MOST_CHUNK", 2000)
    bits, chunk = join._buckets(20_000)
    assert bits >= 14 and chunk == 2000 and join._buckets(1e14)[0] == join.MOST_BITS
    assert sorted(map(tuple, join.link(docs).collect()), key=repr) == want
