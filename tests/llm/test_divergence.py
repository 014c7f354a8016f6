"""Source divergence against fractions worked out in Python, over nulls, repeats, ties, groups without terms, ranges of few rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("peptide_context.llm")

SCHEMA = "lang string, source string, text string, term string, n int, docs int, range int, value string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least=10, top=10):
    docs = [tuple(x or "" for x in r[:3]) for r in rows]
    held, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        terms = TERM.findall(text.translate(FOLD))
        held[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for t, c in held[lang].items() if c >= least]
        groups = [g for g in count if g[0] == lang]

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        p = {g: share(count[g]) for g in groups}
        q = share(sum((count[g] for g in groups), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for g in groups:
            pairs = [(sum(f(p[g][t], p[h][t]) for t in kept), h[1]) for h in groups if h != g]
            terms = [(f(p[g][t], q[t]), t) for t in kept if count[g][t] > 0 and p[g][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(*g, part, item, value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


def rows():
    rng = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "çà", "ÉTÉ", "été", "日本", "z-y", "it's", "a1b", "😀x", " nb", "long" * 500]
    found = []
    for i in range(160):
        source = ["hot", "hot", "b", None, "", "ü", "zz"][i % 7]
        weights = [1 + (len(source or "") * j + 3) % 7 for j in range(len(words))]
        found.append((["en", "de", None][i % 3], source, " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))))
    found += [("en", "nothing", None), ("en", "blank", " \n 12 _"), ("rare", "a", "seen once"), ("rare", "b", "seen once"), ("one", "alone", "w")]
    found += [("tie", s, "x y z") for s in "abc" for _ in range(10)] + found[:9]
    return found


@pytest.mark.parametrize("ranged", [None, 3])
def test_against_fractions(spark, monkeypatch, ranged):
    from peptide_context.llm import divergence

    if ranged:
        monkeypatch.setattr(divergence, "RANGE_ROWS", ranged)
        monkeypatch.setattr(divergence, "CELLS", 4)
    docs = spark.createDataFrame([(*r, "t", 1, 2, 3, "v") for r in rows()], SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in divergence.source_divergence(docs).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == by_hand(rows())


def test_fewer_documents_and_empty_table(spark):
    from peptide_context.llm.divergence import source_divergence

    docs = spark.createDataFrame([(*r, "t", 1, 2, 3, "v") for r in rows()], SCHEMA)
    got = sorted(tuple(r) for r in source_divergence(docs, 1, 3).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == by_hand(rows(), 1, 3)
    assert source_divergence(docs.where("false")).count() == 0


def test_shares_are_exact():
    from peptide_context.llm.divergence import shares

    rng = random.Random(1)
    total = [rng.randint(1, 9 * 10**15) for _ in range(500)]
    count = [rng.randint(1, t) for t in total]
    assert shares(np.array(count), np.array(total)).tolist() == [1 + 10**9 * c // t for c, t in zip(count, total, strict=True)]
