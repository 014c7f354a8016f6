"""Fill-in-middle against regular expressions and hashlib, over nulls, repeats, sentinels, long texts and blocks of few bytes."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("peptide_context.llm")

SCHEMA = "doc_id long, text string, n long, form string, output int"


def by_hand(doc_id, text, seed=1, moved=90, spm=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= moved:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    turned = h[3] % 100 < spm
    return len(units), "spm" if turned else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if turned else f"<P>{p}<S>{s}<M>{m}"


def rows():
    rng = random.Random(5)
    pool = ["word", "Ab", "é", "日本", "😀", "<", ">", "<P", "S>", "<M", "\n", " ", "-", "0", "\x00", "̀", "P", "S", "M"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "a", "<P>", "x<S>y", "ab<M>", "<<P>>", "<P", "é", "日" * 50, "word " * 60_000, "é" * 300_000 + "<S", "z" * 700_000 + "<S>"]
    found = [(i, t) for i, t in enumerate(texts)]
    return found + found[:5] + [(None, "no id here"), (None, None), (-7, "minus seven")]


@pytest.mark.parametrize("block", [None, 7])
def test_against_regular_expressions(spark, monkeypatch, block):
    from peptide_context.llm import fill_middle

    if block:  # cuts, sentinels and code points that cross the edges of blocks
        monkeypatch.setattr(fill_middle, "BLOCK", block)
    some = [r for r in rows() if not block or len(r[1] or "") < 100]
    if block:
        import numpy as np
        import pyarrow as pa

        rng = np.random.default_rng(1)
        draws = rng.integers(0, 1 << 32, (4, len(some)))
        made = fill_middle.rearrange(pa.array([t or "" for _, t in some]), draws, 100, 50)
        for (_, text), n, form, p, m, out, d in zip(some, *(made[c].to_pylist() for c in ("n", "form", "prefix_chars", "middle_chars", "output")), draws.T.tolist(), strict=True):
            text = text or ""
            units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
            assert n == len(units)
            if form == "plain":
                assert out == text and (not text or any(x in text for x in ("<P>", "<S>", "<M>")))
                continue
            a, b = sorted(x % (n + 1) for x in d[:2])
            pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
            assert (p, m) == (len(pre), len(mid))
            assert out == (f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}")
        return
    docs = spark.createDataFrame([(*r, 1, "n", 2) for r in some], SCHEMA).repartition(5)
    made = fill_middle.fill_in_middle(docs)
    made = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    key = lambda x: (x[0] is None, x[0] or 0, x[5] or "")
    got = sorted([tuple(r) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()], key=key)
    expected = sorted([(i, *by_hand(i, t), t or "") for i, t in some], key=key)
    assert got == expected
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_shares_seed_and_empty_table(spark):
    from peptide_context.llm.fill_middle import fill_in_middle

    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some words to move about").alias("text"))
    assert {r[0] for r in fill_in_middle(docs, moved=100, spm=100).select("form").distinct().collect()} == {"spm"}
    assert {r[0] for r in fill_in_middle(docs, moved=0).select("form").distinct().collect()} == {"plain"}
    assert fill_in_middle(docs, seed=2).exceptAll(fill_in_middle(docs)).count() > 100
    assert fill_in_middle(docs.where("false")).count() == 0


def test_bytes_that_are_no_utf8(spark):
    from peptide_context.llm.fill_middle import fill_in_middle, restored

    docs = spark.sql("select 3L as doc_id, cast(unhex('41428043FF20C3') as string) as text")
    made = fill_in_middle(docs, moved=100)
    row = made.select("n", "form", F.hex(restored(F.col("output"), F.col("form"))).alias("h")).first()
    assert row.h == "41428043FF20C3" and row.n == 5 and row.form != "plain"  # AB with a stray byte, C, FF, blank, C3
