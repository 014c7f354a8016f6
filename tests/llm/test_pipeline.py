"""Stages of the pipeline on rows whose doc_id is null or repeated."""

import random
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n=40):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, s, len(t or "")) for i, t, s in rows], DOCS)


def test_near_duplicates_by_row(spark):
    a, b, c, d, e = (words(k, 200) for k in range(5))
    near = " ".join([*a.split()[:-1], "changed"])
    rows = [(1, a, "x"), (2, near, "x"), (2, b, "x"), (2, b, "x"), (None, c, "x"), (None, d, "x"), (None, d, "y"), (None, near, "x"),
            (5, e, "x"), (None, e, "x"), (7, None, "x"), (7, "", "x"), (7, "", "x"), (None, None, "x")]
    got = Counter((r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, table(spark, rows), "").collect())
    assert got == {(1, a): 1, (2, b): 1, (None, c): 1, (None, d): 1, (5, e): 1, (7, None): 1, (7, ""): 2, (None, None): 1}
    unlike = [(1, a, "x"), (1, b, "x"), (None, c, "x"), (None, d, "x")]
    assert pipeline.near_duplicates(spark, table(spark, unlike), "").count() == 4


def test_mixing_by_row(spark):
    from pyspark.sql import functions as F

    from peptide_context.llm.mixing import mix

    rng = random.Random(2)
    rows = [(None if k % 3 == 0 else k % 7, words(k, rng.randint(1, 30)), "abc"[k % 3]) for k in range(90)]
    rows += [(None, None, "a"), (None, " ", "b"), (3, "", "c"), *[(4, "same text here", "b")] * 5]
    df = table(spark, rows)
    got = pipeline.mixing(spark, df, "").collect()
    size = Counter()
    for r in got:
        size[r["source"]] += len(r["text"].split())
    per = mix(df.withColumn("doc_id", F.xxhash64(*df.columns))).groupBy("source_size").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect()
    assert sorted(size.values()) == sorted(r["n"] for r in per if r["n"])
    total = sum(len((t or "").split()) for _, t, _ in rows)
    assert abs(sum(size.values()) - total) < 10 and all(r["text"].strip() for r in got)
    there = Counter((i, t, s) for i, t, s in rows)
    copies = Counter((r["doc_id"], r["text"], r["source"]) for r in got)
    assert all(n <= 3 * there[k] for k, n in copies.items())


CLASH = ["_key", "_row", "_copies", "_copy", "_id", "_rk", "_gone", "_gd", "_gr", "_text", "_group", "rank", "a.b", "n", "node"]


def test_whole_run_against_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept, with columns that clash with the operators' own."""
    import re
    import zlib

    import numpy as np
    import public_tokenizers
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    rng = random.Random(8)
    syllables = {"aa": "ka to mi ra su ne".split(), "bb": "schl ung ber eich ter".split()}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(2, 4)))
    line = lambda lang, n: " ".join(word(lang) for _ in range(n))
    rows, common = [], {x: line(x, 9) for x in syllables}
    for i in range(90):
        lang = "aa" if i % 3 else "bb"
        lines = [line(lang, rng.randint(4, 12)) for _ in range(rng.randint(1, 6))]
        lines.insert(rng.randint(0, len(lines)), common[lang] if i % 4 else common[lang][:-1] + "x")
        rows.append((i, "\n".join(lines), lang if i % 5 else None, "xyz"[i % 3] if i % 10 else None))
    long = line("aa", 150).split()
    rows += [(200 + k, " ".join([*long[: 60 + k], "kaka", *long[61 + k :]]), "aa", "x") for k in range(5)] + [(300, None, "aa", "y"), (301, "", None, "y"), (302, "12 !?", "bb", "z"), (303, "qxzj \u0436\u0449 wqpx zzxq jjqw " * 30, None, "z"), (None, line("bb", 40), "bb", None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS.replace("lang string, source string", "lang string, source string")).select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.withColumns({c: F.lit(1) for c in CLASH})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages, kept = dict(pipeline.STAGES), {}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        out = pipeline.materialize(stage(spark, docs, str(tmp_path)))
        assert out.columns == docs.columns and stage(spark, docs.where("false"), str(tmp_path)).count() == 0
        docs, kept[name] = out, [(r["doc_id"], r["text"], r["source"]) for r in out.collect()]
    assert {r[0] for r in rows} - {r[0] for r in kept["language_id"]} == {300, 301, 302, 303}

    def close(a, b):
        i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return abs(len(a) - len(b)) < 2 and (a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:])

    seen, want = [], {}
    for i, text, _ in sorted(kept["language_id"], key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = []
        for x in text.split("\n"):
            if not any(close(x, s) if len(x) >= 20 else x == s and x.strip() for s in seen):
                lines.append(x)
            seen.append(x)
        want[i] = "\n".join(lines)
    assert {r[0]: r[1] for r in kept["line_dedup"]} == want

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t, _ in kept["line_dedup"]}
    group = {i: i for i in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if a is not None and b is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                    group[a] = group[b] = min(group[a], group[b])
    assert {r[0] for r in kept["near_duplicates"]} == {i for i, g in group.items() if g == i} and len(kept["near_duplicates"]) < len(sets)
    sizes = lambda rs: Counter(w for _, t, s in rs for w in [s] * len(t.split()))
    before, after = sizes(kept["near_duplicates"]), sizes(kept["mixing"])
    assert abs(sum(before.values()) - sum(after.values())) < 20 and all(n <= 3 * before[s] for s, n in after.items())
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    texts = Counter(np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4").tobytes() for _, x, _ in kept["mixing"])
    assert Counter(bytes(r["ids"]) for r in got if r["length"] == r["doc_tokens"]) == texts
    assert pipeline.run(spark, str(tmp_path)).count() == len(got)


def test_mixing_reaches_targets(spark):
    import itertools

    import numpy as np

    from peptide_context.llm.mixing import fit_counts

    rng = random.Random(6)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 60), rng.randint(1, 4))))
        counts = np.array([rng.randint(1, 3) for _ in lengths])
        budget = rng.randint(0, int((lengths * counts).sum()) + 5)
        got = fit_counts(lengths, counts, budget)
        best = max(s for c in itertools.product(*(range(k + 1) for k in counts)) if (s := int((lengths * np.array(c)).sum())) <= budget)
        assert (got >= 0).all() and (got <= counts).all() and int((got * lengths).sum()) == best
