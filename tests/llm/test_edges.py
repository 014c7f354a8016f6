"""Null ids, repeated rows and texts of a megabyte and more through the operators and the stages of the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

llm = pytest.importorskip("peptide_context.llm")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 999)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    long = "\n".join(words(rng, 40) for _ in range(4_000))  # 1.4 MB in lines
    one = words(rng, 180_000).replace(" ", "-")  # 1.6 MB without a blank or a line feed
    found = [(i, words(rng, 30), "en", "s", None) for i in range(20)]
    found += [(None, words(rng, 25), "en", None, None), (None, words(rng, 25), None, "t", None), (None, None, None, None, None)]
    found += [(50, "alpha1 beta2 gamma3 delta4 epsilon5 zeta6 eta7 theta8", "en", "s", None)] * 2 + [(60, long, "en", "s", None), (61, one, "en", "t", None), (62, long[: len(long) // 2], "en", "s", None)]
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def test_line_dedup(docs, rows):
    from peptide_context.llm.line_dedup import dedup_lines

    got = dedup_lines(docs)
    assert got.count() == len(rows)
    kept = {r["doc_id"]: r for r in got.where("doc_id >= 60").collect()}
    assert kept[60]["text"] == rows[-3][1] and kept[61]["text"] == rows[-2][1]
    gone = rows[-1][1].split("\n")
    assert kept[62]["n_dropped"] >= len(gone) - 1 and len(kept[62]["text"]) <= len(gone[-1])
    assert got.where("doc_id is null").count() == 3 and got.where("doc_id = 50").select("text").distinct().count() == 1


def test_mixing(docs, rows):
    from peptide_context.llm.mixing import mix

    got = mix(docs).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 3
    assert {r["size"] for r in got if r["doc_id"] == 60} == {160_000} and {r["size"] for r in got if r["doc_id"] == 61} == {1}
    again = mix(docs.repartition(7)).collect()  # seeded ties: reruns and other partitions agree
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and all(r["taken"] <= 3 * r["size"] for r in got)


def test_ties_in_mixing(spark):
    from peptide_context.llm.mixing import mix

    same = spark.createDataFrame([(i, "two words", f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    a, b = ({(r["doc_id"], r["taken"]) for r in mix(same.repartition(n)).collect()} for n in (2, 5))
    assert a == b and len(a) == 300 and {t for _, t in a} <= {0, 2, 4, 6}


def test_language_identification(docs, rows):
    from peptide_context.llm.langid import identify

    got = identify(docs).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} <= {"en", "und"}
    assert all(not r["held_out"] for r in got if r["doc_id"] is None) and {r["lang_pred"] for r in got if r["doc_id"] in (60, 61)} == {"en"}
    assert len({tuple(r) for r in got if r["doc_id"] == 50}) == 1


def test_licences(spark):
    from peptide_context.llm.licenses import KNOWN, canonical, canonical_digest, known_digests, long_licences, scan, scan_lines

    text = KNOWN[0][1]
    rows = [(None, text), (1, text), (1, text), (2, text + " x" * 700_000), (3, "licence licence a"), (4, "no line\nReleased under the MIT License.\n\nReleased under the MIT license"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = scan(df, known_digests(spark)).collect()
    assert sorted((r["doc_id"] or 0, r["license_id"] or "") for r in got) == [(0, "MIT"), (1, "MIT"), (1, "MIT"), (2, ""), (3, ""), (4, ""), (5, "")]
    assert spark.range(1).select(canonical(F.lit("Licence licence LICENCE a"))).first()[0] == "license license license a"
    assert sorted(tuple(r) for r in scan_lines(df, known_digests(spark)).where("doc_id = 4").collect()) == [(4, 2, "MIT"), (4, 4, "MIT")]
    every = KNOWN + long_licences()
    made = [r[0] for r in spark.createDataFrame(list(enumerate(t for _, t in every)), "i int, t string").orderBy("i").select(F.md5(canonical(F.col("t")))).collect()]
    assert made == [canonical_digest(t) for _, t in every]


def test_warc(spark):
    from peptide_context.llm.warc import round_trip

    rng = random.Random(4)
    page, huge = words(rng, 300), words(rng, 200_000)
    rows = [(None, "u", page), (None, "u", page), (5, "u", page), (5, "u", page), (9, "v", page), (7, "w", huge), (8, None, huge), (3, "x", None)]
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    n, m = len(page), len(huge)
    assert got == sorted([(0, "response", None, n)] * 2 + [(5, "revisit", 9, n)] * 2 + [(9, "response", None, n), (8, "response", None, m), (7, "revisit", 8, m), (3, "response", None, 0)])


def test_vectors(spark):
    from peptide_context.llm.embedding_dedup import near_duplicates
    from peptide_context.llm.topk import search_table

    rng = random.Random(5)
    v = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = [(i, x, 1) for i, x in enumerate(v)] + [(None, v[0], 1), (3, v[3], 1), (3, v[4], 1), (100, v[5], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    a, b = ({tuple(r) for r in search_table(df.repartition(n)).collect()} for n in (1, 4))
    assert a == b and {r[0] for r in a} == {0, 100} and all(r[2] is not None for r in a)
    got = near_duplicates(df).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got if r["vec_id"] in (5, 100)} == {5}


def test_recall_just_above_the_threshold(spark):
    import numpy as np

    from peptide_context.llm.embedding_dedup import near_duplicates

    rng = np.random.default_rng(8)
    for dim in (16, 64):
        x = rng.normal(size=(300, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.normal(size=(300, dim))
        y -= (y * x).sum(axis=1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        near = 0.9805 * x + np.sqrt(1 - 0.9805**2) * y
        rows = [(2 * i, a.tolist(), 0) for i, a in enumerate(x)] + [(2 * i + 1, b.tolist(), 0) for i, b in enumerate(near)]
        got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
        linked = got.where("n_links > 0").count()
        assert 0.9 * 600 <= linked <= 600, (dim, linked)


def test_stages(spark, docs, rows):
    import corpus_pipeline as P

    kept = P.language_id(spark, docs, "")
    assert kept.count() == len(rows) - 1  # the null text alone has no letter
    lines = P.line_dedup(spark, kept, "")
    assert lines.columns == docs.columns and lines.count() == len(rows) - 1
    near = P.near_duplicates(spark, kept, "")
    assert near.where("doc_id = 50").count() == 1 and near.where("doc_id is null").count() == 2 and near.where("doc_id in (60, 61)").count() == 2
    mixed = P.mixing(spark, near, "")
    assert mixed.columns == docs.columns
    packed = P.packing(spark, kept.where("doc_id >= 50"), "")
    assert packed.where("doc_id = 50").count() == 2 and packed.where("doc_id = 60").agg(F.sum("length") == F.max("doc_tokens")).first()[0]
