"""Language identification where labels are absent or few."""

import random

import pytest

langid = pytest.importorskip("peptide_context.llm.langid")
SYLLABLES = {"aa": "ka to mi ra su ne".split(), "bb": "schl ung ber eich ter".split(), "cc": "wyx yv xow vyw".split()}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_no_labels(spark):
    import corpus_pipeline

    rng = random.Random(1)
    rows = [(i, text(rng, "aa"), None) for i in range(5)] + [(8, None, None), (9, "12 !?", None)]
    got = corpus_pipeline.language_id(spark, frame(spark, rows), "").collect()
    assert {r["doc_id"] for r in got} == set(range(5))


def test_rare_language(spark):
    rng = random.Random(2)
    common = [(i, text(rng, "aa" if i % 2 else "bb"), "aa" if i % 2 else "bb") for i in range(120)]
    junk = (999, "qxzj \u0436\u0449 wqpx zzxq jjqw " * 30, None)
    for k in range(6):  # wherever the hash of the one text falls; many copies do not crowd it out
        rare = text(rng, "cc")
        rows = frame(spark, [*common, *[(500 + i, rare, "cc") for i in range(40)], junk])
        model = langid.fit(rows.select("lang", "text"), per_language=150 if k else 4)
        assert "cc" in model.langs and (model.limit < 30).all()
        got = {r["doc_id"]: r for r in langid.classify(rows.where("doc_id >= 500"), model).collect()}
        assert got[500]["lang_pred"] == "cc" and got[500]["accepted"] and not got[999]["accepted"]


def test_only_rare_languages(spark):
    rng = random.Random(3)
    rows = frame(spark, [(1, text(rng, "aa"), "aa"), (2, text(rng, "bb"), "bb"), (3, "\u0436\u0449\u044d " * 90, None)])
    model = langid.fit(rows.select("lang", "text"))
    got = {r["doc_id"]: (r["lang_pred"], r["accepted"]) for r in langid.classify(rows, model).collect()}
    assert got[1] == ("aa", True) and got[2] == ("bb", True) and not got[3][1]
