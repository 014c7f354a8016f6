"""Lines too short for the deletion neighbourhood."""

import pytest

line_dedup = pytest.importorskip("peptide_context.llm.line_dedup")


def test_short_lines(spark):
    import corpus_pipeline

    rows = [(1, "yes\n\nno\n  \nyes"), (2, "no\nyet\n\nown\n  "), (3, "yes\nno"), (4, None), (5, "this line is repeated word for word\nYes"), (6, "this line is repeated word for ward\nYes")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {1: "yes\n\nno\n  ", 2: "yet\n\nown\n  ", 3: "", 4: None, 5: rows[4][1], 6: ""}
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, short=True).collect()} == want
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, df, "").collect()} == want
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(df, short=False).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1}
