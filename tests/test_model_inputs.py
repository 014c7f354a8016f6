"""What the registered model queries learn from."""

import pytest

from peptide_context.jobs import adapters as A
from peptide_context.jobs import queries as Q
from peptide_context.operators import ml as L


def test_labelled_sequences_are_whole(spark, monkeypatch):
    seq = "A" * 40 + "KRDEWYHF" * 30
    proteins = spark.createDataFrame([("P1", seq, 1), ("P2", seq[:50], 2)], "id string, seq string, n long")
    tables = {
        "labels": spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"),
        "embeddings": spark.createDataFrame([(1, [1.0] * 64)], "vec_id long, embedding array<float>"),
    }
    regions = spark.createDataFrame([("x", "P1", 41, 280), ("y", "P2", 0, 0)], "peptide_id string, precursor_id string, pro_start int, pro_end int")
    monkeypatch.setattr(A, "proteins", lambda s, d: proteins)
    monkeypatch.setattr(A, "table", lambda s, d, name: tables[name])
    monkeypatch.setattr(Q, "_regions", lambda s, d: regions)
    got = {r["id"]: r for r in Q._labelled(spark, "").collect()}
    assert got["P1"]["m1_len"] == len(seq) and got["P2"]["m1_len"] == 50
    assert got["P1"]["m2pro_len"] == 240 and got["P2"]["m2pro_len"] == 0 and got["P1"]["m6p_63"] == 1.0


@pytest.mark.parametrize("name,call", [("ablation", "ablation"), ("train_models", "train_models"), ("random_forest", "fit")])
def test_registered_defaults(monkeypatch, name, call):
    class Rows:
        columns = ["id", "label", "m1_len"]

    class Stop(Exception):
        pass

    def seen(*args, **kw):
        assert not kw
        raise Stop

    monkeypatch.setattr(Q, "_labelled", lambda s, d: Rows)
    monkeypatch.setattr(L, call, seen)
    with pytest.raises(Stop):
        getattr(Q, name)(None, "")
