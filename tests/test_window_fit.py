"""The cut model fitted from letters, against the same regression on the 165 columns."""

import random

import pytest
from pyspark.sql import functions as F

from peptide_context.operators import cleavage as C
from peptide_context.operators import ml
from peptide_context.operators import window_fit as W


@pytest.fixture(scope="module")
def windows(spark):
    rng = random.Random(5)
    draw = lambda n, letters="ACDEFGHIKLMNPQRSTVX": "".join(rng.choice(letters) for _ in range(n))
    pos = [(f"p{i}", draw(2) + draw(2, "KRA") + draw(4)) for i in range(60)]
    neg = [(f"n{i}", draw(8)) for i in range(150)]  # W and Y are nowhere: columns without variance
    return tuple(spark.createDataFrame(x, "id string, window string").localCheckpoint() for x in (pos, neg))


def test_same_optimum_as_on_columns(windows):
    rows, cols = ml.window_rows(*windows)
    want, got = ml.fit(rows, cols, "logreg", tol=1e-12), ml.fit_cut_model(*windows)
    assert got.coefficients.toArray().tolist() == pytest.approx(want.coefficients.toArray().tolist(), abs=1e-4)
    assert got.intercept == pytest.approx(want.intercept, abs=1e-4)
    assert any(x == 0 for x in got.coefficients.toArray())
    own = {r["term"]: r["moment"] for r in ml.cut_model_optimum(*windows).collect()}
    by_model = {r["term"]: r["moment"] for r in ml.optimum(got, rows, cols).collect()}
    assert own == pytest.approx(by_model, abs=1e-9)
    means = rows.where("label = 1").agg(*[F.avg(c).alias(c) for c in cols]).first()
    assert [own[c] for c in cols] == pytest.approx(list(means), abs=1e-8)


def test_folds_are_scored_by_models_without_them(windows):
    metrics = {r["metric"]: r["value"] for r in ml.cut_model(*windows, folds=2)[1].collect()}
    rows, cols = ml.window_rows(*windows)
    assert metrics["ml_cv_auc"] == pytest.approx(ml.Folds(rows, cols, 2, 0).cv_auc({"w": cols}, "logreg", 0, 0)["w"], abs=2e-3)


def test_sites_are_scored_where_they_are_found(spark, windows):
    model = ml.fit_cut_model(*windows)
    proteins = spark.createDataFrame([("P1", "MKRAXWGGKRDEAAKRLLKKRSTVWYFKRAB"), ("P2", "KRK"), ("P3", "éKRKRDDKKRRAA"), ("P4", None)], "id string, seq string")
    sites = C.scan_cleavage(proteins)
    pwm = spark.createDataFrame([(i, a, 0.1 * i - 0.7 * (a == "K")) for i in range(1, 9) for a in "KRDW"], "pos int, aa string, logodds double")
    for source, want in ((model, C.score_sites_model(sites, model)), (pwm, C.score_sites(sites, pwm))):
        rows = [{tuple(r)[:3]: r["score"] for r in df.select("precursor_id", "motif_ord", "bond", "score").collect()} for df in (C.scan_scored_sites(proteins, source), want)]
        assert len(rows[0]) == sites.count() and rows[0] == pytest.approx(rows[1], abs=1e-12)


def test_windows_of_other_lengths_are_still_fitted(spark, windows):
    pos, neg = windows
    odd = neg.union(spark.createDataFrame([("short", "KR")], "id string, window string"))
    assert not W.whole(odd) and ml.fit_cut_model(pos, odd) is not None and ml.fit_cut_model(pos.limit(3), neg.limit(3)) is None


def test_a_table_as_wide_as_the_features_is_not_written(windows, monkeypatch):
    written = []
    monkeypatch.setattr(ml, "materialize", lambda df, f=ml.materialize: written.append(len(df.columns)) or f(df))
    ml.cut_model_optimum(*windows)
    ml.fit_cut_model(*windows)
    assert max(written) < 10  # before, 165 doubles a window
