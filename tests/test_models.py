"""Fitted models: the certificate of an optimum, forests as tables, fits side by side, the metrics of the cut model."""

import random

import pytest
from pyspark.sql import functions as F

from peptide_context.operators import ml
from peptide_context.operators.components import materialize
from peptide_context.operators.forest import NODES, forest_nodes, off_grid, score_forest

COLS = ["a", "b", "c", "flat"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    data = []
    for i in range(300):
        label = int(rng.random() < 0.3)
        data.append((f"r{i}", label, rng.gauss(label, 1.0), 100 * rng.random(), float(rng.random() < 0.2 + 0.3 * label), 7.0))
    return materialize(spark.createDataFrame(data, "id string, label int, a double, b double, c double, flat double"))


def test_optimum_of_a_fit(rows):
    model = ml.fit(rows, COLS, "logreg", tol=1e-12)
    found = {r["term"]: r["moment"] for r in ml.optimum(model, rows, COLS).collect()}
    means = rows.where("label = 1").agg(*[F.avg(c).alias(c) for c in COLS]).first()
    assert found["intercept"] == pytest.approx(1.0, abs=1e-6)
    for c in COLS:
        assert found[c] == pytest.approx(means[c], abs=1e-5 * max(1.0, abs(means[c])))
    other = ml.fit(rows, COLS, "logreg", l2=100.0, tol=1e-12)  # not where the gradient for l2 = 1 is 0
    wrong = {r["term"]: r["moment"] for r in ml.optimum(other, rows, COLS).collect()}
    assert abs(wrong["a"] - means["a"]) > 1e-2


def test_forest_as_a_table(spark, rows):
    model = ml.fit(rows, COLS, "rf", trees=9)
    nodes = materialize(forest_nodes(model, COLS))
    assert nodes.select("tree").distinct().count() == 9 and nodes.schema.simpleString() == spark.createDataFrame([], NODES).schema.simpleString()
    want = {r["id"]: r["score"] for r in ml.scored(model, rows, COLS).collect()}
    got = {r["id"]: r["score"] for r in score_forest(rows, nodes).collect()}
    assert got == pytest.approx(want)
    moved = {r["id"]: r["score"] for r in score_forest(rows.withColumns({c: F.round(c, 2) for c in COLS}), off_grid(nodes, 2)).collect()}
    assert moved == pytest.approx({r["id"]: r["score"] for r in score_forest(rows, off_grid(nodes, 2)).collect()})
    leaf = spark.createDataFrame([(0, 0, None, None, None, None, 0.25), (3, 0, None, None, None, None, 0.75)], NODES)
    assert {r["score"] for r in score_forest(rows, leaf).collect()} == {0.5}
    with pytest.raises(ValueError, match="without nodes"):
        score_forest(rows, leaf.where("false"))


def test_fits_side_by_side(rows):
    folds = ml.Folds(rows, COLS, 3, 0)
    one = [folds.fit(COLS, "logreg", 0, 0, without=i).coefficients.toArray().tolist() for i in range(3)]
    many = [m.coefficients.toArray().tolist() for m in folds.fit_all([(COLS, i) for i in range(3)], "logreg", 0, 0, at_once=3)]
    assert many == [pytest.approx(x, abs=1e-9) for x in one]
    with pytest.raises(ValueError):
        folds.fit_all([(["absent"], None)], "logreg", 0, 0)
    value = folds.cv_auc({"all": COLS, "flat": ["flat"]}, "logreg", 0, 0)
    assert value["all"] > 0.65 and value["flat"] == pytest.approx(0.5)


def test_cut_model_metrics(spark):
    rng = random.Random(3)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    pos = [(f"p{i}", "".join(rng.choice(letters) for _ in range(2)) + "KR" + "".join(rng.choice(letters) for _ in range(4))) for i in range(40)]
    neg = [(f"n{i}", "".join(rng.choice(letters) for _ in range(8))) for i in range(80)]
    p, n = (spark.createDataFrame(x, "id string, window string") for x in (pos, neg))
    pwm = spark.createDataFrame([(3, "K", 2.0), (4, "R", 2.0)], "pos int, aa string, logodds double")
    model, metrics = ml.cut_model(p, n, folds=2, pwm=pwm)
    found = {r["metric"]: r["value"] for r in metrics.collect()}
    score = lambda w: 2.0 * (w[2] == "K") + 2.0 * (w[3] == "R")
    wins = [(score(a) > score(b)) + 0.5 * (score(a) == score(b)) for _, a in pos for _, b in neg]
    assert found["pwm_auc"] == pytest.approx(sum(wins) / len(wins)) and found["n_positives"] == 40 and found["ml_cv_auc"] > 0.9 and model is not None
    assert {r["metric"]: r["value"] for r in ml.cut_model(p.limit(2), n.limit(2))[1].collect()}["pwm_auc"] is None
