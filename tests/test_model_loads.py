"""Loads of an embedding model in a session whose earlier stages left more Python workers idle than there are cores."""

import os
import uuid

import numpy as np

from peptide_context.operators import embed as E


def counting(folder):
    def load():
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return lambda seqs: np.array([[len(q), q.count("K")] for q in seqs], float)

    return load


def test_idle_workers_do_not_load_it_again(spark, tmp_path):
    busy = spark.range(400, numPartitions=8)
    for _ in range(4):  # each step of a stage has a worker of its own
        busy = busy.mapInArrow(lambda batches: batches, "id long")
    assert busy.count() == 400
    rows = [(i, "K" * (i % 7) + "A" * (i % 11)) for i in range(200)] + [(200, None), (201, ""), (7, "KK")]
    df = spark.createDataFrame(rows, "id long, seq string").repartition(40)
    want = sorted((i, [float(len(s or "")), float((s or "").count("K"))]) for i, s in rows)
    for tasks, most in ((None, spark.sparkContext.defaultParallelism), (2, 2), (100, 40)):
        folder = tmp_path / str(tasks)
        folder.mkdir()
        got = E.embed(df, factory=counting(str(folder)), tasks=tasks) if tasks else E.embed(df, factory=counting(str(folder)))
        assert sorted((r["id"], r["vec"]) for r in got.collect()) == want
        assert 1 <= len(os.listdir(folder)) <= most
    plain = E.embed(df, counting(str(tmp_path))())
    assert plain.rdd.getNumPartitions() == 40 and sorted((r["id"], r["vec"]) for r in plain.collect()) == want


def test_executors_that_come_and_go_keep_all_tasks(spark, monkeypatch):
    df = spark.range(40, numPartitions=40).selectExpr("id", "'K' AS seq")
    own = spark.sparkContext.getConf()
    own.set("spark.dynamicAllocation.enabled", "true")
    monkeypatch.setattr(spark.sparkContext, "getConf", lambda: own)
    assert E.embed(df, factory=lambda: len).rdd.getNumPartitions() == 40
