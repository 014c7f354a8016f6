"""Logistic regression on window features from the windows' letters alone, by Newton's method.

Every window feature is a sum over the window's places of a number that place and letter settle (the indicators, shares and
flags of ``cleavage.window_features`` alike). So a model is a table of a number a place and letter, a row's score is a sum of
eight look-ups, and gradient and curvature follow from how much weight each letter, and each pair of letters, has at its places:
nothing as wide as the 165 features is kept or read for a row. Each step is one pass over the windows for all models together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import AMINO_ACIDS, FLANK, HYDROPATHY

WIDTH = 2 * FLANK
LETTERS = len(AMINO_ACIDS) + 1  # the last one stands for all others, which have no feature
PAIRS = [(i, j) for i in range(WIDTH) for j in range(i)]
STEPS = 60


def feature_table() -> np.ndarray:
    """What each letter at each place adds to each of the features of ``cleavage.window_features``: (place and letter, feature)."""
    table = np.zeros((WIDTH, LETTERS, WIDTH * len(AMINO_ACIDS) + 5))
    p1 = WIDTH // 2 - 1
    for i in range(WIDTH):
        for k, aa in enumerate(AMINO_ACIDS):
            table[i, k, i * len(AMINO_ACIDS) + k] = 1.0
            rest = [(aa in "KR") / WIDTH, HYDROPATHY[aa] / WIDTH, i == p1 and aa in "KR", i == p1 and aa in "AGSCT", i == p1 + 1 and aa in "FWY"]
            table[i, k, -5:] = rest
    return table.reshape(WIDTH * LETTERS, -1)


def whole(rows: DataFrame) -> bool:
    """Whether every window has ``WIDTH`` letters, all of them ASCII."""
    odd = F.col("window").isNull() | (F.length("window") != WIDTH) | (F.octet_length("window") != WIDTH)
    return not rows.where(odd).limit(1).count()


def _codes(windows: pa.Array) -> np.ndarray:
    """Letters' numbers, a row a place."""
    number = np.full(256, LETTERS - 1, np.int64)
    number[np.frombuffer(AMINO_ACIDS.encode(), np.uint8)] = np.arange(len(AMINO_ACIDS))
    text = b"".join(windows.cast(pa.binary()).to_pylist())
    return np.ascontiguousarray(number[np.frombuffer(text, np.uint8)].reshape(-1, WIDTH).T)


def _margins(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table``: the intercept, then a number a place and letter."""
    total = np.full(codes.shape[1], table[0])
    for i, c in enumerate(codes):
        total += table[1 + i * LETTERS : 1 + (i + 1) * LETTERS][c]
    return total


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))


def _weights(codes: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of weights, by place and letter, and by pairs of places and letters."""
    one = [np.bincount(c, w, LETTERS) for c in codes]
    two = [np.bincount(codes[i] * LETTERS + codes[j], w, LETTERS * LETTERS) for i, j in PAIRS]
    return np.concatenate([[w.sum()], *one, *two])


def _moments(sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(sum of weights, of weight * x, of weight * x * x') over the features x, from ``_weights``."""
    a, n = feature_table(), WIDTH * LETTERS
    one, two = sums[1 : 1 + n], sums[1 + n :].reshape(len(PAIRS), LETTERS, LETTERS)
    full = np.diag(one)
    for (i, j), t in zip(PAIRS, two, strict=True):
        full[i * LETTERS : (i + 1) * LETTERS, j * LETTERS : (j + 1) * LETTERS] = t
        full[j * LETTERS : (j + 1) * LETTERS, i * LETTERS : (i + 1) * LETTERS] = t.T
    return float(sums[0]), a.T @ one, a.T @ full @ a


def _summed(rows: DataFrame, add: Callable[[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]], None]) -> dict[int, np.ndarray]:
    """What ``add(codes, labels, folds, found)`` puts into ``found`` over all rows (window, label, fold), each key's arrays summed.

    A task gives an array a key, however many rows it has, and a key's arrays are put together in one task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                add(_codes(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy(), found)
        if found:
            yield pa.record_batch([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["key", "sums"])

    def together(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in part["sums"].to_pylist())
        return pa.table([part["key"].combine_chunks()[:1], pa.array([total.tobytes()], pa.binary())], ["key", "sums"])

    some = rows.select("window", F.col("label").cast("int"), F.col("fold").cast("int"))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    some = some.coalesce(cores) if some.rdd.getNumPartitions() > cores else some
    parts = some.mapInArrow(work, "key int, sums binary").groupBy("key").applyInArrow(together, "key int, sums binary")
    return {r["key"]: np.frombuffer(bytes(r["sums"])) for r in parts.collect()}


class WindowFits:
    """Class-weighted L2 logistic regressions, as ``ml.classifier`` fits them, on the windows of a written table (window, label, fold)."""

    def __init__(self, rows: DataFrame, l2: float = 1.0):
        self.rows, self.l2 = rows, l2

        def add(codes, labels, folds, found):
            for key in np.unique(folds * 2 + (labels == 1)).tolist():
                w = (folds * 2 + (labels == 1) == key).astype(np.float64)
                found[key] = found.get(key, 0.0) + _weights(codes, w)

        self.sums = _summed(rows, add)
        self.sizes = {divmod(key, 2): int(s[0]) for key, s in self.sums.items()}
        self.k = 1 + max((f for f, _ in self.sizes), default=0)

    def counts(self, without: int | None = None) -> dict[int, int]:
        out: dict[int, int] = {}
        for (fold, label), n in self.sizes.items():
            if fold != without:
                out[label] = out.get(label, 0) + n
        return out

    def _weights_of(self, without: int | None) -> dict[int, float]:
        counts = self.counts(without)
        return {c: sum(counts.values()) / (2 * k) for c, k in counts.items()}

    def _variance(self, without: int | None) -> np.ndarray:
        """Sample variance of the features under the classes' weights, as pyspark.ml's summary has it; 0 where they are all the same."""
        weight, counts = self._weights_of(without), self.counts(without)
        total, x, xx = _moments(sum(weight[key % 2] * s for key, s in self.sums.items() if key // 2 != without))
        squares = np.diag(xx)
        v = (squares - x * x / total) / (total - sum(weight[c] ** 2 * n for c, n in counts.items()) / total)
        return np.where(v * total > 1e-10 * squares, v, 0.0)

    def fit(self, wanted: list[int | None], tol: float = 1e-10) -> list[tuple[float, np.ndarray] | None]:
        """(intercept, coefficients) on all rows but those of a fold (null: all rows), for each fold wanted; null with one class.

        Newton's steps, halved where one does not lessen the loss, until no component of the gradient is more than ``tol`` of the rows.
        """
        a = feature_table()
        open_ = {m: without for m, without in enumerate(wanted) if len(self.counts(without)) == 2}
        now = {m: np.zeros(a.shape[1] + 1) for m in open_}
        weight = {m: self._weights_of(without) for m, without in open_.items()}
        variance = {m: self._variance(without) for m, without in open_.items()}
        best = {m: (np.inf, now[m], None) for m in open_}  # loss, point, step from there
        for _ in range(STEPS):
            if not open_:
                break
            tables = {m: (without, np.concatenate([now[m][:1], a @ now[m][1:]]), weight[m]) for m, without in open_.items()}

            def add(codes, labels, folds, found, tables=tables):
                for m, (without, table, w) in tables.items():
                    used = folds != without if without is not None else np.ones(len(folds), bool)
                    c, y = codes[:, used], (labels[used] == 1).astype(np.float64)
                    margin = _margins(c, table)
                    p, each = _probability(margin), np.where(y > 0, w[1], w[0])
                    r = each * (p - y)
                    slope = [np.bincount(x, r, LETTERS) for x in c]
                    loss = (each * np.logaddexp(0.0, np.where(y > 0, -margin, margin))).sum()
                    found[m] = found.get(m, 0.0) + np.concatenate([[loss, r.sum()], *slope, _weights(c, each * p * (1.0 - p))])

            for m, sums in _summed(self.rows, add).items():
                b, v, n = now[m], variance[m], sum(self.counts(open_[m]).values())
                loss = sums[0] + 0.5 * self.l2 * (v * b[1:] ** 2).sum()
                top, point, step = best[m]
                if loss > top + 1e-12 * abs(top) and np.abs(step).max() > 1e-14:
                    best[m] = (top, point, step / 2)
                    now[m] = point + step / 2
                    continue
                slope = np.concatenate([sums[1:2], a.T @ sums[2 : 2 + len(a)] + self.l2 * v * b[1:]])
                used = np.concatenate([[True], v > 0])
                if np.abs(slope[used]).max() <= tol * n:
                    del open_[m]
                    continue
                h, hx, hxx = _moments(sums[2 + len(a) :])
                curve = np.block([[np.array([[h]]), hx[None, :]], [hx[:, None], hxx + np.diag(self.l2 * v)]])[np.ix_(used, used)]
                step = np.zeros(len(b))
                step[used] = -np.linalg.solve(curve, slope[used])
                best[m], now[m] = (loss, b, step), b + step
        if open_:
            raise RuntimeError(f"the fit did not settle in {STEPS} steps")
        return [(float(now[m][0]), now[m][1:]) if m in now else None for m in range(len(wanted))]

    def held_out(self, models: list[tuple[float, np.ndarray] | None]) -> DataFrame:
        """(fold, label, score) of all rows, each by the model of its fold; null scores where there is none."""
        tables = [None if m is None else np.concatenate([[m[0]], feature_table() @ m[1]]) for m in models]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, folds = _codes(batch.column(0)), batch.column(2).to_numpy()
                score = np.full(len(folds), np.nan)
                for fold, table in enumerate(tables):
                    if table is not None and (folds == fold).any():
                        score[folds == fold] = _probability(_margins(codes[:, folds == fold], table))
                yield pa.record_batch([batch.column(2), batch.column(1), pa.array(score, mask=np.isnan(score))], ["fold", "label", "score"])

        return self.rows.select("window", F.col("label").cast("int"), F.col("fold").cast("int")).mapInArrow(work, "fold int, label int, score double")

    def optimum(self, model: tuple[float, np.ndarray]) -> list[float]:
        """The moments of ``ml.optimum`` for a model of all rows: that of the intercept, then those of the features."""
        weight, variance, a = self._weights_of(None), self._variance(None), feature_table()
        table = np.concatenate([[model[0]], a @ model[1]])

        def add(codes, labels, folds, found):
            p = np.where(labels == 1, weight[1], weight[0]) * _probability(_margins(codes, table))
            found[0] = found.get(0, 0.0) + np.concatenate([[p.sum()], *[np.bincount(c, p, LETTERS) for c in codes]])

        sums, half = _summed(self.rows, add)[0], sum(self.counts().values()) / 2
        return [sums[0] / half, *((a.T @ sums[1:] + self.l2 * variance * model[1]) / half).tolist()]


def classifier_of(rows: DataFrame, model: tuple[float, np.ndarray]):
    """A model of ``WindowFits`` as a pyspark.ml model on the features of ``cleavage.window_features``."""
    from pyspark.ml.classification import LogisticRegressionModel

    jvm, gateway = rows.sparkSession.sparkContext._jvm, rows.sparkSession.sparkContext._gateway
    values = gateway.new_array(jvm.double, len(model[1]))
    for i, x in enumerate(model[1].tolist()):
        values[i] = x
    vector = jvm.org.apache.spark.ml.linalg.DenseVector(values)
    ml = jvm.org.apache.spark.ml.classification
    uid = f"LogisticRegression_{abs(hash(tuple(model[1].tolist()))):x}"
    return LogisticRegressionModel._from_java(ml.LogisticRegressionModel(uid, vector, model[0]))
