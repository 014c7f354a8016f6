"""Folds, standardisation, classifiers, AUC, ablation and scoring of peptides, on pyspark.ml."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import seeded_rank_key
from .components import materialize
from .dataset import LEVELS, cumulative_columns, method_features
from .forest import score_forest
from .window_fit import WindowFits, classifier_of, whole

AT_ONCE = 4  # fits of a cross-validation that run side by side


def auc(scored: DataFrame, score: str = "score", label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """A row (n_pos, n_neg, auc) for each value of the columns ``by``, or one in all: the Mann-Whitney area with ties
    counted half; null if a class is empty.

    Rows are first counted by distinct score; negatives below a score are a running sum, taken in two levels: ranges
    of scores by an approximate cut into parts, then inside each part, so no task sees all scores.
    """
    by = list(by)
    pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p")
    neg = F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n")
    each = scored.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(pos, neg)
    cuts = each.groupBy(*by).agg(F.percentile_approx("s", [i / 64 for i in range(1, 64)], 1000).alias("cuts"))
    part = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda c: c < F.col("s")))
    each = each.join(F.broadcast(cuts), by or None).withColumn("part", part).drop("cuts")
    parts = each.groupBy(*by, "part").agg(F.sum("n").alias("n_part"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*by, "part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = each.withColumn("below", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(parts), [*by, "part"])
    wins = F.sum(F.col("p") * (F.col("base") + F.col("below") + F.col("n") * 0.5))
    total = ranked.groupBy(*by).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_neg"), wins.alias("wins"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return total.select(*by, "n_pos", "n_neg", F.when(both, F.col("wins") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def cv_folds(df: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """Adds ``fold``: rows of each label are dealt in turn, in the order of the MD5 of (id, seed).

    k is at most the size of the smaller class. Ranks run in parts of the digest, so a label is no single task.
    """
    sizes = df.groupBy("label").agg(F.count("*").alias("c")).agg(F.min("c").alias("least"), F.count("*").alias("labels"))
    sizes = sizes.select(F.greatest(F.least(F.lit(k), F.when(F.col("labels") > 1, F.col("least")).otherwise(0)), F.lit(1)).alias("_k"))
    rows = df.withColumn("_h", seeded_rank_key(F.col("id"), F.lit(seed))).withColumn("_p", F.substring("_h", 1, 2))
    counts = rows.groupBy("label", "_p").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("label").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("label", "_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("label", "_p").orderBy("_h")) - 1 + F.col("_base")
    rows = rows.join(counts, ["label", "_p"]).join(F.broadcast(sizes))
    return rows.withColumn("fold", (rank % F.col("_k")).cast("int")).select(*df.columns, "fold")


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns less their mean, over their sample deviation; a deviation of 0 counts as 1."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"_s_{c}") for c in cols])
    rows = df.join(F.broadcast(stats))
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 1e-12, F.col(f"_s_{c}")).otherwise(1.0) for c in cols}
    return rows.withColumns(scaled).select(*df.columns)


def vectors(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.array(*[F.col(c).cast("double") for c in cols])))


def classifier(rows: DataFrame, counts: dict[int, int], kind: str, seed: int, trees: int, l2: float, tol: float = 1e-6):
    """Fits rows (features, label); a row weighs n / (2 * size of its class)."""
    n = sum(counts.values())
    data = rows.select("features", F.col("label").cast("double").alias("label"), class_weights(counts).alias("weight"))
    if kind == "rf":
        return RandomForestClassifier(numTrees=trees, weightCol="weight", seed=seed, maxMemoryInMB=1024).fit(data)
    return LogisticRegression(weightCol="weight", regParam=l2 / max(1, n), maxIter=100 if tol >= 1e-6 else 1000, tol=tol).fit(data)


def class_weights(counts: dict[int, int], label: str = "label") -> Column:
    """n / (2 * size of its class) for each row."""
    n = sum(counts.values())
    return F.element_at(F.create_map(*[F.lit(float(x)) for c, k in counts.items() for x in (c, n / (2 * k))]), F.col(label).cast("double"))


def optimum(model, df: DataFrame, cols: list[str], l2: float = 1.0) -> DataFrame:
    """(term, moment): a certificate that a logistic regression of ``fit`` on (label, cols) is at its optimum.

    There the gradient is 0, which says for every column: the weighted sum of p * x over all rows, and l2 * variance *
    coefficient, are together the weighted sum of x over the positives. Both sides are divided by the positives' weights, so that
    ``moment`` is the positives' mean of the column, and 1 for the intercept, if and only if the fit has settled. The left side is
    computed here, from the model; the right side needs the data alone. One aggregate over the rows.
    """
    from pyspark.ml.stat import Summarizer

    data = vectors(df, cols).select("features", "label")
    counts = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
    data = model.transform(data.withColumn("weight", class_weights(counts)))
    p = F.col("weight") * vector_to_array("probability")[1]
    x = vector_to_array("features")
    sums = data.agg(Summarizer.metrics("variance").summary(F.col("features"), F.col("weight")).alias("s"), F.sum(p).alias("p"), *[F.sum(p * x[i]).alias(f"x{i}") for i in range(len(cols))]).first()
    half = sum(counts.values()) / 2
    values = [sums["p"] / half, *((sums[f"x{i}"] + l2 * v * b) / half for i, (v, b) in enumerate(zip(sums["s"]["variance"].toArray().tolist(), model.coefficients.toArray().tolist(), strict=True)))]
    return df.sparkSession.createDataFrame(list(zip(["intercept", *cols], map(float, values), strict=True)), "term string, moment double")


def fit(df: DataFrame, cols: list[str], kind: str = "rf", seed: int = 0, trees: int = 300, l2: float = 1.0, tol: float = 1e-6):
    """A class-weighted classifier on (label, cols): ``rf``, a forest, or ``logreg``, L2 logistic regression on
    standardised columns with a penalty of ``l2`` over the number of rows; its steps end where they gain less than ``tol``."""
    data = materialize(vectors(df, cols).select("features", "label"))
    return classifier(data, {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}, kind, seed, trees, l2, tol)


def scored(model, df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with the probability of class 1 as ``score``."""
    return model.transform(vectors(df, cols)).withColumn("score", vector_to_array("probability")[1]).select(*df.columns, "score")


class Folds:
    """A labelled table dealt into folds: its columns as one array a row, in a written table, and the sizes of classes."""

    def __init__(self, df: DataFrame, columns: list[str], k: int, seed: int):
        rows = cv_folds(df.select("id", "label", F.array(*[F.col(c).cast("double") for c in columns]).alias("v")), k, seed)
        rows = materialize(rows.select("label", "fold", "v"))
        self.columns, self.sizes = columns, {(r["fold"], r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()}
        few = max(1, sum(self.sizes.values()) // 20_000)
        self.rows = rows.coalesce(few) if rows.rdd.getNumPartitions() > few else rows
        self.k = 1 + max((f for f, _ in self.sizes), default=0)

    def counts(self, without: int | None = None) -> dict[int, int]:
        out: dict[int, int] = {}
        for (fold, label), n in self.sizes.items():
            if fold != without:
                out[label] = out.get(label, 0) + n
        return out

    def features(self, rows: DataFrame, cols: list[str]) -> DataFrame:
        places = [self.columns.index(c) for c in cols]
        whole = places == list(range(len(self.columns)))
        v = F.col("v") if whole else F.transform(F.array(*map(F.lit, places)), lambda i: F.get("v", i))
        return rows.select("label", "fold", array_to_vector(v).alias("features"))

    def fit(self, cols: list[str], kind: str, seed: int, trees: int, l2: float = 1.0, without: int | None = None):
        """A model on all rows, or all but one fold; null with one class."""
        counts = self.counts(without)
        if len(counts) < 2:
            return None
        rows = self.rows if without is None else self.rows.where(F.col("fold") != without)
        return classifier(self.features(rows, cols), counts, kind, seed, trees, l2)

    def fit_all(self, wanted: list[tuple], kind: str, seed: int, trees: int, at_once: int = AT_ONCE) -> list:
        """The models of (columns, fold left out or None), at most ``at_once`` of them being fitted at a time.

        A fit is many short jobs, one after the other, that leave most cores idle; jobs of several fits fill them. Where the session
        schedules fairly (spark.scheduler.mode FAIR) each thread has a pool of its own, so that none waits behind another.
        """
        from pyspark import InheritableThread

        found, left, failed = [None] * len(wanted), list(enumerate(wanted)), []
        context = self.rows.sparkSession.sparkContext

        def work(pool: int) -> None:
            context.setLocalProperty("spark.scheduler.pool", f"fit{pool}")
            while left and not failed:
                try:
                    at, (cols, without) = left.pop(0)
                except IndexError:  # another thread took the last one
                    return
                try:
                    found[at] = self.fit(cols, kind, seed, trees, without=without)
                except Exception as e:
                    failed.append(e)

        threads = [InheritableThread(target=work, args=(i,)) for i in range(min(at_once, len(wanted)))]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        if failed:
            raise failed[0]
        return found

    def cv_auc(self, sets: dict[str, list[str]], kind: str, seed: int, trees: int) -> dict[str, float | None]:
        """Mean AUC over the folds for each named set of columns; folds without both classes are left out. The models are fitted
        side by side; the held-out scores of all sets and folds are compared in one query."""
        wanted = [(name, cols, i) for name, cols in sets.items() for i in range(self.k if self.k > 1 else 0)]
        tests = []
        for (name, cols, i), model in zip(wanted, self.fit_all([(c, i) for _, c, i in wanted], kind, seed, trees), strict=True):
            if model is not None:
                test = model.transform(self.features(self.rows.where(F.col("fold") == i), cols))
                tests.append(test.select(F.lit(name).alias("name"), "fold", "label", vector_to_array("probability")[1].alias("score")))
        if not tests:
            return dict.fromkeys(sets)
        found = auc(materialize(reduce(DataFrame.union, tests)), by=("name", "fold")).where("auc is not null")
        means = {r["name"]: r["auc"] for r in found.groupBy("name").agg(F.avg("auc").alias("auc")).collect()}
        return {name: means.get(name) for name in sets}


def ablation(features: DataFrame, cv: int = 5, seed: int = 0, kind: str = "rf", trees: int = 300) -> DataFrame:
    """(level, method_set, n_features, cv_roc_auc, delta_vs_prev) for the cumulative feature sets M1 to M6."""
    columns = [c for c in features.columns if c not in ("id", "label")]
    sets = {level: cumulative_columns(columns, level) for level in LEVELS}
    values = Folds(features, columns, cv, seed).cv_auc(sets, kind, seed, trees)
    rows, prev = [], None
    for n, level in enumerate(LEVELS):
        value = values[level]
        delta = value - prev if value is not None and prev is not None else None
        rows.append((n + 1, level if n == 0 else f"M1..{level}", len(sets[level]), value, delta))
        prev = value
    return features.sparkSession.createDataFrame(rows, "level int, method_set string, n_features int, cv_roc_auc double, delta_vs_prev double")


def train_models(features: DataFrame, cv: int = 5, seed: int = 0, kind: str = "rf", trees: int = 300):
    """(model on M1 columns, model on all columns, metrics table): metrics are rows (metric, value)."""
    columns = [c for c in features.columns if c not in ("id", "label")]
    sets = {"m1": cumulative_columns(columns, "M1"), "full": cumulative_columns(columns, "M6")}
    folds = Folds(features, columns, cv, seed)
    a, b = folds.cv_auc(sets, kind, seed, trees).values()
    models, counts = folds.fit_all([(c, None) for c in sets.values()], kind, seed, trees), folds.counts()
    gain = b - a if a is not None and b is not None else None
    rows = [("n_positive", float(counts.get(1, 0))), ("n_negative", float(counts.get(0, 0))), ("auc_M1_peptide_only", a), ("auc_full", b), ("total_gain_auc", gain)]
    return *models, features.sparkSession.createDataFrame(rows, "metric string, value double")


def predict_peptides(seqs: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """(id, length, amp_probability, call) of sequences (id, seq) by a model on the M1 columns: a fitted one, or a forest
    as a table of nodes (``forest.NODES``)."""
    features = method_features(seqs.select("id", F.col("seq").alias("mature_seq"), F.length("seq").alias("length")), ("id", "length"))
    m1 = cumulative_columns(features.columns, "M1")
    p = F.round("score", 4)
    call = F.when(F.col("score") >= threshold, "AMP").otherwise("non-AMP")
    found = score_forest(features, model) if isinstance(model, DataFrame) else scored(model, features, m1)
    return found.select("id", "length", p.alias("amp_probability"), call.alias("call"))


def window_rows(positives: DataFrame, negatives: DataFrame) -> tuple[DataFrame, list[str]]:
    """((id, label, window, f0 to f164), those columns) of windows at bonds that are cut (id, window) and of others."""
    from .cleavage import window_features

    rows = positives.withColumn("label", F.lit(1)).unionByName(negatives.withColumn("label", F.lit(0)))
    rows = rows.withColumn("_f", window_features(F.col("window")))
    cols = [f"f{i}" for i in range(165)]
    return rows.select("id", "label", "window", *[F.col("_f")[i].alias(c) for i, c in enumerate(cols)]), cols


def cut_model(positives: DataFrame, negatives: DataFrame, folds: int = 5, least: int = 10, seed: int = 0, pwm: DataFrame | None = None):
    """(model or None, metrics): balanced logistic regression on window features, with mean AUC over folds.

    ``positives`` and ``negatives`` are rows (id, window). Fitted only with both classes and ``least`` rows. Metrics are rows
    (metric, value): n_positives, n_negatives, pwm_auc (of the scores by ``pwm`` on the same windows, null without it) and ml_cv_auc.
    """
    from .cleavage import pwm_scored

    both = _labelled_windows(positives, negatives)
    by_matrix = auc(pwm_scored(both.select("label", "window"), pwm, "window")).first()["auc"] if pwm is not None else None
    model, value = None, None
    if whole(both):
        data = WindowFits(materialize(cv_folds(both, folds, seed).select("window", "label", "fold")))
        counts = data.counts()
        if len(counts) == 2 and sum(counts.values()) >= least:
            out = list(range(data.k)) if data.k > 1 else []
            *held, found = data.fit([*out, None])
            if any(m is not None for m in held):
                value = auc(materialize(data.held_out(held)), by=("fold",)).agg(F.avg("auc").alias("auc")).first()["auc"]
            model = classifier_of(both, found)
    else:
        rows, cols = window_rows(positives, negatives)
        data = Folds(rows, cols, folds, seed)
        counts = data.counts()
        if len(counts) == 2 and sum(counts.values()) >= least:
            value = data.cv_auc({"windows": cols}, "logreg", seed, 0)["windows"]
            model = data.fit(cols, "logreg", seed, 0)
    metrics = [("n_positives", float(counts.get(1, 0))), ("n_negatives", float(counts.get(0, 0))), ("pwm_auc", by_matrix), ("ml_cv_auc", value)]
    return model, positives.sparkSession.createDataFrame(metrics, "metric string, value double")


def _labelled_windows(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    return positives.select("id", "window", F.lit(1).alias("label")).unionByName(negatives.select("id", "window", F.lit(0).alias("label")))


def fit_cut_model(positives: DataFrame, negatives: DataFrame, least: int = 10):
    """The model of ``cut_model`` (null with one class, or too few rows), without folds and metrics."""
    both = materialize(_labelled_windows(positives, negatives).withColumn("fold", F.lit(0)))
    if not whole(both):
        rows, cols = window_rows(positives, negatives)
        counts = {r["label"]: r["count"] for r in both.groupBy("label").count().collect()}
        return fit(rows, cols, "logreg") if len(counts) == 2 and sum(counts.values()) >= least else None
    data = WindowFits(both)
    counts = data.counts()
    return classifier_of(both, data.fit([None])[0]) if len(counts) == 2 and sum(counts.values()) >= least else None


def cut_model_optimum(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """``optimum`` of the cut model on all windows, terms intercept and f0 to f164."""
    both = materialize(_labelled_windows(positives, negatives).withColumn("fold", F.lit(0)))
    if not whole(both):
        rows, cols = window_rows(positives, negatives)
        rows = materialize(rows)
        return optimum(fit(rows, cols, "logreg", tol=1e-12), rows, cols)
    data = WindowFits(both)
    values = data.optimum(data.fit([None])[0])
    terms = ["intercept", *[f"f{i}" for i in range(len(values) - 1)]]
    return both.sparkSession.createDataFrame(list(zip(terms, map(float, values), strict=True)), "term string, moment double")
