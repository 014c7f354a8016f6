"""Fitted forests as plain tables of nodes, and their scores in column expressions.

A forest that is a table can be kept, read and scored without the classes that fitted it, by any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import scratch

#: tree and node count from 0; node 0 is the root; feature is a column's name, null in a leaf; p is a leaf's share of class 1.
NODES = "tree int, node int, feature string, threshold double, left int, right int, p double"


def forest_nodes(model, columns: list[str]) -> DataFrame:
    """Rows ``NODES`` of a fitted pyspark.ml forest of two classes on ``columns``, read from its saved form.

    A row goes left if its feature is at most the threshold. Weighted rows count by their weights.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = scratch(spark)
    model.write().save(path)
    n = F.col("nodeData")
    inner = n.leftChild >= 0
    stats = n.impurityStats
    feature = F.get(F.array(*map(F.lit, columns)), n.split.featureIndex)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n.id.alias("node"), F.when(inner, feature).alias("feature"), F.when(inner, F.get(n.split.leftCategoriesOrThreshold, F.lit(0))).alias("threshold"),
        F.when(inner, n.leftChild).alias("left"), F.when(inner, n.rightChild).alias("right"),
        F.when(~inner, F.get(stats, F.lit(1)) / F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)).alias("p"),
    )


def off_grid(nodes: DataFrame, places: int = 6) -> DataFrame:
    """Thresholds moved to the middle between two numbers of ``places`` decimals, so that features rounded to those take the same way."""
    unit = 10.0**places
    return nodes.withColumn("threshold", (F.floor(F.col("threshold") * unit) + 0.5) / unit)


def score_forest(rows: DataFrame, nodes: DataFrame, out: str = "score") -> DataFrame:
    """``rows`` with the mean share of class 1 over the trees, walked from root to leaf.

    The nodes, as many as the forest has, become arrays in one row that is broadcast; every row walks its trees by
    look-ups, so no row is copied a tree and nothing is shuffled. Feature columns that are absent are an error; nulls go right.
    A walk takes as many steps as the deepest tree. ``nodes`` without a row is an error.
    """
    table = nodes.select("tree", "node", "feature", "left", "right").collect()  # the nodes of one forest
    if not table:
        raise ValueError("a forest without nodes")
    used, trees = sorted({r["feature"] for r in table if r["feature"] is not None}), sorted({r["tree"] for r in table})
    sizes = {t: 1 + max(r["node"] for r in table if r["tree"] == t) for t in trees}
    base = {t: sum(sizes[x] for x in trees[:i]) for i, t in enumerate(trees)}
    children = {(r["tree"], r["node"]): (r["left"], r["right"]) for r in table if r["left"] is not None}
    front, depth = [(t, 0) for t in trees], -1
    while front:
        front, depth = [(t, n) for t, m in front for n in children.get((t, m), ())], depth + 1
    starts = F.create_map(*[F.lit(x) for pair in base.items() for x in pair])
    place = F.element_at(F.create_map(*[F.lit(x) for pair in [("", -1), *((c, i) for i, c in enumerate(used))] for x in pair]), F.coalesce("feature", F.lit("")))
    flat = nodes.select("node", starts[F.col("tree")].alias("b"), place.alias("f"), "threshold", "left", "right", "p")
    flat = flat.select((F.col("b") + F.col("node")).alias("i"), "f", "threshold", (F.col("b") + F.col("left")).alias("l"), (F.col("b") + F.col("right")).alias("r"), "p")
    packed = flat.agg(F.array_sort(F.collect_list(F.struct("i", "f", "threshold", "l", "r", "p"))).alias("s"))
    packed = packed.select(F.struct(*[F.col("s")[c].alias(c) for c in ("f", "threshold", "l", "r", "p")]).alias("_n"))
    full = rows.withColumn("_v", F.array(*[F.col(c).cast("double") for c in used]) if used else F.array(F.lit(0.0))).join(F.broadcast(packed))
    look = lambda c, i: F.get(F.col("_n")[c], i)

    def step(i, _):
        low = F.get(F.col("_v"), look("f", i)) <= look("threshold", i)
        return F.when(look("f", i) < 0, i).when(low, look("l", i)).otherwise(look("r", i))

    def walk(root):
        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), root, step) if depth else root

    roots = F.array(*[F.lit(b) for b in base.values()])
    total = F.aggregate(F.transform(roots, lambda i: look("p", walk(i))), F.lit(0.0), lambda a, b: a + b)
    return full.withColumn(out, total / F.lit(float(len(base)))).select(*rows.columns, out)

