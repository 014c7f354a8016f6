"""A forest that is kept with the queries: fitted on the labelled texts' M1 columns, as a table of nodes.

``refit`` makes it anew; the queries that score by it, and their SQL, read the same file.
"""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.forest import NODES, forest_nodes, off_grid

PATH = Path(__file__).parent / "models" / "m1_forest.tsv"


def node_rows() -> list[tuple]:
    """The kept rows, in the types of ``NODES``."""
    kinds = [{"int": int, "double": float, "string": str}[x.split()[1]] for x in NODES.split(", ")]
    with PATH.open(newline="") as f:
        return [tuple(k(v) if v else None for k, v in zip(kinds, row, strict=True)) for row in list(csv.reader(f, delimiter="\t"))[1:]]


def saved_forest(spark: SparkSession) -> DataFrame:
    """The kept forest; the driver reads its file, as executors have no copy of the package."""
    return spark.createDataFrame(node_rows(), NODES)


def refit(features: DataFrame, columns: list[str], trees: int = 12, seed: int = 0) -> None:
    """Fits a forest on (label, columns) and keeps it. Thresholds lie between numbers of six decimals, so that rounded features walk alike."""
    from ..operators.ml import fit

    model = fit(features, columns, "rf", seed, trees)
    rows = off_grid(forest_nodes(model, columns)).orderBy("tree", "node").collect()
    PATH.parent.mkdir(exist_ok=True)
    with PATH.open("w", newline="") as f:
        out = csv.writer(f, delimiter="\t", lineterminator="\n")
        out.writerow([x.split()[0] for x in NODES.split(", ")])
        out.writerows([["" if x is None else x for x in r] for r in rows])
