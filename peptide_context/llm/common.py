"""What the operators share: the scratch folder, written tables, ranks and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import components, materialize, scratch, small_side  # noqa: F401


def byte_slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Places (from, to) that cut a batch of texts into parts of at most ``most`` bytes, or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Texts go to Python in batches of at most ``most`` bytes, so that neither the JVM nor a worker holds many at a time.

    Sets the session's spark.sql.execution.arrow.maxBytesPerBatch (64 MB by default) where the user has not set it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(most))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def rank_within(df: DataFrame, keys: list[str], order: str, ties: list[str], bits: int = 10, split: int = 1000) -> DataFrame:
    """Adds ``rank``: the 0-based place of a row among those with equal ``keys``, by the long hash ``order``.

    A key of more than ``split`` rows is split by the top ``bits`` of the hash, so that one with a third of all rows is
    ranked by many tasks: each part is ranked by itself, and starts after the rows counted in the parts below it.
    There are few such keys, as they are many rows each. ``df`` should be a written table; ``keys`` hold no nulls.
    """
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > split)
    hot = small_side(materialize(hot.select(*keys, F.lit(True).alias("_hot"))))
    parted = df.join(hot, keys, "left").withColumn("_part", F.when(F.col("_hot"), F.shiftright(F.col(order), 64 - bits)).otherwise(F.lit(None)))
    counts = df.join(hot, keys).groupBy(*keys, F.shiftright(F.col(order), 64 - bits).alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_part").orderBy(order, *ties)
    return (
        parted.join(small_side(materialize(base)), [*keys, "_part"], "left")
        .withColumn("rank", F.coalesce("_base", F.lit(0)) + F.row_number().over(inside) - 1)
        .drop("_base", "_part", "_hot")
    )


def field(name: str) -> Column:
    """A column by its plain name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame, name: str = "_row") -> Column:
    """All columns as one struct, so that an operator's own columns cannot clash with them."""
    return F.struct(*map(field, df.columns)).alias(name)


def fields_of(df: DataFrame, name: str = "_row") -> list[Column]:
    """The columns of ``whole_row`` again."""
    return [F.col(name).getField(c).alias(c) for c in df.columns]
