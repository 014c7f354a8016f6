"""Written tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

BROADCAST_BYTES = 64 << 20

_LOCAL: dict[str, str] = {}
_GOES: set[str] = set()  # applications whose tables go when the driver ends
_STEPS: ContextVar[tuple[str, ...]] = ContextVar("steps", default=())


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="spark-scratch-")
        base = _LOCAL[app]
    return "/".join([base.rstrip("/"), "tables", app, *_STEPS.get()])


def scratch(spark: SparkSession) -> str:
    """A new path below the cluster's shared ``spark.checkpoint.dir``. What lies there goes when the driver ends.

    Where that setting is absent, a temporary folder stands in for it on one machine (tests); a cluster without it is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _GOES:
        _GOES.add(app)
        own = _STEPS.set(())
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
        _STEPS.reset(own)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back: lineage ends here,
    and a lost executor costs only the tasks that read its part again."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it comes in fewer splits than there are, as a small file does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def drop_tables(spark: SparkSession) -> None:
    """Removes the tables written so far, or so far in the step. DataFrames that read them are of no use any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def step(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside go at the end, but for the one that is handed to the function given: it is written outside.

    ``with step(spark) as keep: result = keep(work(df))``
    """
    outer = _STEPS.get()
    inner = _STEPS.set((*outer, uuid.uuid4().hex))

    def keep(df: DataFrame) -> DataFrame:
        own = _STEPS.set(outer)
        try:
            return materialize(df)
        finally:
            _STEPS.reset(own)

    try:
        yield keep
        drop_tables(spark)
    finally:
        _STEPS.reset(inner)


def _memory(kind: DataType, value: Column) -> Column | int:
    """Bytes that a value takes in a broadcast table, about; a number where all values of its type take the same."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.lit(16) + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, StructType):
        return 16 + sum((_memory(f.dataType, value.getField(f.name)) for f in kind.fields), 0)
    if isinstance(kind, ArrayType):
        one = _memory(kind.elementType, value)
        if isinstance(one, int):
            return F.lit(24) + one * F.coalesce(F.size(value), F.lit(0)).cast("long")
        each = F.transform(value, lambda x: _memory(kind.elementType, x).cast("long"))
        return F.lit(24) + F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda x, y: x + y), F.lit(0))
    return 8


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` to be broadcast if its rows take at most ``most`` bytes there, else as it is, to be joined by shuffle.

    ``df`` should be a written table of few columns. Its bytes are summed up (rows of fixed width are only counted), never
    assumed: 64 a row for headers and the hash table's slot, and what the values take.
    """
    row = 64 + _memory(df.schema, F.struct(*["`" + c.replace("`", "``") + "`" for c in df.columns]))
    if isinstance(row, int):
        return F.broadcast(df) if df.limit(most // row + 1).count() * row <= most else df
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0] <= most else df


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: rows (node, comp), comp the smallest node reached.

    Alternates the large-star and small-star steps of map-reduce connected components until the sum of the
    links stays the same; every round is a written table, so no lineage piles up. Nodes without an edge are
    not returned. Both steps group by one node but only keep its minimum, which is aggregated before the shuffle; the minima
    go back to the links by broadcast if they are few, else by a plain join of two tables, whose hot keys Spark deals anew.
    """
    spark = edges.sparkSession
    e = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    last = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = small_side(materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))))
        # large star: every larger neighbour of u is linked with the least node around u
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct())
        # small star: every smaller neighbour of u, and u, are linked with the least of them
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(small_side(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("v")
        ).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.union(e.select("v", "v").distinct())
