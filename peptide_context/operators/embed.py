"""Sequence embeddings: hashed k-mers, any user's batch model, and joining them to a dataset."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import kmer_vector


def kmer_vectors(df: DataFrame, seq: str = "seq", dim: int = 32, k: int = 2, out: str = "vec") -> DataFrame:
    """Adds the k-mer embedding of the upper-cased ``seq`` as an array column. No row is moved or split."""
    return df.withColumn(out, kmer_vector(F.upper(seq), dim, k))


def _model(key: str, factory: Callable[[], Callable]) -> Callable:
    """What ``factory`` returned, once in a Python worker: it stays for the worker's later tasks until another is asked for."""
    kept = sys.modules.setdefault("_embedding_models", types.ModuleType("_embedding_models"))  # outlives a task
    if getattr(kept, "key", None) != key:
        kept.model, kept.key = factory(), key
    return kept.model


def _slots(df: DataFrame) -> int | None:
    """Tasks that run at a time, counting executors that are asked for but not there yet; None where they come and go."""
    spark = df.sparkSession.sparkContext
    conf = spark.getConf()
    if conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return None
    asked = int(conf.get("spark.executor.instances", "0")) * int(conf.get("spark.executor.cores", "1"))
    return max(spark.defaultParallelism, asked)


def pieces(seq: str, window: int | None, overlap: int) -> list[str]:
    """A sequence in windows that overlap; one piece where it is no longer than a window."""
    if window is None or len(seq) <= window:
        return [seq]
    return [seq[i : i + window] for i in range(0, len(seq) - overlap, window - overlap)]


def embed(
    df: DataFrame, fn: Callable[[list[str]], np.ndarray] | None = None, seq: str = "seq", key: str = "id", batch: int = 256,
    factory: Callable[[], Callable[[list[str]], np.ndarray]] | None = None, window: int | None = None, overlap: int = 0,
    tasks: int | None = None,
) -> DataFrame:
    """(key, vec) by a user's model from a list of sequences to an array of rows, called in tasks on ``batch`` sequences at a time.

    The model is ``fn``, or what ``factory`` returns: that is called once in each Python worker, however many tasks the worker
    runs, so that weights are loaded once. Spark gives tasks to its idle workers in turn, and stages of several Python steps
    leave several a core; so with a factory partitions are put together, unshuffled, into at most ``tasks`` tasks (as many as
    run at a time, if not given; with dynamic allocation they stay as they are), and no more workers load. Longer sequences
    than ``window`` go in windows that overlap by ``overlap`` residues, and their vector is the mean of the windows' vectors
    by length; nothing is cut off. Sequences of an Arrow batch go in order of length, so that a batch holds like ones. A null
    is an empty sequence; repeated keys are each embedded.
    """
    if (fn is None) == (factory is None):
        raise ValueError("give a function or a factory of one")
    if window is not None and not 0 <= overlap < window:
        raise ValueError("windows must be longer than their overlap")
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fn if fn is not None else _model(name, factory)
        for b in batches:
            for at in range(0, b.num_rows, 16 * batch):
                part = b.slice(at, 16 * batch)
                cut = [pieces(s or "", window, overlap) for s in part.column(1).to_pylist()]
                row = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
                flat = [p for c in cut for p in c]
                size = np.fromiter(map(len, flat), np.int64, len(flat))
                order, total = np.argsort(size, kind="stable"), None
                for i in range(0, len(order), batch):
                    some = order[i : i + batch]
                    vec = np.asarray(model([flat[k] for k in some.tolist()]), dtype=np.float64)
                    total = np.zeros((len(cut), vec.shape[1])) if total is None else total
                    np.add.at(total, row[some], vec * np.maximum(size[some], 1)[:, None])
                mean = total / np.bincount(row, np.maximum(size, 1), len(cut))[:, None]
                yield pa.record_batch([part.column(0), pa.array(list(mean), pa.list_(pa.float64()))], [key, "vec"])

    kind = dict(df.dtypes)[key]
    rows, most = df.select(key, seq), tasks or (_slots(df) if factory is not None else None)
    return (rows.coalesce(most) if most else rows).mapInArrow(run, f"{key} {kind}, vec array<double>")


def merge_embeddings(dataset: DataFrame, tables: list[tuple[DataFrame, str, int]]) -> DataFrame:
    """The dataset with columns <prefix>0.. of each table (id, vec, ord); zeros without a row, the last ``ord`` wins."""
    for table, prefix, dim in tables:
        last = table.groupBy("id").agg(F.max_by("vec", "ord").alias("_v"))
        dataset = dataset.join(last, "id", "left")
        zero = F.lit(0.0)
        cols = {f"{prefix}{i}": F.coalesce(F.get("_v", F.lit(i)).cast("double"), zero) for i in range(dim)}
        dataset = dataset.withColumns(cols).drop("_v")
    return dataset
