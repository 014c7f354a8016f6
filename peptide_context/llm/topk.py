"""Exact top-k by inner product with multi-resolution segment statistics.

The components stand in order of their variance. At the coarsest level a vector is its first components and one segment for all
others, of which the mean and the deviation are kept: sum(q * x) is at most the product of the first components, plus length * (mean_q *
mean_x + deviation_q * deviation_x) of the segment, which is the lower bound on the distance read for inner products. From level
to level half of the segment is resolved into its components; the products so far are kept, and only the new components are multiplied,
for those candidates alone whose bound reaches the k-th score found so far. At the last level all components are resolved,
and the product is the exact score. So a pair costs two multiplications a level more than its exact product at most, and a
level that closes hardly any pair is left out for the next blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARES = (0.125, 0.25, 0.5, 0.75, 0.875)  # of the components that are resolved, level by level
FEW = 0.1  # below this share of open pairs (half, at the last level) a level is computed pair by pair
WORTH = 0.02  # a level that closes a smaller share of the open pairs is left out,
AGAIN = 16  # and tried again after so many blocks
QUERIES = 2048  # in a block, on average
LANE_BYTES = 16 << 20  # of candidates in a unit of work, on average


def quantized(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): v = floor(scale * component) for vectors with only finite, non-null components."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.where(e.isNotNull() & F.col("vec_id").isNotNull() & ~bad).select(F.col("vec_id").cast("long"), ints.alias("v"))


def component_orders(rows: DataFrame, most: int = 64) -> dict[int, list[int]]:
    """Components by falling variance, for each of the ``most`` commonest dimensions; sums by task, so that a task sends a row a
    dimension. Any order gives the same scores; this one lets bounds close pairs early."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            v = batch.column(0)
            sizes = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy().astype(np.float64)
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes[sizes > 0]).tolist():
                x = flat[((ends - dim)[sizes == dim][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
                old = found.setdefault(dim, [0, np.zeros(dim), np.zeros(dim)])
                found[dim] = [old[0] + len(x), old[1] + x.sum(axis=0), old[2] + (x * x).sum(axis=0)]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.record_batch([pa.array(c, k) for c, k in zip([list(found), *zip(*[(n, a.tolist(), b.tolist()) for n, a, b in found.values()], strict=True)] if found else [[]] * 4, kinds, strict=True)], ["dim", "n", "a", "b"])

    each = rows.select("v").mapInArrow(sums, "dim int, n long, a array<double>, b array<double>")
    total = each.select("dim", "n", F.posexplode(F.arrays_zip("a", "b")).alias("i", "s")).groupBy("dim", "i")
    total = total.agg(F.sum("n").alias("n"), F.sum("s.a").alias("a"), F.sum("s.b").alias("b"))
    spread = F.col("b") / F.col("n") - F.pow(F.col("a") / F.col("n"), F.lit(2.0))
    ordered = total.groupBy("dim").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct((-spread).alias("s"), "i"))).alias("o"))
    return {r["dim"]: [x["i"] for x in r["o"]] for r in ordered.orderBy(F.col("n").desc(), "dim").limit(most).collect()}


def levels(dim: int) -> list[int]:
    """How many components are resolved, level by level, to all."""
    return [*dict.fromkeys(n for s in SHARES if 0 < (n := int(dim * s)) < dim), dim]


def rest_stats(x: np.ndarray, steps: list[int]) -> list[np.ndarray]:
    """For each level root(length) * mean and root(length) * deviation of the components that are not resolved yet."""
    total = np.cumsum(x[:, ::-1], axis=1)[:, ::-1]
    square = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    found = []
    for n in steps[:-1]:
        size = x.shape[1] - n
        mean = total[:, n] / size
        found.append(np.stack([mean * np.sqrt(size), np.sqrt(np.maximum(square[:, n] / size - mean * mean, 0) * size)], axis=1))
    return found


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise integer inner products of any size, as Python's integers."""
    return np.asarray([sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(q, x, strict=True)], dtype=np.int64)


class BlockSearch:
    """The k best of a block of queries over the candidate blocks given to ``add``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, order: list[int] | None = None):
        self.order = np.arange(vectors.shape[1]) if order is None else np.asarray(order)
        self.ids, self.whole, self.k, self.steps = ids, vectors[:, self.order], k, levels(vectors.shape[1])
        self.q = self.whole.astype(np.float64)
        self.rest = rest_stats(self.q, self.steps)
        self.row, self.vec, self.score = (np.empty(0, np.int64) for _ in range(3))
        self.level = np.full(len(ids), -np.inf)
        self.idle = np.zeros(len(self.steps), np.int64)  # blocks for which a level is still left out
        self.multiplications = 0
        self.products = 0  # pairs of which all components were multiplied

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if vectors.shape[1] != self.q.shape[1] or not len(ids) or not len(self.ids):
            return
        whole = vectors[:, self.order]
        x = whole.astype(np.float64)
        most = float(np.abs(self.q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
        if most >= 2**53:  # doubles would not hold the products exactly
            a, b = np.nonzero(self.ids[:, None] != ids[None, :])
            for at in range(0, len(a), 1 << 14):
                i, j = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
                self._take(i, ids[j], exact_products(self.whole[i], whole[j]))
            return
        rest, slack = rest_stats(x, self.steps), 1e-9 * most + 1e-3
        open_, dense, done = self.ids[:, None] != ids[None, :], np.zeros((len(self.ids), len(ids))), 0
        a = b = part = None  # the open pairs, once they are few
        for n, step in enumerate(self.steps):
            last = n == len(self.steps) - 1
            if not last and self.idle[n] > 0:
                self.idle[n] -= 1
                continue
            new = slice(done, step)
            if a is None:
                dense += self.q[:, new] @ x[:, new].T
                self.multiplications += dense.size * (step - done)
            else:
                part = part + np.einsum("ij,ij->i", self.q[a, new], x[b, new])
                self.multiplications += len(a) * (step - done)
            done = step
            if last:
                self.products += dense.size if a is None else len(a)
                break
            if a is None:
                if np.isneginf(self.level).any():
                    if 2 * step < x.shape[1]:
                        continue  # nothing to compare bounds with, and too little is known to choose by
                    self._first(ids, x, open_, dense)
                before = np.count_nonzero(open_)
                open_ &= dense + self.rest[n] @ rest[n].T + slack >= self.level[:, None]
                left = np.count_nonzero(open_)
                self.multiplications += 2 * dense.size
                if left <= (FEW if n < len(self.steps) - 2 else 0.5) * open_.size:
                    a, b = np.nonzero(open_)
                    part = dense[a, b]
            else:
                before = len(a)
                keep = part + np.einsum("ij,ij->i", self.rest[n][a], rest[n][b]) + slack >= self.level[a]
                self.multiplications += 2 * before
                a, b, part = a[keep], b[keep], part[keep]
                left = len(a)
            if before and before - left < WORTH * before:
                self.idle[n] = AGAIN
        if a is None:
            if np.isneginf(self.level).any():
                self._first(ids, x, open_, dense)
            a, b = np.nonzero(open_ & (dense >= self.level[:, None]))
            part = dense[a, b]
        self._take(a, ids[b], np.rint(part).astype(np.int64))

    def _first(self, ids: np.ndarray, x: np.ndarray, open_: np.ndarray, dense: np.ndarray) -> None:
        """Gives queries without a k-th score one: from the candidates whose products so far are the highest."""
        new = np.flatnonzero(np.isneginf(self.level))
        promise = np.where(open_[new], dense[new], -np.inf)
        first = np.argpartition(-promise, min(self.k, len(ids)) - 1, axis=1)[:, : self.k]
        a, b = np.repeat(new, first.shape[1]), first.ravel()
        real = open_[a, b]
        a, b = a[real], b[real]
        self.multiplications += len(a) * x.shape[1]
        self.products += len(a)
        self._take(a, ids[b], np.rint(np.einsum("ij,ij->i", self.q[a], x[b])).astype(np.int64))
        open_[a, b] = False

    def _take(self, a: np.ndarray, vec: np.ndarray, scores: np.ndarray) -> None:
        row, vec, score = np.concatenate([self.row, a]), np.concatenate([self.vec, vec]), np.concatenate([self.score, scores])
        order = np.lexsort((vec, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.row, self.vec, self.score = row[keep], vec[order][keep], score[order][keep]
        last = place[keep] == self.k - 1
        self.level[self.row[last]] = self.score[last]

    def rows(self) -> pa.RecordBatch:
        return pa.record_batch([pa.array(self.ids[self.row]), pa.array(self.vec), pa.array(self.score)], ["query_id", "vec_id", "score"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, v, part) to blocks (part, dim, width, ids, vectors) of at most 1024 rows of one part and dimension."""
    names = ["part", "dim", "width", "ids", "vectors"]

    def packed(part: int, dim: int, rows: list) -> pa.RecordBatch:
        v = np.asarray([x for _, x in rows], np.int64).reshape(len(rows), dim)
        width = next(w for w in (2, 4, 8) if w == 8 or not v.size or np.abs(v).max() < 1 << (8 * w - 1))
        ids = np.asarray([i for i, _ in rows], np.int64)
        numbers = [pa.array([x], pa.int32()) for x in (part, dim, width)]
        return pa.record_batch([*numbers, pa.array([ids.tobytes()], pa.binary()), pa.array([v.astype(f"<i{width}").tobytes()], pa.binary())], names)

    kept: dict[tuple[int, int], list] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            for i, v, own in zip(*(c.to_pylist() for c in part.columns), strict=True):
                kept.setdefault((own, len(v)), []).append((i, v))
            for key in [k for k, rows in kept.items() if len(rows) >= 1024 or k[0] != own]:  # parts come one after the other
                yield packed(*key, kept.pop(key))
    for key, rows in kept.items():
        yield packed(*key, rows)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, block: int = QUERIES, lane_bytes: int = LANE_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products over all rows but its own.

    ``rows`` and ``queries`` are (vec_id, v) as from ``quantized``, written tables; ties go to the smaller vec_id, fewer candidates
    give fewer rows, vectors of other dimensions are no candidates. Rows with the query's own vec_id are its own; of several
    queries with one vec_id the least vector, component by component, is searched. Empty tables give an empty result.

    Queries are hashed into blocks of about ``block``, candidates into lanes of about ``lane_bytes``; a unit of work is a block and
    a lane, which meet by a cogroup: a block travels once for each lane, a lane once for each block, in two bytes a component where they
    suffice, and only k rows a query and lane meet in the end. Both grow in number with their tables, not in size.
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n = max(1, -(-queries.count() // block))
    size = rows.agg(F.coalesce(F.sum(2 * F.size("v") + 8), F.lit(0))).first()[0]
    lanes = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // lane_bytes))
    orders = component_orders(rows)

    def dealt(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        """Packed blocks with their own part and a copy for each part of the other side."""
        hashed = df.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias(own))
        packed = hashed.repartition(own).sortWithinPartitions(own).mapInArrow(_pack, "part int, dim int, width int, ids binary, vectors binary")
        return packed.withColumnRenamed("part", own).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        states: dict[int, list[BlockSearch]] = {}
        for ids, q in _unpacked(left):
            states.setdefault(q.shape[1], []).append(BlockSearch(ids, q, k, orders.get(q.shape[1])))
        for ids, x in _unpacked(right):
            for state in states.get(x.shape[1], []):
                state.add(ids, x)
        found = [s.rows() for group in states.values() for s in group]
        return pa.Table.from_batches(found) if found else pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})

    blocks = dealt(queries, "qb", n, "lane", lanes).groupBy("qb", "lane")
    found = blocks.cogroup(dealt(rows, "lane", lanes, "qb", n).groupBy("qb", "lane")).applyInArrow(search, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unpacked(blocks: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for dim, width, ids, vectors in zip(*(blocks[c].to_pylist() for c in ("dim", "width", "ids", "vectors")), strict=True):
        own = np.frombuffer(ids, np.int64)
        yield own, np.frombuffer(vectors, f"<i{width}").astype(np.int64).reshape(len(own), dim)


def search_table(embeddings: DataFrame, modulus: int = 50, k: int = 5) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by ``modulus``; candidates are all rows. Rows whose vector or vec_id is null, or
    whose vector holds a null or what is not finite, take no part; repeats, ties and empty tables are as in ``top_k``."""
    v = materialize(quantized(embeddings))
    return top_k(v, v.where(F.col("vec_id") % modulus == 0), k)
