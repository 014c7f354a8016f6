"""Near-duplicate vectors by lattice hashing.

Unit vectors are projected at random to blocks of eight dimensions and decoded to points of the E8 lattice; a
cell is the points of all blocks of one table, together with the label. Every vector stands in its own cell of
each table and also probes the neighbouring cells it lies closest to. Vectors that meet are compared by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, rank_within
from .hashing import mix

TABLES, BLOCKS, PROBES, WIDTH = 6, 2, 6, 1.15


def roots() -> np.ndarray:
    """The 240 shortest E8 vectors: steps from a cell to its neighbours."""
    found = []
    for i, j in combinations(range(8), 2):
        for a in (1, -1):
            for b in (1, -1):
                v = np.zeros(8)
                v[i], v[j] = a, b
                found.append(v)
    for bits in range(256):
        s = np.array([1 if bits >> i & 1 else -1 for i in range(8)])
        if (s < 0).sum() % 2 == 0:
            found.append(s / 2)
    return np.array(found)


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the better of the nearest points of D8 and of D8 shifted by a half."""

    def d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        gap = y - near
        odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) % 2 != 0)
        worst = np.abs(gap[odd]).argmax(axis=1)
        near[odd, worst] += np.where(gap[odd, worst] >= 0, 1.0, -1.0)
        return near

    a, b = d8(x), d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def cells(unit: np.ndarray, labels: np.ndarray, tables: int, blocks: int, probes: int, width: float, seed: int = 11):
    """(home, probe) codes: int64 arrays (rows, tables) and (rows, tables, probes)."""
    n, dim = unit.shape
    steps = roots()
    home = np.empty((n, tables), dtype=np.int64)
    probe = np.empty((n, tables, probes), dtype=np.int64)
    rng = np.random.default_rng([seed, dim])
    start = mix(labels.astype(np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1), dim)
    for t in range(tables):
        point, move, gain = [], [], []
        for _ in range(blocks):
            y = unit @ (rng.standard_normal((dim, 8)) / width)
            p = decode(y)
            g = (y - p) @ steps.T  # the larger, the nearer the neighbour in that direction
            best = np.argpartition(-g, probes, axis=1)[:, :probes]
            point.append(p)
            move.append(best)
            gain.append(np.take_along_axis(g, best, axis=1))
        code = lambda ps: _code(ps, mix(start, t + 1))
        home[:, t] = code(point)
        everyone = np.concatenate(gain, axis=1)
        order = np.argsort(-everyone, axis=1, kind="stable")[:, :probes]
        for k in range(probes):
            block, which = order[:, k] // probes, order[:, k] % probes
            moved = [p + np.where((block == b)[:, None], steps[move[b][np.arange(n), which]], 0.0) for b, p in enumerate(point)]
            probe[:, t, k] = code(moved)
    return home, probe


def _code(points: list[np.ndarray], start: np.ndarray) -> np.ndarray:
    h = start.copy()
    for p in points:
        twice = np.rint(p * 2).astype(np.int64).view(np.uint64)
        for i in range(8):
            h = mix(h ^ (twice[:, i] * np.uint64(0x9E3779B97F4A7C15)), i)
    return h.view(np.int64)


def _index(tables: int, blocks: int, probes: int, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_dim: dict[int, list[int]] = {}
            rows = batch.column(2).to_pylist()
            for i, v in enumerate(rows):
                by_dim.setdefault(len(v), []).append(i)
            for at in by_dim.values():
                x = np.asarray([rows[i] for i in at], dtype=np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                take = pa.array(at, pa.int32())
                labels = batch.column(1).take(take)
                home, probe = cells(x, np.asarray(labels.to_pylist(), np.int64), tables, blocks, probes, width)
                yield pa.record_batch(
                    [batch.column(0).take(take), batch.column(3).take(take), pa.array([r.tobytes() for r in x], pa.binary()),
                     pa.array(list(home), pa.list_(pa.int64())), pa.array(list(probe.reshape(len(at), -1)), pa.list_(pa.int64()))],
                    ["node", "w", "unit", "home", "probe"],
                )

    return run


def _compare(threshold: float, tables: int, probes: int):
    """Counts links inside each unit of work, each linked pair in exactly one unit over all tables."""

    def links(rows: pa.RecordBatch, unit: tuple) -> tuple[list, list, list]:
        node = rows.column("node").to_numpy()
        w = rows.column("w").to_numpy()
        x = np.frombuffer(b"".join(rows.column("unit").to_pylist()), np.float64).reshape(len(node), -1)
        home = np.asarray(rows.column("home").to_pylist(), np.int64)
        probe = np.asarray(rows.column("probe").to_pylist(), np.int64).reshape(len(node), tables, probes)
        side = rows.column("side").to_numpy()
        t = unit[1]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if unit[2] == "s":  # within one block
            right = left
        if not len(left) or not len(right):
            return [], [], []
        a, b = np.nonzero(x[left] @ x[right].T >= threshold)
        a, b = left[a], right[b]
        keep = a < b if unit[2] == "s" else node[a] != node[b]
        a, b = a[keep], b[keep]
        if not len(a):
            return [], [], []
        met = lambda i: (home[a, i] == home[b, i]) | (probe[b, i] == home[a, i][:, None]).any(1) | (probe[a, i] == home[b, i][:, None]).any(1)
        new = np.ones(len(a), dtype=bool)
        for i in range(t):
            new &= ~met(i)
        if unit[2] == "p":  # a at home, b probing: not where both are at home, and once where each probes the other
            both = (probe[a, t] == home[b, t][:, None]).any(1)
            new &= (home[a, t] != home[b, t]) & (~both | (node[a] < node[b]))
        a, b = a[new], b[new]
        count = np.bincount(a, w[b], len(node)) + np.bincount(b, w[a], len(node))
        root = np.arange(len(node))
        while True:  # least neighbour until nothing changes
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        hit = np.flatnonzero(count > 0)
        return node[hit].tolist(), count[hit].astype(np.int64).tolist(), node[root[hit]].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = None, None
        out: tuple[list, list, list] = ([], [], [])

        def flush(part, unit):
            for o, v in zip(out, links(part, unit), strict=True):
                o.extend(v)

        for batch in batches:
            key = list(zip(*(batch.column(c).to_pylist() for c in ("cell", "t", "kind", "i", "j")), strict=True))
            edge = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            for a, b in zip(edge, edge[1:], strict=False):
                part = batch.slice(a, b - a)
                if held is not None and key[a] == now:
                    held = pa.concat_batches([held, part])
                    continue
                if held is not None:
                    flush(held, now)
                held, now = part, key[a]
            if len(out[0]) > 50_000:
                yield pa.record_batch([pa.array(o, pa.int64()) for o in out], ["node", "n", "root"])
                out = ([], [], [])
        if held is not None:
            flush(held, now)
        yield pa.record_batch([pa.array(o, pa.int64()) for o in out], ["node", "n", "root"])

    return run


def near_duplicates(
    rows: DataFrame, threshold: float = 0.98, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, width: float = WIDTH, size: int = 192
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of rows(vec_id, embedding, label).

    Rows link when labels are equal and not null and the cosine, in doubles, is at least ``threshold``; null, zero
    and non-finite vectors and null labels link with nothing, other dimensions never meet. n_links counts other
    rows; copies of a vector with one label are one class with a size, compared once. No pair below the threshold
    is linked; the share of pairs that share a cell is measured in the tests.

    A cell's members are dealt into blocks of ``size``, and pairs of blocks are the units of work: a cell with very
    many members becomes many units. Each unit returns counts and a spanning forest, never its pairs.
    """
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = e.isNotNull() & ~bad & F.exists(e, lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    read = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long").alias("label"), e.cast("array<double>").alias("embedding"))
    read = read.withColumn("_ok", F.coalesce(fine, F.lit(False)))
    read = read.withColumn("_k", F.xxhash64("embedding")).withColumn("_l", F.xxhash64(F.lit(3), "embedding"))
    classes = materialize(
        read.where("_ok").groupBy("label", "_k", "_l")
        .agg(F.min("vec_id").alias("node"), F.count("*").alias("w"), F.first("embedding").alias("embedding"))
    )
    indexed = materialize(
        classes.select("node", "label", "embedding", "w").mapInArrow(
            _index(tables, blocks, probes, width), "node long, w long, unit binary, home array<long>, probe array<long>"
        )
    )
    homes = indexed.select("node", F.posexplode("home").alias("t", "cell"), F.lit(0).alias("side"))
    probing = indexed.select("node", F.posexplode("probe").alias("p", "cell"))
    probing = probing.select("node", F.floor(F.col("p") / probes).cast("int").alias("t"), "cell", F.lit(1).alias("side"))
    stand = homes.union(probing)
    busy = stand.groupBy("t", "cell").agg(F.sum(1 - F.col("side")).alias("h"), F.sum("side").alias("q"))
    busy = busy.where("h >= 1 and h + q >= 2")
    met = materialize(stand.join(busy, ["t", "cell"]).withColumn("_o", F.xxhash64("node", "cell")))
    ranked = rank_within(met, ["t", "cell", "side"], "_o", ["node"], bits=6)
    ranked = ranked.withColumn("b", F.floor(F.col("rank") / size).cast("int"))
    nh, nq = F.ceil(F.col("h") / size).cast("int"), F.ceil(F.col("q") / size).cast("int")
    one = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    span = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    zero = F.lit(0)
    at_home = F.concat(
        F.array(one("s", F.col("b"), F.col("b"), 0)),
        F.transform(span(F.col("b") + 1, nh - 1), lambda j: one("h", F.col("b"), j, 0)),
        F.transform(span(zero, F.col("b") - 1), lambda i: one("h", i, F.col("b"), 1)),
        F.transform(span(zero, nq - 1), lambda j: one("p", F.col("b"), j, 0)),
    )
    as_probe = F.transform(span(zero, nh - 1), lambda i: one("p", i, F.col("b"), 1))
    work = ranked.withColumn("_u", F.explode(F.when(F.col("side") == 0, at_home).otherwise(as_probe)))
    work = work.where(~((F.col("_u.kind") == "s") & (F.col("h") < 2))).select("node", "cell", "t", "_u.*")
    full = work.join(indexed, "node").repartition("cell", "t", "kind", "i", "j").sortWithinPartitions("cell", "t", "kind", "i", "j")
    found = materialize(full.mapInArrow(_compare(threshold, tables, probes), "node long, n long, root long"))
    comps = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    known = classes.select("label", "_k", "_l", "node", "w").join(counts, "node", "left").join(comps, "node", "left")
    known = known.select(F.col("label"), "_k", "_l", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("comp", "node").alias("component_id"))
    out = read.select("vec_id", "_ok", "label", "_k", "_l").join(known, ["label", "_k", "_l"], "left")
    comp = F.when(F.col("_ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.when(F.col("_ok"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
