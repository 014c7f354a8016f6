"""Exact Jaccard join of word-shingle sets with a token-group matrix.

Most texts share few of their shingles with any other, and two passes over the texts say so before anything is
joined. In the first, every set shows the first two fifths of its tokens in hash order; a set that links has half of
these in common with its partner's. In the second, the sets that are left show all tokens: four fifths of a set that
links occur in another one, and how many sets hold a token gives the order for the prefix filter, rare ones first. Tokens
travel packed, 6 bytes each, by hash bucket; what many documents of a chunk share is counted there and travels once.

Of what is left equal sets are one node, and nodes are partitioned into groups of similar ones: each is compared with
the best leader that shares a minimum hash with it. The matrix holds the union of each group's tokens, as a bitmap. A node
and a group that share a prefix token are a candidate; sizes, places of the token and the bitmap bound the overlap from
above, and only groups that may reach the threshold are opened: blocks of bitmaps against blocks of members, then exact
comparison of whole sets.

The prefix filter keeps this exact: in any fixed order of tokens, two sets that reach the threshold share one of
their first tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, small_batches, small_side, text_or_empty
from .hashing import mix, shingle_sets

NUM, DEN = 4, 5  # links reach a Jaccard similarity of NUM / DEN
SHINGLE = 5
SEEDS = 4  # minimum hashes a node, to find its leader
BLOCK = 128  # nodes in a block of bitmaps, on average
PER_BUCKET = 1 << 18  # tokens that a hash bucket gets on average, up to
MOST_BITS = 28  # two to the power of so many buckets: 7e13 tokens
CHUNK = 1 << 19  # tokens of a chunk of documents; more if there are many buckets, up to
MOST_CHUNK = 1 << 23  # so many
_LOW = np.uint64(0xFFFFFFFF)


def shown(n: int) -> int:
    """How many of ``n`` tokens, first in hash order, a set shows in the first pass."""
    return min(n, 2 * (n // DEN) + 2)


def needed(n: int) -> int:
    """How many of the shown tokens another set shows as well, if it links with a set of ``n`` tokens.

    At most n // 5 tokens are not the partner's. With ``shown`` a fifth and more is left of those below the end of
    the shorter list, for any two sizes that can link (the tests go through them).
    """
    return n // DEN + 1


def node_of(tokens: np.ndarray) -> bytes:
    """128 bits for a set of tokens, given in order."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _sets_of(batch: pa.RecordBatch, column: int, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, batch.num_rows, 256):
        texts = [t.encode() for t in batch.column(column).slice(at, 256).to_pylist()]
        yield from zip(range(at, at + len(texts)), shingle_sets(texts, shingle), strict=True)


_CHUNK_COLUMNS = {
    "bucket": pa.int64(), "chunk": pa.int64(),
    # a bucket's tokens: those that one document of the chunk has, with its place, and those of more, with their number
    "one": pa.binary(), "who": pa.binary(), "more": pa.binary(), "times": pa.binary(),
    # the chunk's documents: ids, set sizes, nodes, and how many of their shown tokens others in the chunk have
    "ids": pa.list_(pa.int64()), "sizes": pa.binary(), "nodes": pa.binary(), "local": pa.binary(),
    # second pass: the tokens that more documents of the chunk have, and which
    "home": pa.binary(), "home_n": pa.binary(), "home_who": pa.binary(),
}
_CHUNK_DDL = (
    "bucket long, chunk long, one binary, who binary, more binary, times binary, ids array<long>, sizes binary, nodes binary, "
    "local binary, home binary, home_n binary, home_who binary"
)
_ANSWER_DDL = (
    "chunk long, key binary, who binary, df binary, ids array<long>, sizes binary, nodes binary, local binary, home binary, "
    "home_n binary, home_who binary"
)


def _rows(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    n = max(map(len, columns.values()))
    return pa.record_batch([pa.array(columns.get(k, [None] * n), t) for k, t in kinds.items()], list(kinds))


def _deal(shingle: int, bits: int, chunk_size: int, full: bool):
    """Chunks of documents to rows a bucket, and a row with the documents themselves under a bucket of its own."""
    low = np.uint64((1 << bits) - 1)

    def flush(chunk: int, held: list) -> Iterator[pa.RecordBatch]:
        k = len(held)
        tokens = np.concatenate([h[3] for h in held])
        who = np.repeat(np.arange(k, dtype=np.uint16), [len(h[3]) for h in held])
        key = ((tokens & low) << np.uint64(32)) | ((tokens >> np.uint64(bits)) & _LOW)
        order = np.argsort(key)
        key, who = key[order], who[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        count = np.diff(np.append(start, len(key)))
        single = count == 1
        one, one_who, more, times = key[start[single]], who[start[single]], key[start[~single]], count[~single].astype(np.uint32)
        several = np.repeat(~single, count)
        present = np.unique(key >> np.uint64(32))  # not all buckets: there may be more of them than tokens in a chunk
        a, b = (np.append(np.searchsorted(x, present << np.uint64(32)), len(x)) for x in (one, more))
        out: dict[str, list] = {c: [] for c in ("bucket", "chunk", "one", "who", "more", "times")}
        for i, bucket in enumerate(present.tolist()):
            x, y = slice(a[i], a[i + 1]), slice(b[i], b[i + 1])
            values = (bucket, chunk, one[x].astype("<u4").tobytes(), one_who[x].tobytes(), more[y].astype("<u4").tobytes(), times[y].tobytes())
            for c, v in zip(out.values(), values, strict=True):
                c.append(v)
        if out["bucket"]:
            yield _rows(out, _CHUNK_COLUMNS)
        docs = {
            "bucket": [-1 - chunk], "chunk": [chunk], "ids": [[h[0] for h in held]],
            "sizes": [np.asarray([h[1] for h in held], np.int64).tobytes()], "nodes": [b"".join(h[2] for h in held)],
            "local": [np.bincount(who[several], minlength=k).astype(np.int64).tobytes()],
        }
        if full:
            docs |= {"home": [more.tobytes()], "home_n": [times.tobytes()], "home_who": [who[several].tobytes()]}
        yield _rows(docs, _CHUNK_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            want = batch.column(2).to_pylist() if full else None
            for i, s in _sets_of(batch, 1, shingle):
                node = node_of(s)
                if full and node != want[i]:
                    continue
                sent = s if full else s[: shown(len(s))]
                held.append((ids[i], len(s), node, sent))
                size += len(sent)
                if size >= chunk_size or len(held) >= 60_000:
                    yield from flush(chunk, held)
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield from flush(chunk, held)

    return run


def _count(full: bool):
    """A bucket's tokens, counted over all chunks; every chunk is told which of its own occur more than once."""
    names = [x.split()[0] for x in _ANSWER_DDL.split(", ")]
    kinds = {c: _CHUNK_COLUMNS.get(c, pa.binary()) for c in names}

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = key[0].as_py()
        if bucket < 0:
            for batch in batches:
                yield pa.record_batch([batch.column(c) if c in batch.schema.names else pa.nulls(batch.num_rows, t) for c, t in kinds.items()], names)
            return
        chunks, parts, lengths = [], [], []
        for batch in batches:
            chunks += batch.column("chunk").to_pylist()
            for c in zip(*(batch.column(x).to_pylist() for x in ("one", "who", "more", "times")), strict=True):
                one, who, more, times = (np.frombuffer(v, k) for v, k in zip(c, ("<u4", np.uint16, "<u4", np.uint32), strict=True))
                parts.append((np.concatenate([one, more]), np.concatenate([np.ones(len(one), np.uint32), times]), who))
                lengths.append(len(one) + len(more))
        tokens = np.concatenate([p[0] for p in parts])
        order = np.argsort(tokens)
        sorted_ = tokens[order]
        start = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        weight = np.concatenate([p[1] for p in parts]).astype(np.int64)[order]
        df = np.empty(len(tokens), dtype=np.uint32)
        df[order] = np.repeat(np.minimum(np.add.reduceat(weight, start), 2**32 - 1), np.diff(np.append(start, len(tokens))))
        out: dict[str, list] = {c: [] for c in ("chunk", "key", "who", "df")}
        at = 0
        for chunk, (t, _, who), n in zip(chunks, parts, lengths, strict=True):
            own = df[at : at + n]
            at += n
            told = np.flatnonzero(own > 1) if full else np.flatnonzero(own[: len(who)] > 1)
            if len(told):
                places = np.concatenate([who, np.full(n - len(who), 65535, np.uint16)])[told]
                out["chunk"].append(chunk)
                out["key"].append((t[told].astype(np.uint64) | np.uint64(bucket << 32)).tobytes() if full else None)
                out["who"].append(places.tobytes())
                out["df"].append(own[told].tobytes() if full else None)
        if out["chunk"]:
            yield _rows(out, kinds)

    return run


def _gather(batches: Iterator[pa.RecordBatch]):
    """The row of a chunk's documents, and the answers that came back to it."""
    docs, answers = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["ids"] is not None:
                docs = row
            else:
                answers.append(row)
    return docs, answers


def _first_settled(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, answers = _gather(batches)
    sizes, common = np.frombuffer(docs["sizes"], np.int64), np.frombuffer(docs["local"], np.int64).copy()
    for a in answers:
        common += np.bincount(np.frombuffer(a["who"], np.uint16), minlength=len(common))
    nodes = [docs["nodes"][i : i + 16] for i in range(0, len(docs["nodes"]), 16)]
    alive = (sizes > 0) & (common >= sizes // DEN + 1)
    yield pa.record_batch([pa.array(docs["ids"], pa.int64()), pa.array(sizes), pa.array(nodes, pa.binary()), pa.array(alive)], ["doc_id", "n", "node", "alive"])


def bitmap(keys: np.ndarray) -> np.ndarray:
    """Four to eight bits a key in 64-bit words, so that long sets are told apart as well as short ones."""
    bits = np.zeros(1 << max(6, int(4 * len(keys) - 1).bit_length()), dtype=np.uint8)
    bits[(keys & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


_SETTLED = {"kind": pa.int32(), "node": pa.binary(), "n": pa.int64(), "m": pa.int64(), "token": pa.int64(), "pos": pa.int64(), "bits": pa.list_(pa.int64())}


def _settled(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each set with enough tokens in others: kind 0 the set (n tokens, m of them in others, their bitmap), 1 its
    prefix tokens and places, 2 its minimum hashes."""
    docs, answers = _gather(batches)
    sizes = np.frombuffer(docs["sizes"], np.int64)
    k, w, d = (np.concatenate([np.empty(0, t), *(np.frombuffer(a[c], t) for a in answers)]) for c, t in (("key", np.uint64), ("who", np.uint16), ("df", np.uint32)))
    again, home, times = w == 65535, np.frombuffer(docs["home"], np.uint64), np.frombuffer(docs["home_n"], np.uint32)
    df = np.zeros(len(home), np.uint32)
    df[np.searchsorted(home, k[again])] = d[again]
    keys = np.concatenate([k[~again], np.repeat(home, times)])
    who = np.concatenate([w[~again], np.frombuffer(docs["home_who"], np.uint16)])
    df = np.concatenate([d[~again], np.repeat(df, times)])
    order = np.lexsort((keys, df, who))
    keys, who = keys[order], who[order]
    edge = np.searchsorted(who, np.arange(len(sizes) + 1))
    out: dict[str, list] = {c: [] for c in _SETTLED}
    size = 0
    for i, n in enumerate(sizes.tolist()):
        own = keys[edge[i] : edge[i + 1]]
        m, node = len(own), docs["nodes"][16 * i : 16 * i + 16]
        if DEN * m < NUM * n:
            continue
        first = own[: max(0, n // DEN + 1 - (n - m))].view(np.int64).tolist()
        least = [int(mix(own, 60 + s).min().view(np.int64)) for s in range(SEEDS)]
        r = 1 + len(first) + SEEDS
        columns = ([0] + [1] * len(first) + [2] * SEEDS, [node] * r, [n] * r, [m] * r, [None, *first, *least], [None, *range(n - m, n - m + len(first)), *range(SEEDS)], [bitmap(own)] + [None] * (r - 1))
        for c, v in zip(out.values(), columns, strict=True):
            c += v
        size += r + m // 8
        if size > 50_000:
            yield _rows(out, _SETTLED)
            out, size = {c: [] for c in _SETTLED}, 0
    yield _rows(out, _SETTLED)


def _buckets(tokens: float) -> tuple[int, int]:
    """Bits of the bucket number and tokens of a chunk for so many tokens in all.

    Buckets follow the input, so that one holds some ``PER_BUCKET`` tokens whatever there is. A chunk gives each bucket a
    row of some 128 tokens, up to the ``MOST_CHUNK`` tokens that a task holds; beyond that rows get shorter, and in
    the end a row is a token, as in a plain shuffle of tokens."""
    bits = min(MOST_BITS, max(0, int(tokens // PER_BUCKET).bit_length()))
    return bits, min(max(CHUNK, 128 << bits), MOST_CHUNK)


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def room(m: int, x: np.ndarray, y: np.ndarray) -> int:
    """At most so many of the ``m`` tokens behind the bitmap x can be among those behind y."""
    words = min(len(x), len(y))
    return m - int(np.bitwise_count(_fold(x, words) & ~_fold(y, words)).sum())


def _may_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, room) of those (a, b, na, ma, x, nb, mb, y) whose bitmaps leave room for the overlap."""
    for batch in batches:
        na, ma, nb, mb = (batch.column(c).to_numpy() for c in ("na", "ma", "nb", "mb"))
        x, y = batch.column("x"), batch.column("y")
        both = np.empty(batch.num_rows)
        for i in range(batch.num_rows):
            p, q = x[i].values.to_numpy().view(np.uint64), y[i].values.to_numpy().view(np.uint64)
            both[i] = min(room(ma[i], p, q), room(mb[i], q, p))
        keep = pa.array(both * (NUM + DEN) >= NUM * (na + nb))
        found = pa.record_batch([batch.column("a"), batch.column("b"), pa.array(both / np.maximum(na + nb, 1))], ["a", "b", "room"])
        yield found.filter(keep)


def _groups_may_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (node, open, n, m, bits, least, union) those whose group may hold a partner: of the least size that can
    link, and with all of the node's tokens that the union leaves."""
    for batch in batches:
        n, m, least = (batch.column(c).to_numpy() for c in ("n", "m", "least"))
        least = np.maximum(least, -(-n * NUM // DEN))
        most = np.asarray([room(m[i], batch.column("bits")[i].values.to_numpy().view(np.uint64), batch.column("union")[i].values.to_numpy().view(np.uint64)) for i in range(batch.num_rows)], dtype=np.int64)
        yield batch.select(["node", "open"]).filter(pa.array(most * (NUM + DEN) >= NUM * (n + least)))


def _open(every: bool):
    """Pairs (a, b, open, room) of blocks (open, asks, members) whose bitmaps leave room: each asking node's best, or all."""
    names = ["a", "b", "open", "room"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asks, members = batch.column("asks")[i].as_py(), batch.column("members")[i].as_py()
                by_words: dict[int, list] = {}
                for y in members:
                    by_words.setdefault(len(y["bits"]), []).append(y)
                sides = [(w, np.asarray([y["bits"] for y in ys], np.int64).view(np.uint64), *(np.asarray([y[c] for y in ys]) for c in ("n", "m")), [y["node"] for y in ys]) for w, ys in by_words.items()]
                out: list[list] = [[], [], []]
                for x in asks:
                    bits, found = np.asarray(x["bits"], np.int64).view(np.uint64), []
                    for w, ys, n, m, nodes in sides:
                        words = min(w, len(bits))
                        p, q = _fold(bits, words), ys if words == w else np.bitwise_or.reduce(ys.reshape(len(ys), -1, words), axis=1)
                        both = np.minimum(x["m"] - np.bitwise_count(p & ~q).sum(axis=1), m - np.bitwise_count(q & ~p).sum(axis=1))
                        fits = (both * (NUM + DEN) >= NUM * (n + x["n"])) & (n * DEN >= x["n"] * NUM) & (n * NUM <= x["n"] * DEN)
                        found += [(both[j] / (n[j] + x["n"]), nodes[j]) for j in np.flatnonzero(fits)]
                    for r, b in found if every else [max(found)] if found else []:
                        for column, value in zip(out, (x["node"], b, float(r)), strict=True):
                            column.append(value)
                a, b, r = out
                yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([batch.column("open")[i].as_py()] * len(a), pa.binary()), pa.array(r, pa.float64())], names)

    return run


def _tokens_of(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(1).to_pylist()
            out: list[list] = [[], []]
            size = 0
            for i, s in _sets_of(batch, 0, shingle):
                if len(s) and node_of(s) == want[i]:
                    out[0].append(want[i])
                    out[1].append(s.tobytes())
                    size += 8 * len(s)
                if size > 4 << 20:
                    yield _batch(out)
                    out, size = [[], []], 0
            yield _batch(out)

    def _batch(out):
        return pa.record_batch([pa.array(c, pa.binary()) for c in out], ["node", "tokens"])

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, dtype=bool)
        for i in range(batch.num_rows):
            x = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)
            y = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = DEN * both >= NUM * (len(x) + len(y) - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def verified(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The rows (a, b) of ``pairs`` that link, by their whole token sets, made anew from texts(doc_id, node, text)."""
    pairs = materialize(pairs.select("a", "b").distinct())
    wanted = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    read = texts.join(small_side(wanted), "node").select("text", "node")
    sets = materialize(read.mapInArrow(_tokens_of(shingle), "node binary, tokens binary"))
    full = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return materialize(full.mapInArrow(_exact, "a binary, b binary"))


def best_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.max_by("b", F.struct("room", "b")).alias("b"))


def unions(member: DataFrame) -> DataFrame:
    """(open, union) for rows member(node, comp, size, bits): the bitmaps of a group's members in one, folded to the
    shortest. Its words are merged by pre-aggregation; no task sees all members of a group."""
    many = member.where("size > 1")
    words = small_side(materialize(many.groupBy("comp").agg(F.min(F.size("bits")).alias("words"))))
    each = many.join(words, "comp").select("comp", "words", F.posexplode("bits").alias("i", "word"))
    merged = each.groupBy("comp", (F.col("i") % F.col("words")).alias("i")).agg(F.bit_or("word").alias("word"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "word")))
    merged = merged.groupBy("comp").agg(F.transform(ordered, lambda r: r["word"]).alias("union"))
    return merged.union(member.where("size = 1").select("comp", "bits")).toDF("open", "union")


def candidates(prefixes: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, open): groups that share a prefix token with a node of a smaller group, where sizes and the token's
    places leave room. prefixes(token, node, n, pos); groups(node, comp, size) of nodes in groups of two or more.

    With the first common token at place ``pos`` of the node's order the overlap is at most n - pos, and has to reach
    (n + n') * NUM / (NUM + DEN): checked against the least size that a token's rows or a group's have, from both sides.
    """
    rows = prefixes.join(small_side(groups), "node", "left")
    rows = rows.select("token", "node", "n", "pos", F.coalesce("comp", "node").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"))
    reach = F.col("n") * DEN - F.col("pos") * (NUM + DEN)
    rows = materialize(rows)
    spread = rows.groupBy("token").agg(F.min("n").alias("least"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    rows = rows.join(materialize(spread.select("token", "least")), "token")
    rows = materialize(rows.where(reach >= F.greatest(F.col("least"), F.ceil(F.col("n") * NUM / DEN)) * NUM).drop("least"))
    spread = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    rows = materialize(rows.join(materialize(spread.select("token")), "token"))
    other = rows.groupBy("token", F.col("comp").alias("open")).agg(
        F.first("size").alias("others"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("pos").alias("at")
    )
    smaller = F.struct("size", "comp") < F.struct("others", "open")
    early = (reach >= F.col("least") * NUM) & (F.col("most") * DEN - F.col("at") * (NUM + DEN) >= F.col("n") * NUM)
    fits = (F.col("n") * DEN >= F.col("least") * NUM) & (F.col("most") * DEN >= F.col("n") * NUM)
    asked = rows.join(materialize(other), "token").where(smaller & early & fits)
    return asked.select("node", "open").distinct()


def blocks(rows: DataFrame, group: str, name: str) -> DataFrame:
    """Rows (group, node, n, m, bits) to rows (group, name): lists of about ``BLOCK`` nodes of a group."""
    of = small_side(materialize(rows.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).alias("_b"))))
    dealt = rows.join(of, group).withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_b")))
    return dealt.groupBy(group, "_b").agg(F.collect_list(F.struct("node", "n", "m", "bits")).alias(name)).drop("_b")


def sized(links: DataFrame) -> DataFrame:
    """(node, comp, size) of all nodes with a link."""
    groups = materialize(components(links))
    return materialize(groups.join(small_side(materialize(groups.groupBy("comp").agg(F.count("*").alias("size")))), "comp").select("node", "comp", "size"))


def link_nodes(sets: DataFrame, prefixes: DataFrame, marks: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Links (a, b) that join all nodes of a component, for nodes sets(node, n, m, bits)."""
    a = sets.toDF("a", "na", "ma", "x")
    b = sets.toDF("b", "nb", "mb", "y")
    # groups: every node against the leader that most of its minimum hashes give it; a leader has few tokens of its own
    lead = marks.groupBy("pos", "token").agg(F.min(F.struct(F.col("n") - F.col("m"), "node")).alias("lead"), F.count("*").alias("k")).where("k > 1")
    lead = small_side(materialize(lead.select("pos", "token", F.col("lead.node").alias("b"))))
    first = marks.withColumnRenamed("node", "a").join(lead, ["pos", "token"]).where("a <> b").select("a", "b").distinct()
    first = materialize(first.join(a, "a").join(b, "b").mapInArrow(_may_reach, "a binary, b binary, room double"))
    links = verified(best_pairs(first), texts, shingle)
    groups = sized(links)

    # the matrix, and the nodes that its bounds let through to a group
    member = sets.join(small_side(groups), "node", "left")
    member = materialize(member.select("node", "n", "m", "bits", F.coalesce("comp", "node").alias("comp"), F.coalesce("size", F.lit(1)).alias("size")))
    asked = materialize(candidates(prefixes, groups))
    least = member.groupBy(F.col("comp").alias("open")).agg(F.min("n").alias("least"))
    matrix = materialize(unions(member).join(least, "open"))
    query = asked.join(sets, "node").join(matrix, "open").select("node", "open", "n", "m", "bits", "least", "union")
    asked = materialize(query.mapInArrow(_groups_may_reach, "node binary, open binary"))
    # a group is joined by one link: each asking node's best member comes first, then all members of groups still apart
    for every in (False, True):
        if not asked.limit(1).count():
            break
        wanted = small_side(materialize(asked.select(F.col("open").alias("comp")).distinct()))
        asks = blocks(asked.join(sets, "node"), "open", "asks")
        members = blocks(member.join(wanted, "comp").select(F.col("comp").alias("open"), "node", "n", "m", "bits"), "open", "members")
        found = materialize(asks.join(materialize(members), "open").mapInArrow(_open(every), "a binary, b binary, open binary, room double"))
        more = verified(found if every else best_pairs(found.withColumn("a", F.struct("a", "open"))).select("a.a", "b"), texts, shingle)
        links = links.union(more)
        if not every:
            now = materialize(components(links))
            asked = found.select(F.col("a").alias("node"), "open").distinct()
            asked = asked.join(small_side(now.toDF("node", "cn")), "node", "left").join(small_side(now.toDF("open", "co")), "open", "left")
            asked = materialize(asked.where(F.coalesce("cn", "node") != F.coalesce("co", "open")).select("node", "open"))
    return links


def link(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text).

    Words are runs of characters other than ASCII white space, A-Z in lower case; a set holds the distinct
    ``shingle``-word sequences of the whole text, or the whole sequence of a shorter text. Two rows link when their
    sets reach a Jaccard similarity of 0.8; component_id is the least doc_id reachable by links. Null, empty and blank
    texts have no set and link with nothing; a row without doc_id links with nothing but counts its set. Rows that
    repeat are copies and link. Other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] / 6  # a word and its space
    bits, chunk = _buckets(total * 2 / DEN)
    dealt = texts.mapInArrow(_deal(shingle, bits, chunk, False), _CHUNK_DDL)
    counted = dealt.groupBy("bucket").applyInArrow(_count(False), _ANSWER_DDL)
    rows = materialize(counted.groupBy("chunk").applyInArrow(_first_settled, "doc_id long, n long, node binary, alive boolean"))
    open_ = rows.where("alive and doc_id is not null")
    nodes = materialize(open_.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")))

    # the sets that are left show all tokens; one text stands for each set
    reps = small_side(nodes.select("node", F.col("rep").alias("doc_id")))
    bits, chunk = _buckets(nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    left = texts.join(reps, "doc_id").select("doc_id", "text", "node").sortWithinPartitions("doc_id", "node")
    counted = left.mapInArrow(_deal(shingle, bits, chunk, True), _CHUNK_DDL).groupBy("bucket").applyInArrow(_count(True), _ANSWER_DDL)
    settled = counted.groupBy("chunk").applyInArrow(_settled, "kind int, node binary, n long, m long, token long, pos long, bits array<long>")
    settled = materialize(settled)
    sets = settled.where("kind = 0").dropDuplicates(["node"]).select("node", "n", "m", "bits")
    sets = materialize(sets)
    prefixes = settled.where("kind = 1").select("token", "node", "n", "pos")
    marks = settled.where("kind = 2").select("token", "node", "n", "m", "pos")
    known = small_side(materialize(sets.select("node").join(nodes, "node").select("node", F.col("rep").alias("doc_id"))))
    links = link_nodes(sets, prefixes, marks, texts.join(known, "doc_id"), shingle)

    comps = components(links)
    placed = materialize(nodes.join(small_side(materialize(comps)), "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp")))
    least = materialize(placed.groupBy("comp").agg(F.min("rep").alias("component_id")))
    where = small_side(materialize(placed.join(least, "comp").select("node", "component_id")))
    out = rows.withColumn("node", F.when(F.col("alive") & F.col("doc_id").isNotNull(), F.col("node"))).join(where, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
