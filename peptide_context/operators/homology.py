"""Peptides to precursors: cleaning, clustering, similarity search, best hit."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import gene_symbol, kmers
from .components import materialize, small_side
from .ungapped import Index, Texts, best_diagonals, equal_residues, first_of

BLOCK_RESIDUES = 1 << 20  # of the peptides that one unit of a search holds
LANE_RESIDUES = 4 << 20  # of the proteins that it holds
SEED = 7  # residues of a block that are looked up in a search for similar peptides, at most


def clean_peptides(seqs: DataFrame) -> DataFrame:
    """(id, seq, ord) without repeated sequences: the record with the least ``ord`` stays."""
    kept = F.min_by(F.struct("id", "seq", "ord"), F.struct("ord", "id")).alias("r")
    return seqs.groupBy("seq").agg(kept).select("r.*")


def best_precursor(hits: DataFrame, min_pident: float = 90.0, min_cov: float = 0.8) -> DataFrame:
    """One row a peptide: its hit of the highest bit score among those with enough identity and coverage.

    Ties go to the least ``ord``. Coverage is alignment length over query length (at least 1). max_by combines
    before the shuffle, so a query with very many hits is no hot task.
    """
    cov = F.col("length") / F.greatest(F.col("qlen"), F.lit(1))
    passed = hits.withColumn("query_cov", cov).where((F.col("pident") >= min_pident) & (F.col("query_cov") >= min_cov))
    row = F.struct("sseqid", "stitle", "pident", "query_cov", "slen", "evalue", "full_sseq", "ord")
    best = passed.groupBy("qseqid").agg(F.max_by(row, F.struct(F.col("bitscore"), -F.col("ord"))).alias("r"))
    return best.select(
        F.col("qseqid").alias("peptide_id"),
        F.col("r.sseqid").alias("precursor_id"),
        gene_symbol(F.col("r.stitle")).alias("gene_symbol"),
        F.col("r.pident").alias("pident"),
        F.col("r.query_cov").alias("query_cov"),
        F.col("r.slen").alias("precursor_len"),
        F.col("r.evalue").alias("evalue"),
        F.col("r.stitle").alias("stitle"),
        F.col("r.full_sseq").alias("full_sseq"),
        F.col("r.ord").alias("ord"),
    )


def unique_precursors(best: DataFrame) -> DataFrame:
    """(id, seq): one sequence a precursor of ``best_precursor``, from its first hit, without gaps."""
    first = F.min_by("full_sseq", "ord").alias("s")
    return best.groupBy(F.col("precursor_id").alias("id")).agg(first).select("id", F.replace(F.col("s"), F.lit("-"), F.lit("")).alias("seq"))


def _letters(seq: Column, ignore_case: bool = True) -> Column:
    """Sequences as they are compared: one byte a residue, so that places in bytes are places; others than ASCII become ``?``."""
    plain = F.regexp_replace(F.coalesce(seq, F.lit("")), r"[^\x00-\x7F]", "?")
    return F.upper(plain) if ignore_case else plain


def _bytes(column: pa.ChunkedArray) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _dealt(df: DataFrame, name: str, residues: int, least: int = 1) -> tuple[DataFrame, int]:
    """``df`` with a number ``name`` that deals its rows by id into parts of about ``residues``, and how many parts there are."""
    n = max(least, -(-df.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0] // residues))
    return df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n


_FOUND = "qseqid string, sseqid string, diagonal int, seeds int, same int, qlo int, overlap int, qlen int, slen int"


def homology_hits(
    peptides: DataFrame, proteome: DataFrame, k: int = 5, seeds: int = 2, max_targets: int = 5, ignore_case: bool = True,
    match: float = 5.0, mismatch: float = -2.0, scale: tuple[float, float] = (0.318, 0.134), max_evalue: float | None = None,
) -> DataFrame:
    """Peptides (id, seq) against proteins (id, seq, and a title if there is one) by shared k-mers, ungapped.

    A pair's best diagonal is the one with most seeds (ties: the least); identity is counted over the overlap on it.
    Returns at most ``max_targets`` rows a peptide, by equal residues, then target id: (qseqid, sseqid, diagonal,
    seeds, same, pident, length, qlen, slen, qstart, sstart, bitscore, evalue, stitle, full_sseq, ord), which
    ``best_precursor`` takes. The score is ``match`` for an equal residue and ``mismatch`` for another; bits and the
    expected number of such hits follow from it by the constants ``scale`` (lambda, K) and the residues of the proteome;
    hits above ``max_evalue`` are left out. Lower-case letters count as upper-case ones unless ``ignore_case`` is off; characters
    beyond ASCII are all one unknown letter. A peptide needs ``seeds`` common k-mers, or all of its own if it has fewer; one
    shorter than ``k`` (at most 9) finds nothing. Ids are taken to be unique. This is a stated ungapped search, not a gapped aligner.

    Scale: the peptides are a set of queries against all proteins, in blocks. A unit of work holds a block of peptides with its
    index of k-mers and a lane of proteins, both of bounded size; it finds diagonals, compares residues and keeps the best
    ``max_targets`` of each peptide there. No pair leaves it but those, so common k-mers cost time but move nothing, and
    none is left out.
    """
    title = F.col("title") if "title" in proteome.columns else F.lit("")
    named = proteome.select("id", F.col("seq").alias("full"), title.alias("title"))
    p = materialize(peptides.select("id", _letters(F.col("seq"), ignore_case).alias("seq")).where("id is not null"))
    t = materialize(proteome.select("id", _letters(F.col("seq"), ignore_case).alias("seq")).where("id is not null"))
    total = float(t.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0])
    p, blocks = _dealt(p, "block", BLOCK_RESIDUES)
    t, lanes = _dealt(t, "lane", LANE_RESIDUES, 2 * p.sparkSession.sparkContext.defaultParallelism)
    p = p.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    t = t.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def bits(same, overlap):
        return ((same * match + (overlap - same) * mismatch) * scale[0] - np.log(scale[1])) / np.log(2.0)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, targets = Texts(_bytes(left["seq"]), k), Texts(_bytes(right["seq"]), k)
        names = np.array(_bytes(right["id"]), object)
        rank = np.empty(len(names), np.int64)
        rank[np.argsort(names, kind="stable")] = np.arange(len(names))
        kept = np.empty((7, 0), np.int64)
        for found in best_diagonals(Index(queries), targets, k, seeds):
            rows = np.array(found, np.int64)
            if max_evalue is not None:
                rows = rows[:, queries.size[rows[1]] * total * 2.0 ** -bits(rows[4], rows[6]) <= max_evalue]
            kept = np.concatenate([kept, rows], axis=1)
            kept = kept[:, np.lexsort((rank[kept[0]], -kept[4], kept[1]))]
            start = first_of(kept[1])
            kept = kept[:, np.arange(kept.shape[1]) - np.repeat(start, np.diff([*start, kept.shape[1]])) < max_targets]
        target, query, d, n, same, lo, overlap = kept
        numbers = [pa.array(x, pa.int32()) for x in (d, n, same, lo, overlap, queries.size[query], targets.size[target])]
        names = [left["id"].combine_chunks().take(pa.array(query)), right["id"].combine_chunks().take(pa.array(target))]
        return pa.table([*names, *numbers], [c.split()[0] for c in _FOUND.split(", ")])

    found = p.groupBy("block", "lane").cogroup(t.groupBy("block", "lane")).applyInArrow(search, _FOUND)
    by = Window.partitionBy("qseqid").orderBy(F.col("same").desc(), "sseqid")
    found = materialize(found.withColumn("ord", F.row_number().over(by)).where(F.col("ord") <= max_targets))
    score = F.col("same") * match + (F.col("overlap") - F.col("same")) * mismatch
    found = found.withColumn("bitscore", (score * scale[0] - F.log(F.lit(scale[1]))) / F.log(F.lit(2.0)))
    found = found.withColumn("evalue", F.col("qlen") * F.lit(total) * F.pow(F.lit(2.0), -F.col("bitscore")))
    found = named.join(small_side(found), F.col("id") == F.col("sseqid"))
    return found.select(
        "qseqid", "sseqid", "diagonal", "seeds", "same", (F.col("same") * 100.0 / F.col("overlap")).alias("pident"),
        F.col("overlap").alias("length"), "qlen", "slen", (F.col("qlo") + 1).alias("qstart"), (F.col("qlo") + F.col("diagonal") + 1).alias("sstart"),
        "bitscore", "evalue", F.col("title").alias("stitle"), (F.upper("full") if ignore_case else F.col("full")).alias("full_sseq"), F.col("ord").cast("long").alias("ord"),
    )


def _identities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts equal residues of each pair of sequences on one diagonal."""
    for batch in batches:
        q, s = (Texts(batch.column(c).cast(pa.binary()).to_pylist(), 1) for c in ("a_seq", "b_seq"))
        d = batch.column("diagonal").to_numpy().astype(np.int64)
        lo = np.maximum(0, -d)
        overlap = np.maximum(0, np.minimum(q.size, s.size - d) - lo)
        same = equal_residues(q.data, q.start + lo, s.data, s.start + lo + d, overlap)
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(same, pa.int32())], ["a", "b", "same"])


def similar_peptides(seqs: DataFrame, min_identity: float = 0.9, k: int = 4) -> DataFrame:
    """(a, b) of peptides (id, seq) whose equal residues on some diagonal are at least ``min_identity`` of the shorter one, a.

    Of two equally long ones, a has the greater id. Exact for shorter ones of ``k`` residues and more, as far as a k-mer survives: with m
    residues of n replaced, one of m + 1 equal blocks of the shorter one is undamaged. So each peptide looks up one piece of up to
    ``SEED`` residues of each block, among all pieces of that length of peptides at least as long. Where blocks are shorter than k (low
    identities only), the m * k + 1 rarest k-mers hold an undamaged one, if there are that many; else all are looked up.
    """
    n = F.length("seq")
    most = F.floor(F.col("n") * (1.0 - min_identity) + 1e-9)
    size = F.floor(F.col("n") / (most + 1))
    rows = seqs.select("id", "seq", n.alias("n")).where(n >= k).withColumn("m", most.cast("int"))
    rows = rows.withColumn("w", F.least(size, F.lit(max(k, SEED))).cast("int"))
    blocks = rows.where(F.col("w") >= k).select("id", "seq", "n", "w", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("m")), lambda j: F.floor(j * F.col("n") / (F.col("m") + 1)).cast("int"))).alias("j", "i"))
    own = blocks.select(F.col("id").alias("a"), F.col("n").alias("an"), F.substring("seq", F.col("i") + 1, F.col("w")).alias("kmer"), F.col("i").alias("ai"))
    pieces = lambda size, least: rows.where(F.col("n") >= least).select(F.col("id").alias("b"), F.col("n").alias("bn"), F.posexplode(kmers(F.col("seq"), size)).alias("bi", "kmer"))
    sizes = rows.where(F.col("w") >= k).groupBy("w").agg(F.min("n").alias("least")).collect()
    found = [own.join(reduce(DataFrame.union, [pieces(r["w"], r["least"]) for r in sizes]), "kmer")] if sizes else []  # a piece tells its length
    damaged = rows.where(F.col("w") < k)
    if damaged.limit(1).count():
        every = materialize(rows.select("id", "n", F.posexplode(kmers(F.col("seq"), k)).alias("i", "kmer")))
        often = materialize(every.groupBy("kmer").agg(F.count("*").alias("f")))
        rare = every.join(damaged.select("id", "m"), "id").join(small_side(often), "kmer").groupBy("id", "n", "m").agg(F.array_sort(F.collect_list(F.struct("f", "kmer", "i"))).alias("all"))
        rare = rare.select(F.col("id").alias("a"), F.col("n").alias("an"), F.explode(F.slice("all", F.lit(1), F.col("m") * k + 1)).alias("x"))
        other = every.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("i").alias("bi"), "kmer")
        found.append(rare.select("a", "an", "x.kmer", F.col("x.i").alias("ai")).join(other, "kmer"))
    if not found:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    met = [x.where("a <> b and (bn > an or (bn = an and b < a))").select("a", "b", (F.col("bi") - F.col("ai")).alias("diagonal")) for x in found]
    pairs = materialize(reduce(DataFrame.union, met).distinct())
    rows = rows.select("id", "seq", "n")
    full = pairs.join(rows.select(F.col("id").alias("a"), F.col("seq").alias("a_seq")), "a").join(rows.select(F.col("id").alias("b"), F.col("seq").alias("b_seq")), "b")
    counted = full.select("a", "b", "diagonal", "a_seq", "b_seq").mapInArrow(_identities, "a string, b string, same int").groupBy("a", "b").agg(F.max("same").alias("same"))
    found = counted.join(rows.select(F.col("id").alias("a"), "n"), "a")
    return found.where(F.col("same") >= F.col("n") * min_identity - 1e-9).select("a", "b")


def cluster_peptides(seqs: DataFrame, min_identity: float = 0.9, k: int = 4) -> DataFrame:
    """(id, representative): peptides (id, seq), each under a representative that it shares ``min_identity`` of its residues with.

    Greedy, as if gone through from the longest to the shortest (ties by id): a peptide joins the first representative that it is similar
    to (``similar_peptides``), or else becomes one. So no two representatives are similar, and every member is similar to its own, not
    only through others. Letters count without case; equal sequences share a representative at any length; nulls and empty
    sequences stand for themselves; repeated ids should be removed before.

    Rounds do it in parallel: a peptide becomes a representative once no earlier one that it is similar to is undecided or a representative,
    and those similar to a representative are decided. Rounds go on until all are; each one is a written table.
    """
    seqs = seqs.select("id", F.nullif(_letters(F.col("seq")), F.lit("")).alias("seq"))
    # one peptide stands for its exact copies, so that only different sequences are searched
    distinct = materialize(seqs.where("seq is not null").groupBy("seq").agg(F.min("id").alias("id")))
    edges = materialize(similar_peptides(distinct, min_identity, k))  # a comes after b
    left = materialize(edges.select("a").union(edges.select("b")).distinct().toDF("id"))
    chosen, pending = None, edges
    while left.limit(1).count():
        pending = materialize(pending.join(left.withColumnRenamed("id", "a"), "a", "left_semi").join(left.withColumnRenamed("id", "b"), "b", "left_semi"))
        new = materialize(left.join(pending.select(F.col("a").alias("id")), "id", "left_anti"))
        gone = pending.join(new.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id"))
        chosen = new if chosen is None else chosen.union(new)
        left = materialize(left.join(new, "id", "left_anti").join(gone, "id", "left_anti"))
    first = distinct.select("id", F.col("id").alias("rep"))
    if chosen is not None:
        size = distinct.select(F.col("id").alias("b"), F.length("seq").alias("n"))
        joins = edges.join(chosen.withColumnRenamed("id", "b"), "b", "left_semi").join(chosen.withColumnRenamed("id", "a"), "a", "left_anti").join(size, "b")
        joins = materialize(joins.groupBy(F.col("a").alias("id")).agg(F.min(F.struct((-F.col("n")).alias("n"), "b")).alias("m")).select("id", F.col("m.b").alias("joined")))
        first = first.join(joins, "id", "left").select("id", F.coalesce("joined", "rep").alias("rep"))
    rep = distinct.join(first, "id").select("seq", "rep")
    return seqs.join(rep, "seq", "left").select("id", F.coalesce("rep", "id").alias("representative"))
