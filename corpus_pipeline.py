"""A training-data pipeline over the table documents: language ID, line dedup, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peptide_context.llm.common import field, fields_of, materialize, small_side, whole_row
from peptide_context.llm.langid import fit, keep_accepted
from peptide_context.llm.line_dedup import dedup_lines
from peptide_context.llm.mixing import mix
from peptide_context.llm.ngram_join import link
from peptide_context.llm.packing import pack_documents
from peptide_context.llm.registry import tokenizer_path
from peptide_context.operators.components import step


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null, empty and blank texts among them) and those that no learned language explains.

    Where no row says its language, nothing can be learned, and all documents with a letter stay. Every row is judged by
    its text alone: repeated rows share their fate, ids do not matter. An empty table stays empty."""
    return keep_accepted(docs, fit(docs.select("lang", "text")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that an earlier document has: up to one edit, or exactly for short lines; every document stays.

    Earlier is by doc_id, null first. Null texts stay null, and a text that loses all its lines becomes empty; n_chars follows.
    Rows that are the same in doc_id and text both keep the lines that come first there; an empty table stays empty."""
    return dedup_lines(docs, short=True).select(*map(field, docs.columns))


def row_key(docs: DataFrame) -> Column:
    """Hash of all columns: rows with equal keys are the same in everything, so that it does not matter which of them
    a decision falls on. doc_id alone does not tell rows apart; it may be null or repeated."""
    return F.xxhash64(*map(field, docs.columns))


def with_key(docs: DataFrame) -> DataFrame:
    """(_row, _key): rows as structs, so that no column of theirs meets one of ours."""
    return docs.select(whole_row(docs), row_key(docs).alias("_key"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id (null last) of each group of near copies.

    Documents without doc_id, or with that of another document, are judged by their texts like all others. Documents
    without a word link with nothing, and all stay. Rows that are the same in all columns are copies: one of them stays.
    An empty table stays empty.
    """
    keyed = with_key(docs)
    groups = materialize(link(keyed.select(F.col("_key").alias("doc_id"), F.col("_row.text").alias("text"))))
    member = groups.where("n_shingles > 0").groupBy(F.col("doc_id").alias("_key")).agg(F.count("*").alias("_rows"), F.min("component_id").alias("_group"))
    member = materialize(member)
    shared = small_side(materialize(member.groupBy("_group").agg(F.count("*").alias("_n")).where("_n > 1").select("_group")))
    linked = small_side(materialize(member.join(shared, "_group").select("_key", "_group")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    linked = materialize(keyed.select("_row.doc_id", "_key").join(linked, "_key").select("_group", order.alias("_at")).distinct())
    first = small_side(materialize(linked.groupBy("_group").agg(F.min("_at").alias("_first"))))
    gone = materialize(linked.join(first, "_group").where("_at <> _first").select("_at._key"))
    kept = keyed.join(small_side(gone), "_key", "left_anti")
    again = materialize(member.where("_rows > 1").select("_key"))
    if again.limit(1).count():
        again = small_side(again)
        kept = kept.join(again, "_key", "left_anti").unionByName(kept.join(again, "_key", "left_semi").dropDuplicates(["_key"]))
    return kept.select(*fields_of(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none to three times. Rows that are the same in all columns are
    interchangeable: one of them stands for all, as often as the mix takes them together. Documents without a word (null,
    empty, blank) are not taken; a null source is a source of its own; ties go by a seeded hash of the row; an empty table
    stays empty."""
    keyed = with_key(docs)
    took = mix(keyed.select(F.col("_key").alias("doc_id"), "_row.text", "_row.source")).where("taken > 0")
    took = took.groupBy(F.col("doc_id").alias("_key")).agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("_copies"))
    took = materialize(took)
    repeated = materialize(keyed.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key"))
    if repeated.limit(1).count():
        repeated = small_side(repeated)
        keyed = keyed.join(repeated, "_key", "left_anti").unionByName(keyed.join(repeated, "_key", "left_semi").dropDuplicates(["_key"]))
    full = keyed.join(small_side(took), "_key")
    return full.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select(*fields_of(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their ids, packed into sequences of 2048: (doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, ids). ids is binary, little-endian unsigned 32-bit.

    A text that is null or empty is one piece with the end mark; repeated rows are each packed, and rows with a null doc_id
    keep it; pieces of one length are interchangeable; an empty table gives no rows."""
    return pack_documents(docs, tokenizer_path(), ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL expresses neither the language models nor the knapsack and packing plans.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and read again by the next. What a stage writes on
    its way is removed when its rows are there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with step(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir))
    return docs
