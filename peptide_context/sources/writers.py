"""Writers: tables, BED and FASTA as text by Spark's own sinks, models by their own format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, sort: list[str] | None = None) -> None:
    """A tab-separated table with a header; sorted over all part files by ``sort`` if given."""
    (df.orderBy(*sort) if sort else df).write.csv(path, sep="\t", header=True)


def write_bed(df: DataFrame, path: str) -> None:
    """BED6 from chrom, start0, end0, name, strand and, if there, score."""
    score = F.col("score").cast("string") if "score" in df.columns else F.lit(".")
    df.select("chrom", "start0", "end0", "name", score.alias("score"), "strand").write.csv(path, sep="\t", header=False)


def fasta_record(name: Column, seq: Column, width: int | None = 60) -> Column:
    """One record: a header line and the sequence, wrapped at ``width`` if given."""
    body = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n") if width else seq
    return F.concat(F.lit(">"), name, F.lit("\n"), body)


def write_fasta(df: DataFrame, path: str, name: str = "id", seq: str = "seq", width: int | None = 60) -> None:
    df.select(fasta_record(F.col(name), F.col(seq), width).alias("value")).write.text(path)


def write_genome(chunks: DataFrame, path: str, width: int = 60) -> None:
    """FASTA of chromosomes from chunks (chrom, chunk_id, seq), wrapped at ``width`` inside a chunk.

    A row is a chunk, with the header in front of the first of a chromosome; rows are written in the order of (chrom, chunk_id), a
    chromosome in one file, and as many files as there are chromosomes or partitions. No chromosome is put together in a row.
    """
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    line = F.when(F.col("chunk_id") == 0, F.concat(F.lit(">"), "chrom", F.lit("\n"), body)).otherwise(body)
    ordered = chunks.repartition("chrom").sortWithinPartitions("chrom", "chunk_id")
    ordered.select(line.alias("value")).write.text(path)


def save_model(model, columns: list[str], path: str) -> None:
    """A fitted pyspark.ml model and the names of its feature columns in order, replacing what is there."""
    model.write().overwrite().save(f"{path}/model")
    rows = SparkSession.active().createDataFrame(list(enumerate(columns)), "place int, name string")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")


def save_pwm(pwm: DataFrame, path: str) -> None:
    """A position weight matrix in long form (pos, aa, logodds)."""
    pwm.write.mode("overwrite").parquet(path)
