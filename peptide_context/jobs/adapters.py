"""The driver's tables read as domain tables: deterministic projections of whole tables and whole texts.

DuckDB's SQL for the same tables is in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import AMINO_ACIDS
from ..functions.sequences import slices
from ..operators.components import spread

CHUNK = 1000
SYMBOLS = ["CAMP", "DEFA1", "DEFB4A", "HTN1", "DCD", "LTF", "."]
GENES = ["PRTN3", "KLK5", "MMP7", "FURIN", "CTSD", "ABCA1", "CAMP", "DEFA1", "DEFB4A", "HTN1", "DCD"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def letters() -> str:
    return "upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', ''))"


def proteins(spark, d) -> DataFrame:
    """(id, seq, n): the text's letters that are residues, in upper case; texts without any are left out.

    One pass over the bytes: those of residues are put in upper case, all others taken out, those of other scripts too."""
    residues = AMINO_ACIDS.encode()
    other = bytes(set(range(256)) - set(residues) - set(residues.lower()))
    upper = bytes(range(256)).upper()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                seqs = [t.translate(upper, other) for t in part.cast(pa.binary()).to_pylist()]
                ids = batch.column(0).slice(at, len(seqs))
                at += len(seqs)
                rows = pa.record_batch([ids, pa.array(seqs, pa.binary()).cast(pa.string())], ["n", "seq"])
                yield rows.filter(pa.array(list(map(bool, seqs)), pa.bool_()))

    texts = table(spark, d, "documents").select(F.col("doc_id").alias("n"), "text")
    return texts.mapInArrow(read, f"n {texts.schema['n'].dataType.simpleString()}, seq string").selectExpr("concat('P', n) AS id", "seq", "n")


def peptides(spark, d) -> DataFrame:
    """(id, seq, ord): a stretch of each protein; some reversed, in lower case, or with a residue replaced."""
    raw = proteins(spark, d).withColumn("p", F.expr("substring(seq, cast(31 + n % 40 AS int), cast(12 + n % 29 AS int))"))
    seq = "CASE WHEN n % 13 = 0 THEN reverse(p) WHEN n % 11 = 0 THEN lower(p) WHEN n % 5 = 0 THEN concat(substring(p, 1, 4), 'W', substring(p, 6)) ELSE p END"
    return raw.where("p <> ''").selectExpr("concat('pep', n) AS id", f"{seq} AS seq", "n AS ord")


def symbol_of(n: str) -> str:
    return "element_at(array(" + ", ".join(f"'{s}'" for s in SYMBOLS) + f"), cast({n} % {len(SYMBOLS)} + 1 AS int))"


def mapping(spark, d) -> DataFrame:
    """(peptide_id, precursor_id, gene_symbol, stitle)."""
    s = symbol_of("doc_id")
    title = "concat('peptide of ', coalesce(source, ''), CASE WHEN doc_id % 3 = 0 THEN ' defensin' ELSE '' END)"
    return table(spark, d, "documents").selectExpr("concat('pep', doc_id) AS peptide_id", "concat('P', doc_id) AS precursor_id", f"{s} AS gene_symbol", f"{title} AS stitle")


def signal_rows(spark, d) -> DataFrame:
    kind = "CASE WHEN doc_id % 3 = 0 THEN 'Chain' ELSE 'Signal peptide' END"
    return table(spark, d, "documents").selectExpr("concat('P', doc_id) AS acc", f"{kind} AS type", "cast(15 + doc_id % 12 AS string) AS end", "doc_id AS ord")


def hits(spark, d) -> DataFrame:
    """Homology hits from line items; ``ord`` stands for the place in a file."""
    return table(spark, d, "lineitem").selectExpr(
        "concat('pep', l_orderkey) AS qseqid", "concat('P', l_partkey) AS sseqid", "80 + l_quantity * 0.4 AS pident",
        "cast(10 + l_linenumber * 3 AS int) AS length", "cast(12 + l_suppkey % 15 AS int) AS qlen", "cast(60 + l_partkey % 200 AS int) AS slen",
        "l_discount AS evalue", "round(l_extendedprice, 2) AS bitscore",
        "concat('protein ', l_returnflag, CASE WHEN l_linestatus = 'O' THEN concat(' GN=G', l_suppkey) ELSE '' END, ' OS=human') AS stitle",
        "concat('MK-', translate(cast(l_partkey AS string), '0123456789', 'ACDEFGHIKL'), '-RR') AS full_sseq",
        "cast(l_linenumber * 1000000000000L + l_partkey * 100000L + l_suppkey AS bigint) AS ord",
    )


def mrna(spark, d) -> DataFrame:
    return table(spark, d, "orders").selectExpr(
        "o_orderkey AS mrna_id", "concat('P', o_custkey) AS protein", "concat('c', o_custkey) AS chrom",
        "CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand", "o_totalprice AS score", "o_orderkey AS ord",
    )


def cds(spark, d) -> DataFrame:
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    rows = table(spark, d, "lineitem").withColumn("r", F.row_number().over(by))
    start = "200L * r + l_partkey % 100"
    return rows.selectExpr("l_orderkey AS mrna_id", f"{start} AS start", f"{start} + 29 + l_suppkey % 90 AS end", "cast(l_linenumber % 3 AS int) AS phase")


def gene_index(spark, d) -> DataFrame:
    names = ", ".join(f"'{g}'" for g in GENES)
    symbol = f"CASE WHEN p_partkey BETWEEN 1 AND {len(GENES)} THEN element_at(array({names}), cast(p_partkey AS int)) ELSE concat('G', p_partkey) END"
    start = "(100 + cast(floor(p_retailprice) AS bigint) % 1500)"
    return table(spark, d, "part").selectExpr(
        f"{symbol} AS symbol", "concat('c', p_partkey) AS chrom", f"{start} AS start", f"{start} + 150 + p_size * 10 AS end",
        "CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand",
    )


def genome(spark, d) -> DataFrame:
    """(chrom, chunk_id, seq): every text's letters as bases, in chunks of ``CHUNK``."""
    dna = f"translate({letters()}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTANGTACGTACGTAC')"
    rows = table(spark, d, "documents").selectExpr("concat('c', doc_id) AS chrom", f"{dna} AS dna").where("dna <> ''")
    rows = rows.withColumn("chunk_id", F.explode(F.sequence(F.lit(0), F.floor((F.length("dna") - 1) / CHUNK))))
    return rows.select("chrom", "chunk_id", F.substring("dna", (F.col("chunk_id") * CHUNK + 1).cast("int"), F.lit(CHUNK)).alias("seq"))
