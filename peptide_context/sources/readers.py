"""Readers. Text formats are read line- or record-wise by Spark's own sources; nothing is parsed on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import materialize, small_side

HIT_SCHEMA = (
    "qseqid string, sseqid string, pident double, length int, qlen int, slen int, qstart int, qend int, "
    "sstart int, send int, evalue double, bitscore double, stitle string, full_sseq string"
)


def _ordered(df: DataFrame) -> DataFrame:
    """Adds ``ord``, which grows with the place in the files as they are listed and split."""
    return df.withColumn("ord", F.monotonically_increasing_id())


def _last_wins(df: DataFrame, key: str) -> DataFrame:
    by = Window.partitionBy(key).orderBy(F.col("ord").desc())
    return df.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def _fasta(spark: SparkSession, path: str) -> DataFrame:
    raw = _ordered(spark.read.option("lineSep", "\n>").text(path))
    record = F.regexp_replace("value", "^>", "")
    head = F.regexp_replace(F.substring_index(record, "\n", 1), r"\r$", "")
    body = F.when(F.instr(record, "\n") > 0, F.substring(record, F.instr(record, "\n") + 1, F.length(record))).otherwise("")
    return raw.select(head.alias("header"), F.regexp_replace(body, r"\s", "").alias("seq"), "ord").where("header <> '' or seq <> ''")


def read_fasta(spark: SparkSession, path: str, on_duplicate: str = "all") -> DataFrame:
    """(id, seq, ord, title): id is the header's first token, title the whole header; blank lines are skipped, lines joined.

    ``on_duplicate``: "all" keeps every record, "last" the last record of an id. White space inside sequence lines
    is dropped. A record is one row; files with very long records, as genomes, are read by ``read_genome``.
    """
    df = _fasta(spark, path).select(F.regexp_extract("header", r"^\s*(\S+)", 1).alias("id"), "seq", "ord", F.col("header").alias("title"))
    return _last_wins(df, "id") if on_duplicate == "last" else df


def read_genome(spark: SparkSession, path: str, chunk_len: int) -> DataFrame:
    """(chrom, chunk_id, seq): the records of FASTA files in chunks of ``chunk_len`` bases, chrom the header's first token.

    Lines are rows, so no task holds a chromosome. A line's record and place in it come from its own split where that has
    the header, else from the splits before: a running sum over one row a split. Files hold whole records.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("f"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), F.rtrim("value").alias("v"))
    head = F.startswith("v", F.lit(">"))
    lines = materialize(lines.withColumn("head", F.when(head, F.regexp_extract("v", r"^>\s*(\S*)", 1))).withColumn("n", F.when(head, 0).otherwise(F.length("v"))))
    # place inside the split, behind its last header before the line (runs of one split and file are a split's work)
    upto = Window.partitionBy("f", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = lines.withColumn("block", F.count("head").over(upto))
    run = Window.partitionBy("f", "part", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("chrom", F.last("head", True).over(upto)).withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    # what each split leaves to the next one: its last record and how much of it, or only more of the record before
    ends = lines.groupBy("f", "part").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("at"))).alias("last"), F.max(F.when(F.col("head").isNotNull(), F.col("at"))).alias("at"), F.min("at").alias("first"))
    tail = lines.join(F.broadcast(ends.withColumnRenamed("at", "_h").drop("first")), ["f", "part"]).where(F.col("_h").isNull() | (F.col("at") > F.col("_h")))
    left = ends.join(tail.groupBy("f", "part").agg(F.sum("n").alias("n")), ["f", "part"], "left")
    earlier = Window.partitionBy("f").orderBy("first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = left.withColumn("k", F.count("last").over(earlier)).withColumn("name", F.last("last", True).over(earlier))
    since = Window.partitionBy("f", "k").orderBy("first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = left.withColumn("so_far", F.sum(F.coalesce("n", F.lit(0))).over(since))
    step = Window.partitionBy("f").orderBy("first")
    carried = small_side(materialize(left.select("f", "part", F.lag("name").over(step).alias("from"), F.lag("so_far").over(step).alias("offset"))))
    rows = inside.where("head is null and n > 0").join(carried, ["f", "part"])
    rows = rows.select(F.coalesce("chrom", "from").alias("chrom"), (F.col("before") + F.when(F.col("chrom").isNull(), F.coalesce("offset", F.lit(0))).otherwise(0)).alias("start"), "v", "n")
    rows = rows.where("chrom is not null").withColumn("chunk_id", F.explode(F.sequence(F.floor(F.col("start") / chunk_len), F.floor((F.col("start") + F.col("n") - 1) / chunk_len))))
    lo = F.greatest(F.col("chunk_id") * chunk_len - F.col("start"), F.lit(0))
    piece = F.substring("v", (lo + 1).cast("int"), F.least(F.lit(chunk_len), (F.col("chunk_id") + 1) * chunk_len - F.col("start") - lo).cast("int"))
    parts = rows.groupBy("chrom", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("start", piece.alias("p")))).alias("a"))
    return parts.select("chrom", "chunk_id", F.array_join(F.transform("a", lambda x: x["p"]), "").alias("seq"))


def read_promoters(spark: SparkSession, path: str) -> DataFrame:
    """(gene, role, chrom, start, end, strand, seq) from FASTA headers with six fields between bars."""
    f = F.split("header", r"\|")
    kinds = [("gene", "string"), ("role", "string"), ("chrom", "string"), ("start", "long"), ("end", "long"), ("strand", "string")]
    return _fasta(spark, path).select(*[f[i].cast(k).alias(n) for i, (n, k) in enumerate(kinds)], "seq")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """The 14-column hit table with ``ord``. Short rows end in nulls; in rows with more than 14 fields the last is the
    sequence and the fields before it are the title, tabs included."""
    raw = _ordered(spark.read.text(path).where(F.trim("value") != ""))
    f, n = F.split("value", "\t"), F.size(F.split("value", "\t"))
    names = [x.strip().split(" ") for x in HIT_SCHEMA.split(",")]
    plain = [F.try_element_at(f, F.lit(i + 1)).try_cast(k).alias(c) for i, (c, k) in enumerate(names[:12])]
    title = F.when(n > 14, F.array_join(F.slice(f, F.lit(13), n - 13), "\t")).otherwise(F.try_element_at(f, F.lit(13)))
    seq = F.when(n > 14, F.element_at(f, -1)).otherwise(F.coalesce(F.try_element_at(f, F.lit(14)), F.lit("")))
    return raw.select(*plain, title.alias("stitle"), seq.alias("full_sseq"), "ord")


def _gff(spark: SparkSession, path: str) -> DataFrame:
    raw = _ordered(spark.read.text(path)).where(~F.startswith("value", F.lit("#")))
    f = F.split("value", "\t")
    names = ["chrom", "source", "type", "start", "end", "score", "strand", "phase", "attrs"]
    return raw.where(F.size(f) >= 9).select(*[f[i].alias(n) for i, n in enumerate(names)], "ord")


def _attr(key: str):
    return F.nullif(F.regexp_extract("attrs", f"(?:^|;){key}=([^;]+)", 1), F.lit(""))


def read_gff(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An alignment GFF as (mrna, cds): mrna (mrna_id, protein, chrom, strand, score, ord), cds (mrna_id, start, end, phase).

    A score that is no number is 0, a missing phase is 0; the protein is the Target's first token.
    """
    rows = _gff(spark, path)
    mrna = rows.where("type = 'mRNA'").select(
        _attr("ID").alias("mrna_id"),
        F.regexp_extract(_attr("Target"), r"^\s*(\S+)", 1).alias("protein"),
        "chrom",
        "strand",
        F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)).alias("score"),
        "ord",
    )
    cds = rows.where("type = 'CDS'").select(
        _attr("Parent").alias("mrna_id"),
        F.col("start").cast("long").alias("start"),
        F.col("end").cast("long").alias("end"),
        F.coalesce(F.col("phase").try_cast("int"), F.lit(0)).alias("phase"),
    )
    return mrna, cds


def read_gene_index(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, chrom, start, end, strand) of rows of type gene with a Name; the last row of a symbol wins."""
    rows = _gff(spark, path).where("type = 'gene'").withColumn("symbol", _attr("Name")).where("symbol is not null")
    last = _last_wins(rows, "symbol")
    return last.select("symbol", "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "strand")


def read_signal(spark: SparkSession, path: str) -> DataFrame:
    """(acc, signal_end) from a GFF-like table; see ``signal_ends``."""
    raw = _ordered(spark.read.text(path)).where(~F.startswith("value", F.lit("#")))
    f = F.split("value", "\t")
    return signal_ends(raw.where(F.size(f) >= 5).select(f[0].alias("acc"), f[2].alias("type"), f[4].alias("end"), "ord"))


def signal_ends(rows: DataFrame) -> DataFrame:
    """(acc, signal_end) from (acc, type, end, ord): types that contain "signal", ends that are numbers, the last wins."""
    end = F.floor(F.col("end").try_cast("double")).cast("int")
    kept = rows.where(F.lower("type").contains("signal")).withColumn("signal_end", end).where("signal_end is not null")
    return _last_wins(kept, "acc").select("acc", "signal_end")


def read_rules(spark: SparkSession, path: str, names: list[str], least: int) -> DataFrame:
    """A table of rules: tab-separated, ``#`` lines skipped, rows of fewer than ``least`` fields dropped."""
    raw = _ordered(spark.read.text(path)).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    f = F.split("value", "\t")
    return raw.where(F.size(f) >= least).select(*[F.try_element_at(f, F.lit(i + 1)).alias(n) for i, n in enumerate(names)], "ord")


def _few(rules: DataFrame, columns: list[str], most: int = 10_000) -> list[tuple]:
    """A rule table as the list that operators take: rules become literals of a plan, so they are few by nature."""
    rows = rules.orderBy("ord").select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a rule table has at most {most} rows")
    return [tuple(r) for r in rows]


def family_rules(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """(pattern, role, gene) of each rule, for ``enzyme_rules``."""
    return _few(read_rules(spark, path, ["pattern", "role", "gene"], 3), ["pattern", "role", "gene"])


def cleavage_motifs(spark: SparkSession, path: str) -> list[tuple[str, str, str, int]]:
    """(enzyme, role, pattern, cut offset) of each motif, for ``scan_cleavage``."""
    rules = read_rules(spark, path, ["enzyme", "role", "pattern", "offset"], 4).withColumn("offset", F.col("offset").cast("int"))
    return _few(rules, ["enzyme", "role", "pattern", "offset"])


def tf_motifs(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(factor, consensus) of each motif, for ``tfbs_hits``."""
    return _few(read_rules(spark, path, ["tf", "consensus"], 2), ["tf", "consensus"])


def load_pwm(spark: SparkSession, path: str) -> DataFrame:
    """A matrix written by ``save_pwm``."""
    return spark.read.parquet(path)


def load_model(spark: SparkSession, path: str):
    """(model, columns) written by ``save_model``."""
    from pyspark.ml.util import DefaultParamsReader

    columns = [r["name"] for r in spark.read.parquet(f"{path}/columns").orderBy("place").collect()]
    return DefaultParamsReader.loadParamsInstance(f"{path}/model", spark.sparkContext), columns


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table with a header line and a given schema."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True)
