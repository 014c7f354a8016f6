"""Readers and writers on small files, and the stateless operators on a stream."""

from pyspark.sql import functions as F

from peptide_context.sources import readers as R
from peptide_context.sources import writers as W
from peptide_context.streaming.stateless import stream_sites


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_fasta(spark, tmp_path):
    path = write(tmp_path, "a.fa", ">a one\nMK\nLV\n\n>b\n\n>a two\r\nGG\r\n")
    assert [(r["id"], r["seq"]) for r in R.read_fasta(spark, path).orderBy("ord").collect()] == [("a", "MKLV"), ("b", ""), ("a", "GG")]
    assert {r["id"]: r["seq"] for r in R.read_fasta(spark, path, "last").collect()} == {"a": "GG", "b": ""}


def test_promoters_and_round_trip(spark, tmp_path):
    path = write(tmp_path, "p.fa", ">g|amp|c1|5|9|-\nACGTA\n")
    assert tuple(R.read_promoters(spark, path).first()) == ("g", "amp", "c1", 5, 9, "-", "ACGTA")
    out = str(tmp_path / "out")
    W.write_fasta(spark.createDataFrame([("x", "A" * 130)], "id string, seq string"), out)
    assert [r["seq"] for r in R.read_fasta(spark, out + "/part-*").collect()] == ["A" * 130]
    assert spark.read.text(out).where(F.length("value") == 60).count() == 2


def test_hits(spark, tmp_path):
    base = "q\ts\t95.0\t9\t10\t50\t1\t9\t1\t9\t1e-9\t77.5"
    path = write(tmp_path, "h.tsv", f"{base}\ttitle GN=X\tMK-L\n{base}\tno seq\n\n{base}\ta\tb\tMKL\n")
    rows = R.read_hits(spark, path).orderBy("ord").collect()
    assert [(r["stitle"], r["full_sseq"]) for r in rows] == [("title GN=X", "MK-L"), ("no seq", ""), ("a\tb", "MKL")]


def test_gff(spark, tmp_path):
    text = "# c\nc\tm\tmRNA\t1\t9\t.\t+\t.\tID=m1;Target=P1 1 3\nc\tm\tCDS\t1\t9\t.\t+\t2\tParent=m1\nshort\n"
    mrna, cds = R.read_gff(spark, write(tmp_path, "a.gff", text))
    assert mrna.first()["protein"] == "P1" and mrna.first()["score"] == 0.0 and cds.first()["phase"] == 2
    genes = "c\te\tgene\t1\t9\t.\t+\t.\tID=1;Name=A\nc\te\tgene\t5\t8\t.\t-\t.\tName=A\nc\te\tgene\t5\t8\t.\t-\t.\tID=2\n"
    assert [tuple(r) for r in R.read_gene_index(spark, write(tmp_path, "g.gff", genes)).collect()] == [("A", "c", 5, 8, "-")]


def test_signal_and_rules(spark, tmp_path):
    text = "#x\nP\td\tSignal peptide\t1\t22.0\nP\td\tsignal\t1\t23\nQ\td\tChain\t1\t9\nR\td\tSignal\t1\tbad\n"
    assert [tuple(r) for r in R.read_signal(spark, write(tmp_path, "s.tsv", text)).collect()] == [("P", 23)]
    rules = R.read_rules(spark, write(tmp_path, "r.tsv", "# c\nA|B\tenzyme\tG\nbad\n"), ["regex", "role", "gene", "note"], 3)
    assert [tuple(r)[:4] for r in rules.collect()] == [("A|B", "enzyme", "G", None)]


def test_bed_and_table(spark, tmp_path):
    bed = spark.createDataFrame([("c", 1, 2, "n", "+")], "chrom string, start0 int, end0 int, name string, strand string")
    W.write_bed(bed, str(tmp_path / "bed"))
    assert spark.read.text(str(tmp_path / "bed")).first()["value"] == "c\t1\t2\tn\t.\t+"
    W.write_table(bed, str(tmp_path / "t"), ["chrom"])
    assert R.read_table(spark, str(tmp_path / "t"), bed.schema).count() == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", "AAKRAA")], "id string, seq string").write.parquet(str(tmp_path / "in"))
    stream = stream_sites(spark.readStream.schema("id string, seq string").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("sites").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sites").where("enzyme = 'PCSK_dibasic'").count() == 1
