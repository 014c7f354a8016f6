"""DuckDB SQL for the registered queries: named steps over the driver's views, put together as common table expressions."""

from __future__ import annotations

from ..functions.constants import (
    AMINO_ACIDS,
    ENZYME_FIELDS,
    FAMILY_RULES,
    HYDROPATHY,
    IUPAC,
    LOCUS_FIELDS,
    POSITION_LABELS,
    PROTEASE_MOTIFS,
    ROLE_PRIORITY,
    TF_MOTIFS,
)
from .adapters import CHUNK, GENES, SYMBOLS
from .saved import node_rows

STEPS: dict[str, tuple[list[str], str]] = {}
SQL: dict[str, str] = {}


def step(name: str, needs: str, sql: str) -> None:
    STEPS[name] = (needs.split(), sql)


def final(name: str, needs: str, sql: str) -> None:
    order: list[str] = []

    def visit(n: str) -> None:
        for m in STEPS[n][0]:
            visit(m)
        if n not in order:
            order.append(n)

    for n in needs.split():
        visit(n)
    SQL[f"q_{name}"] = "WITH " + ",\n".join(f"{n} AS ({STEPS[n][1]})" for n in order) + "\n" + sql


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def count_of(s: str, chars: str) -> str:
    return f"(length({s}) - length(translate({s}, '{chars}', '')))"


def frac(s: str, chars: str) -> str:
    return f"(CASE WHEN length({s}) > 0 THEN {count_of(s, chars)}::DOUBLE / length({s}) ELSE 0.0 END)"


def hyd(s: str) -> str:
    return "(" + " + ".join(f"{count_of(s, a)} * {HYDROPATHY[a]}::DOUBLE" for a in AMINO_ACIDS) + ")"


def names(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


LETTERS = "upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))"

step("proteins", "", f"""SELECT concat('P', doc_id) AS id, regexp_replace({LETTERS}, '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS seq, doc_id AS n
  FROM documents WHERE regexp_replace({LETTERS}, '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') <> ''""")
step("peptides", "proteins", """SELECT concat('pep', n) AS id, CASE WHEN n % 13 = 0 THEN reverse(p) WHEN n % 11 = 0 THEN lower(p)
  WHEN n % 5 = 0 THEN concat(substring(p, 1, 4), 'W', substring(p, 6)) ELSE p END AS seq, n AS ord
  FROM (SELECT n, substring(seq, 31 + n % 40, 12 + n % 29) AS p FROM proteins) WHERE p <> ''""")
step("map", "", f"""SELECT concat('pep', doc_id) AS peptide_id, concat('P', doc_id) AS precursor_id, {names(SYMBOLS)}[doc_id % {len(SYMBOLS)} + 1] AS gene_symbol,
  concat('peptide of ', coalesce(source, ''), CASE WHEN doc_id % 3 = 0 THEN ' defensin' ELSE '' END) AS stitle FROM documents""")
step("signal", "", "SELECT concat('P', doc_id) AS acc, CAST(15 + doc_id % 12 AS INTEGER) AS signal_end FROM documents WHERE doc_id % 3 <> 0")
step("hits", "", """SELECT concat('pep', l_orderkey) AS qseqid, concat('P', l_partkey) AS sseqid, 80 + l_quantity * 0.4::DOUBLE AS pident,
  10 + l_linenumber * 3 AS length, CAST(12 + l_suppkey % 15 AS INTEGER) AS qlen, CAST(60 + l_partkey % 200 AS INTEGER) AS slen, l_discount AS evalue,
  round(l_extendedprice, 2) AS bitscore,
  concat('protein ', l_returnflag, CASE WHEN l_linestatus = 'O' THEN concat(' GN=G', l_suppkey) ELSE '' END, ' OS=human') AS stitle,
  concat('MK-', translate(CAST(l_partkey AS VARCHAR), '0123456789', 'ACDEFGHIKL'), '-RR') AS full_sseq,
  l_linenumber::BIGINT * 1000000000000 + l_partkey * 100000 + l_suppkey AS ord FROM lineitem""")
step("mrna", "", """SELECT o_orderkey AS mrna_id, concat('P', o_custkey) AS protein, concat('c', o_custkey) AS chrom,
  CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, o_totalprice AS score, o_orderkey AS ord FROM orders""")
step("cds", "", """SELECT l_orderkey AS mrna_id, 200 * r + l_partkey % 100 AS "start", 200 * r + l_partkey % 100 + 29 + l_suppkey % 90 AS "end", l_linenumber % 3 AS phase
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS r FROM lineitem)""")
step("genes", "", f"""SELECT CASE WHEN p_partkey BETWEEN 1 AND {len(GENES)} THEN {names(GENES)}[p_partkey] ELSE concat('G', p_partkey) END AS symbol, concat('c', p_partkey) AS chrom,
  100 + CAST(floor(p_retailprice) AS BIGINT) % 1500 AS "start", 100 + CAST(floor(p_retailprice) AS BIGINT) % 1500 + 150 + p_size * 10 AS "end",
  CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part""")
step("dna", "", f"""SELECT concat('c', doc_id) AS chrom, translate({LETTERS}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTANGTACGTACGTAC') AS dna FROM documents""")
step("chunks", "dna", f"""SELECT chrom, chunk_id, substring(dna, chunk_id * {CHUNK} + 1, {CHUNK}) AS seq
  FROM (SELECT chrom, dna, unnest(range(0, (length(dna) - 1) // {CHUNK} + 1)) AS chunk_id FROM dna WHERE dna <> '')""")

# homology
step("best", "hits", """SELECT * FROM (SELECT *, length::DOUBLE / greatest(qlen, 1) AS query_cov, row_number() OVER (PARTITION BY qseqid ORDER BY bitscore DESC, ord) AS k
  FROM hits WHERE pident >= 90 AND length::DOUBLE / greatest(qlen, 1) >= 0.8) WHERE k = 1""")
SYMBOL = r"CASE WHEN regexp_matches(concat(' ', stitle), '\sGN=') THEN regexp_extract(concat(' ', stitle), '\sGN=(\S*)', 1) ELSE '.' END"
final("clean_peptides", "peptides", "SELECT id, seq, ord FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY ord) AS k FROM peptides) WHERE k = 1")
final("best_precursor", "best", f"""SELECT qseqid AS peptide_id, sseqid AS precursor_id, {SYMBOL} AS gene_symbol, {r6("pident")} AS pident, {r6("query_cov")} AS query_cov,
  slen AS precursor_len, {r6("evalue")} AS evalue, stitle FROM best""")
final("gene_symbol", "hits", f"SELECT qseqid, sseqid, ord, {SYMBOL} AS gene_symbol FROM hits")
final("unique_precursors", "best", "SELECT sseqid AS id, replace(arg_min(full_sseq, ord), '-', '') AS seq FROM best GROUP BY sseqid")
KMERS = "SELECT id, i, substring(seq, i + 1, 5) AS k FROM (SELECT id, seq, unnest(range(0, length(seq) - 4)) AS i FROM {0} WHERE length(seq) >= 5)"
step("upper_peptides", "peptides", "SELECT id, upper(seq) AS seq FROM peptides")
step("seeds", "upper_peptides proteins", f"""SELECT a, b, d, count(*) AS seeds FROM (SELECT x.id AS a, y.id AS b, y.i - x.i AS d
  FROM ({KMERS.format("upper_peptides")}) x JOIN ({KMERS.format("proteins")}) y ON x.k = y.k) JOIN (SELECT id AS own, length(seq) AS n FROM upper_peptides) ON own = a GROUP BY a, b, d, n HAVING count(*) >= least(2, n - 4)""")
step("diagonal", "seeds", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY seeds DESC, d) AS k FROM seeds) WHERE k = 1")
step("aligned", "diagonal upper_peptides proteins", """SELECT a, b, d, seeds, q.seq AS x, t.seq AS y, greatest(0, -d) AS lo, least(length(q.seq), length(t.seq) - d) AS hi
  FROM diagonal JOIN upper_peptides q ON q.id = a JOIN proteins t ON t.id = b""")
final("homology_hits", "aligned", f"""SELECT a AS qseqid, b AS sseqid, CAST(d AS INTEGER) AS diagonal, CAST(seeds AS INTEGER) AS seeds, CAST(same AS INTEGER) AS same, {r6("same * 100.0::DOUBLE / (hi - lo)")} AS pident,
  CAST(hi - lo AS INTEGER) AS length, CAST(length(x) AS INTEGER) AS qlen, CAST(length(y) AS INTEGER) AS slen, CAST(lo + 1 AS INTEGER) AS qstart, CAST(lo + d + 1 AS INTEGER) AS sstart
  FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY same DESC, b) AS k FROM
    (SELECT *, (hi - lo) - hamming(substring(x, lo + 1, hi - lo), substring(y, lo + d + 1, hi - lo)) AS same FROM aligned)) WHERE k <= 5""")

# clusters: similar pairs, then greedy choice, round by round
ROUNDS = 12
step("distinct_peptides", "upper_peptides", "SELECT seq, min(id) AS id, length(seq) AS n FROM upper_peptides GROUP BY seq")
FOURS = "SELECT id, n, i, substring(seq, i + 1, 4) AS k FROM (SELECT id, n, seq, unnest(range(0, n - 3)) AS i FROM distinct_peptides WHERE n >= 4)"
step("alike", "distinct_peptides", f"""SELECT DISTINCT a, b FROM (
  SELECT DISTINCT x.id AS a, y.id AS b, y.i - x.i AS d FROM ({FOURS}) x JOIN ({FOURS}) y ON x.k = y.k WHERE y.n > x.n OR (y.n = x.n AND y.id < x.id)
  ) JOIN distinct_peptides p ON p.id = a JOIN distinct_peptides q ON q.id = b
  WHERE least(p.n, q.n - d) - greatest(0, -d) >= p.n * 0.9 AND least(p.n, q.n - d) - greatest(0, -d)
    - hamming(substring(p.seq, greatest(0, -d) + 1, least(p.n, q.n - d) - greatest(0, -d)), substring(q.seq, greatest(0, -d) + d + 1, least(p.n, q.n - d) - greatest(0, -d))) >= p.n * 0.9""")
step("open0", "alike", "SELECT a AS id FROM alike UNION SELECT b FROM alike")
for r in range(ROUNDS):
    step(f"chosen{r}", f"open{r} alike", f"SELECT id FROM open{r} WHERE id NOT IN (SELECT a FROM alike WHERE a IN (SELECT id FROM open{r}) AND b IN (SELECT id FROM open{r}))")
    step(f"open{r + 1}", f"chosen{r}", f"SELECT id FROM open{r} WHERE id NOT IN (SELECT id FROM chosen{r}) AND id NOT IN (SELECT a FROM alike WHERE b IN (SELECT id FROM chosen{r}))")
step("chosen", " ".join(f"chosen{r}" for r in range(ROUNDS)), " UNION ALL ".join(f"SELECT id FROM chosen{r}" for r in range(ROUNDS)))
step("joined", "chosen", """SELECT a AS id, arg_min(b, (-n, b)) AS rep FROM alike JOIN distinct_peptides p ON p.id = b
  WHERE b IN (SELECT id FROM chosen) AND a NOT IN (SELECT id FROM chosen) GROUP BY a""")
final("cluster_peptides", f"joined open{ROUNDS}", f"""SELECT u.id, CASE WHEN (SELECT count(*) FROM open{ROUNDS}) > 0 THEN 'not settled' ELSE coalesce(j.rep, p.id) END AS representative
  FROM upper_peptides u JOIN distinct_peptides p ON p.seq = u.seq LEFT JOIN joined j ON j.id = p.id""")

step("scored_hits", "aligned proteins", """SELECT *, (x5 * 0.318::DOUBLE - ln(0.134::DOUBLE)) / ln(2.0::DOUBLE) AS bitscore FROM (SELECT *, same * 5.0::DOUBLE + ((hi - lo) - same) * (-2.0::DOUBLE) AS x5,
    row_number() OVER (PARTITION BY a ORDER BY same DESC, b) AS k FROM
    (SELECT *, (hi - lo) - hamming(substring(x, lo + 1, hi - lo), substring(y, lo + d + 1, hi - lo)) AS same FROM aligned)) WHERE k <= 5""")
final("homology_precursors", "scored_hits proteins", f"""SELECT a AS peptide_id, b AS precursor_id, '.' AS gene_symbol, {r6("pident")} AS pident, {r6("query_cov")} AS query_cov, CAST(length(y) AS INTEGER) AS precursor_len,
  {r6("length(x) * (SELECT sum(length(seq))::DOUBLE FROM proteins) * pow(2.0::DOUBLE, -bitscore)")} AS evalue, '' AS stitle
  FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY bitscore DESC, k) AS first FROM
    (SELECT *, same * 100.0::DOUBLE / (hi - lo) AS pident, (hi - lo)::DOUBLE / length(x) AS query_cov FROM scored_hits)
    WHERE pident >= 90 AND query_cov >= 0.8) WHERE first = 1""")

# regions
step("located", "proteins peptides", """SELECT p.n, p.id AS prec, q.id AS pep, p.seq AS s, q.seq AS q,
  CASE WHEN length(q.seq) > length(p.seq) THEN NULL WHEN strpos(p.seq, q.seq) > 0 THEN strpos(p.seq, q.seq)
       WHEN strpos(upper(p.seq), upper(q.seq)) > 0 THEN strpos(upper(p.seq), upper(q.seq)) END AS place
  FROM proteins p JOIN peptides q ON q.ord = p.n""")
step("slid", "located", """SELECT n, arg_min(i, mm * 1000000 + i) AS i, min(mm) AS mm, any_value(length(q)) AS l
  FROM (SELECT n, q, i, hamming(substring(s, i, length(q)), q) AS mm FROM
    (SELECT n, s, q, unnest(range(1, length(s) - length(q) + 2)) AS i FROM located WHERE place IS NULL AND length(q) <= length(s))) GROUP BY n""")
step("mature", "located slid", """SELECT l.n, l.prec, l.pep, l.s, l.q, coalesce(l.place, CASE WHEN slid.mm <= greatest(1, CAST(floor(0.2::DOUBLE * slid.l) AS INTEGER)) THEN slid.i END) AS ms
  FROM located l LEFT JOIN slid ON slid.n = l.n""")
step("regions", "mature map signal", """SELECT pep AS peptide_id, prec AS precursor_id, gene_symbol, length(s) AS precursor_len, coalesce(signal_end, 0) AS signal_end, CAST(ms AS INTEGER) AS mature_start,
  CAST(ms + length(q) - 1 AS INTEGER) AS mature_end, CASE WHEN ms - 1 >= coalesce(signal_end, 0) + 1 THEN coalesce(signal_end, 0) + 1 ELSE 0 END AS pro_start,
  CASE WHEN ms - 1 >= coalesce(signal_end, 0) + 1 THEN CAST(ms - 1 AS INTEGER) ELSE 0 END AS pro_end,
  CASE WHEN substring(s, greatest(ms - 2, 1), ms - greatest(ms - 2, 1)) IN ('KR', 'RR', 'RK', 'KK') THEN substring(s, greatest(ms - 2, 1), ms - greatest(ms - 2, 1)) ELSE '.' END AS dibasic_hint
  FROM mature JOIN map ON map.peptide_id = pep LEFT JOIN signal ON acc = prec WHERE ms IS NOT NULL""")
final("find_mature", "mature", "SELECT n, CAST(ms AS INTEGER) AS mature_start, CAST(ms + length(q) - 1 AS INTEGER) AS mature_end FROM mature")
final("define_regions", "regions", """SELECT peptide_id, precursor_id, gene_symbol, CAST(precursor_len AS INTEGER) AS precursor_len, signal_end, mature_start, mature_end, pro_start, pro_end FROM regions""")
final("dibasic_hint", "regions", "SELECT peptide_id, mature_start, dibasic_hint FROM regions")

# gene models
step("models", "mrna cds", """SELECT protein, mrna_id, chrom, strand, score FROM (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY score DESC, ord) AS k
  FROM mrna WHERE mrna_id IN (SELECT mrna_id FROM cds)) WHERE k = 1""")
step("units", "models cds", """SELECT protein, chrom, strand, sum(usable) OVER w - usable AS off_start, sum(usable) OVER w - 1 AS off_end,
    CASE WHEN strand = '-' THEN "end" - skip ELSE "start" + skip END AS base0, sum(usable) OVER (PARTITION BY protein) AS total
  FROM (SELECT *, "end" - "start" + 1 - skip AS usable FROM (SELECT m.*, c."start", c."end", CASE WHEN strand = '-' THEN -c."start" ELSE c."start" END AS key,
      CASE WHEN row_number() OVER (PARTITION BY protein ORDER BY CASE WHEN strand = '-' THEN -c."start" ELSE c."start" END, c."end") = 1 THEN phase ELSE 0 END AS skip
    FROM models m JOIN cds c ON c.mrna_id = m.mrna_id)) WHERE usable > 0 WINDOW w AS (PARTITION BY protein ORDER BY key, "end" ROWS UNBOUNDED PRECEDING)""")


def projected(source: str, keep: str) -> str:
    return f"""SELECT {keep}, chrom, strand, CASE WHEN strand = '+' THEN base0 + lo - 1 ELSE base0 - hi - 1 END AS start0, CASE WHEN strand = '+' THEN base0 + hi ELSE base0 - lo END AS end0
  FROM (SELECT *, greatest(a0, off_start) - off_start AS lo, least(b0, off_end) - off_start AS hi FROM
    (SELECT i.*, u.chrom, u.strand, u.off_start, u.off_end, u.base0, (aa_start - 1) * 3 AS a0, least(aa_end * 3 - 1, total - 1) AS b0
     FROM ({source}) i JOIN units u ON u.protein = i.protein) WHERE a0 <= b0 AND off_end >= a0 AND off_start <= b0)"""


SPANS = "SELECT peptide_id, precursor_id AS protein, mature_start AS aa_start, mature_end AS aa_end FROM regions"
step("blocks_aa", "regions", """SELECT peptide_id, precursor_id AS protein, 1 AS method, 'AMP' AS tag, mature_start AS aa_start, mature_end AS aa_end FROM regions
  UNION ALL SELECT peptide_id, precursor_id, 2, 'PRO', pro_start, pro_end FROM regions WHERE pro_start > 0 AND pro_end >= pro_start
  UNION ALL SELECT peptide_id, precursor_id, 3, 'PRO_AMP', CASE WHEN pro_start > 0 AND pro_end >= pro_start THEN pro_start ELSE mature_start END, mature_end FROM regions""")
step("blocks", "blocks_aa units", f"""SELECT method, chrom, start0, end0, concat(peptide_id, '|', tag, '|', protein, '|ex', row_number() OVER (PARTITION BY peptide_id, method, protein ORDER BY start0, end0)) AS name, strand, peptide_id
  FROM ({projected("SELECT * FROM blocks_aa", "peptide_id, protein, method, tag")})""")
step("envelopes", "regions models cds", """SELECT peptide_id, chrom, start0, end0, concat(peptide_id, '|LOCUS|', precursor_id) AS name, strand, n_exons, coding
  FROM regions JOIN models ON protein = precursor_id JOIN (SELECT mrna_id, min("start") - 1 AS start0, max("end") AS end0, CAST(count(*) AS INTEGER) AS n_exons, sum("end" - "start" + 1) AS coding FROM cds GROUP BY mrna_id) c USING (mrna_id)""")


def oriented(seq: str) -> str:
    return f"CASE WHEN strand = '-' THEN reverse(translate({seq}, 'ACGTNacgtn', 'TGCANtgcan')) ELSE {seq} END"


def fetched(source: str, key: str) -> str:
    """Sequence by whole chromosomes: the same bases as by chunks."""
    return f"""SELECT {key}, {oriented("p")} AS seq FROM (SELECT {key}, i.strand, substring(dna, greatest(start0, 0) + 1, end0 - greatest(start0, 0)) AS p
  FROM ({source}) i JOIN dna ON dna.chrom = i.chrom WHERE end0 > greatest(start0, 0)) WHERE p <> ''"""


final("best_gene_model", "models", "SELECT * FROM models")
final("coding_units", "units", "SELECT protein, chrom, strand, CAST(off_start AS BIGINT) AS off_start, CAST(off_end AS BIGINT) AS off_end, base0, CAST(total AS BIGINT) AS total FROM units")
final("aa_interval_to_genome", "regions units", f"SELECT * REPLACE (CAST(start0 AS BIGINT) AS start0, CAST(end0 AS BIGINT) AS end0) FROM ({projected(SPANS, 'protein, peptide_id, aa_start, aa_end')})")
BOND_SRC = "SELECT peptide_id, precursor_id AS protein, mature_end AS bond, mature_end AS aa_start, mature_end AS aa_end FROM regions"


def points(source: str, keys: str) -> str:
    return f"""SELECT {keys}, chrom, strand, CAST(CASE WHEN strand = '+' THEN max(end0) - 1 ELSE min(start0) END AS BIGINT) AS start0, CAST(CASE WHEN strand = '+' THEN max(end0) ELSE min(start0) + 1 END AS BIGINT) AS end0
  FROM ({projected(source, keys)}) GROUP BY {keys}, chrom, strand"""


final("bond_to_genome", "regions units", points(BOND_SRC, "peptide_id, protein, bond"))
final("method_blocks", "blocks", "SELECT method, chrom, CAST(start0 AS BIGINT) AS start0, CAST(end0 AS BIGINT) AS end0, name, strand FROM blocks")
final("locus_envelope", "envelopes", "SELECT peptide_id, chrom, start0, end0, name, strand FROM envelopes")
final("fetch_sequence", "envelopes dna", fetched("SELECT * FROM envelopes", "peptide_id"))
final("revcomp", "chunks", "SELECT chrom, chunk_id, reverse(translate(seq, 'ACGTNacgtn', 'TGCANtgcan')) AS seq FROM chunks")

# enzyme loci
RULES = ", ".join(f"('{p}', '{r}', '{g}')" for p, r, g in FAMILY_RULES)
step("asked", "map", f"""SELECT DISTINCT role, gene, family FROM (
  WITH m AS (SELECT CASE WHEN coalesce(gene_symbol, '') = '' THEN '.' ELSE gene_symbol END AS family, concat(CASE WHEN coalesce(gene_symbol, '') = '' THEN '.' ELSE gene_symbol END, ' ', stitle) AS hay FROM map),
  r AS (SELECT * FROM (VALUES {RULES}) AS v(pat, role, gene)),
  own AS (SELECT hay, family, role, gene FROM m JOIN r ON pat <> '.*' AND regexp_matches(hay, pat, 'i'))
  SELECT role, gene, family FROM own UNION ALL SELECT role, gene, family FROM m JOIN r ON pat = '.*' WHERE hay NOT IN (SELECT hay FROM own))""")
step("loci", "asked genes", """SELECT role, gene, chrom, "start", "end", strand, families AS requested_by_families, CASE WHEN symbol IS NULL OR gene = '.' THEN 'not_found_in_gff' ELSE 'ok' END AS status
  FROM (SELECT role, gene, coalesce(string_agg(family, ',' ORDER BY family) FILTER (WHERE family NOT IN ('', '.')), '') AS families FROM asked GROUP BY role, gene) LEFT JOIN genes ON symbol = gene""")
final("enzyme_rules", "loci", "SELECT role, gene, requested_by_families AS families FROM loci")
final("enzyme_loci", "loci", "SELECT * FROM loci")
step("locus_spans", "loci", """SELECT concat(gene, '|', role, '|', chrom, ':', "start", '-', "end", '|', strand) AS name, requested_by_families AS families, chrom, "start" - 1 AS start0, "end" AS end0, strand FROM loci WHERE status = 'ok'""")
final("enzyme_sequences", "locus_spans dna", f"SELECT name, f.seq, families FROM ({fetched('SELECT * FROM locus_spans', 'name')}) f JOIN locus_spans USING (name)")

# cleavage
step("chars", "proteins", """SELECT id, n, seq, unnest(range(1, length(seq) + 1)) AS i, unnest(string_split(seq, '')) AS c, unnest(list_concat(list_slice(string_split(seq, ''), 2, length(seq)), [''])) AS nx FROM proteins""")


def _motif_sites(k: int, enzyme: str, role: str, pattern: str, offset: int, width: int) -> str:
    if "(?=" in pattern:
        first, ahead = pattern.removesuffix(")").split("(?=")
        inside = lambda p, x: f"{x} <> '' AND {x} NOT IN ({', '.join(repr(a) for a in p[2:-1])})" if p[1] == "^" else f"{x} IN ({', '.join(repr(a) for a in p[1:-1])})"
        return f"SELECT id, n, seq, {k} AS motif_ord, '{enzyme}' AS enzyme, '{role}' AS role, i AS bond FROM chars WHERE {inside(first, 'c')} AND {inside(ahead, 'nx')}"
    return f"""SELECT id, n, seq, {k}, '{enzyme}', '{role}', i - 1 + {offset} FROM (SELECT id, n, seq, unnest(range(1, length(seq) + 1)) AS i, unnest(string_split(regexp_replace(seq, '{pattern}', '@{"_" * (width - 1)}', 'g'), '')) AS c FROM proteins) WHERE c = '@'"""


step("sites", "chars", "SELECT * FROM (" + " UNION ALL ".join(_motif_sites(k, *m) for k, m in sorted(enumerate(PROTEASE_MOTIFS), key=lambda x: "(?=" not in x[1][2])) + ") WHERE bond >= 1 AND bond < length(seq)")
final("scan_cleavage", "sites", "SELECT id AS precursor_id, enzyme, role, CAST(bond AS INTEGER) AS bond, substring(seq, bond, 1) AS p1_residue, 1.0::DOUBLE AS score FROM sites")
final("site_window", "sites", "SELECT id AS precursor_id, enzyme, CAST(bond AS INTEGER) AS bond, concat(substring(seq, greatest(bond - 4, 0) + 1, bond - greatest(bond - 4, 0)), '|', substring(seq, bond + 1, 4)) AS \"window\" FROM sites")
step("windows", "regions proteins", """SELECT * FROM (
  SELECT peptide_id, precursor_id, 'pro_mature' AS junction, CASE WHEN mature_start - 1 >= 4 AND mature_start + 3 <= length(seq) THEN substring(seq, mature_start - 4, 8) END AS win FROM regions JOIN proteins ON id = precursor_id
  UNION ALL SELECT peptide_id, precursor_id, 'signal_pro', CASE WHEN signal_end >= 4 AND signal_end + 4 <= length(seq) THEN substring(seq, signal_end - 3, 8) END FROM regions JOIN proteins ON id = precursor_id WHERE signal_end > 0) WHERE win IS NOT NULL""")
final("junction_windows", "windows", """SELECT peptide_id, precursor_id, junction, win AS "window" FROM windows""")
step("places", "windows", "SELECT junction, unnest(range(1, 9)) AS pos, unnest(string_split(win, '')) AS aa FROM windows")
final("motif_pfm", "places", f"""SELECT junction, CAST(pos AS INTEGER) AS pos, [{", ".join("'" + x.replace("'", "''") + "'" for x in POSITION_LABELS)}][pos] AS label, CAST(rank AS INTEGER) AS rank, aa, {r6("freq")} AS freq FROM (
  SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY junction, pos) AS freq, row_number() OVER (PARTITION BY junction, pos ORDER BY n DESC, aa) AS rank FROM (SELECT junction, pos, aa, count(*) AS n FROM places GROUP BY ALL)) WHERE rank <= 3""")
AA_LIST = names(list(AMINO_ACIDS))
step("bg", "chars", f"""SELECT aa, (coalesce(n, 0) + 1)::DOUBLE / (20 + (SELECT count(*) FROM chars WHERE list_contains({AA_LIST}, c))) AS freq
  FROM (SELECT unnest({AA_LIST}) AS aa) LEFT JOIN (SELECT c, count(*) AS n FROM chars GROUP BY c) ON c = aa""")
step("pwm", "bg places", """SELECT pos, aa, log2((n + 0.5::DOUBLE) / (sum(n) OVER (PARTITION BY pos) + 10.0::DOUBLE) / freq) AS logodds FROM (
  SELECT g.pos, bg.aa, bg.freq, coalesce(c.n, 0) AS n FROM bg JOIN (SELECT unnest(range(1, 9)) AS pos) g ON true LEFT JOIN (SELECT pos, aa, count(*) AS n FROM places GROUP BY ALL) c ON c.pos = g.pos AND c.aa = bg.aa)""")
final("background", "bg", f"SELECT aa, {r6('freq')} AS freq FROM bg")
final("pwm", "pwm", f"SELECT CAST(pos AS INTEGER) AS pos, aa, {r6('logodds')} AS logodds FROM pwm")
step("wscore", "windows pwm", """SELECT w.peptide_id, w.junction, sum(coalesce(pwm.logodds, 0)) AS score FROM (SELECT peptide_id, junction, unnest(range(1, 9)) AS pos, unnest(string_split(win, '')) AS aa FROM windows) w
  LEFT JOIN pwm ON pwm.pos = w.pos AND pwm.aa = w.aa GROUP BY ALL""")
final("pwm_score", "wscore", f"SELECT peptide_id, junction, {r6('score')} AS score FROM wscore")
step("truth", "regions", """SELECT precursor_id, list(b) AS bonds FROM (SELECT precursor_id, mature_start - 1 AS b FROM regions WHERE mature_start > 1 UNION ALL SELECT precursor_id, signal_end FROM regions WHERE signal_end > 0) GROUP BY precursor_id
  UNION ALL SELECT precursor_id, [] FROM regions WHERE mature_start <= 1 AND signal_end <= 0""")
step("negatives", "truth proteins", """SELECT precursor_id, CAST(k AS INTEGER) AS bond, substring(seq, k - 3, 8) AS win FROM (SELECT *, row_number() OVER (PARTITION BY precursor_id ORDER BY md5(concat(precursor_id, '|', k, '|0'))) AS rn FROM (
  SELECT precursor_id, seq, bonds, unnest(range(4, length(seq) - 4)) AS k FROM truth JOIN proteins ON id = precursor_id WHERE length(seq) > 8) WHERE len(list_filter(bonds, lambda b: abs(b - k) <= 2)) = 0) WHERE rn <= 3 * greatest(len(bonds), 1)""")
final("negative_windows", "negatives", """SELECT precursor_id, bond, win AS "window" FROM negatives""")
ONE_HOT = f"array_to_string(list_transform(string_split(win, ''), lambda c: array_to_string(list_transform({AA_LIST}, lambda a: CASE WHEN a = c THEN '1' ELSE '0' END), '')), '')"
flag = lambda i, chars: f"CASE WHEN substring(win, {i}, 1) IN ({', '.join(repr(c) for c in chars)}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
final("window_features", "windows", f"""SELECT peptide_id, junction, {ONE_HOT} AS onehot, {r6(count_of("win", "KR") + "::DOUBLE / 8")} AS cation, {r6(hyd("win") + " / 8")} AS hydropathy,
  {flag(4, "KR")} AS p1_basic, {flag(4, "AGSCT")} AS p1_small, {flag(5, "FWY")} AS p1p_aromatic FROM windows""")
step("pooled", "windows negatives pwm", """SELECT label, round(sum(coalesce(logodds, 0)), 6) AS score FROM (SELECT label, k, unnest(range(1, 9)) AS pos, unnest(string_split(win, '')) AS aa FROM (
  SELECT *, row_number() OVER () AS k FROM (SELECT win, 1 AS label FROM windows UNION ALL SELECT win, 0 FROM negatives))) LEFT JOIN pwm USING (pos, aa) GROUP BY label, k""")
final("auc", "pooled", f"""SELECT sum(p) AS n_pos, sum(n) AS n_neg, {r6("sum(p * (below + n * 0.5::DOUBLE)) / (sum(p) * sum(n))")} AS auc FROM (
  SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
    SELECT score, CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS p, CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS n FROM pooled GROUP BY score))""".replace("SELECT sum(p) AS n_pos, sum(n) AS n_neg", "SELECT CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg"))
step("w8", "sites", "SELECT DISTINCT CASE WHEN bond >= 4 AND bond + 4 <= length(seq) THEN substring(seq, bond - 3, 8) END AS win FROM sites")
step("w8s", "w8 pwm", """SELECT win, 1 / (1 + exp(-sum(coalesce(logodds, 0)))) AS score FROM (SELECT win, unnest(range(1, 9)) AS pos, unnest(string_split(win, '')) AS aa FROM w8 WHERE win IS NOT NULL) LEFT JOIN pwm USING (pos, aa) GROUP BY win""")
step("plain", "sites", "SELECT id, n, seq, motif_ord, enzyme, role, bond, 1.0::DOUBLE AS score FROM sites")
step("scored", "sites w8s", """SELECT id, n, seq, motif_ord, enzyme, role, bond, coalesce(w8s.score, 0) AS score FROM sites LEFT JOIN w8s ON w8s.win = CASE WHEN bond >= 4 AND bond + 4 <= length(seq) THEN substring(seq, bond - 3, 8) END""")
final("score_sites", "scored", f"SELECT id AS precursor_id, enzyme, CAST(bond AS INTEGER) AS bond, {r6('score')} AS score FROM scored")
PRIORITY = "CASE role " + " ".join(f"WHEN '{r}' THEN {w}::DOUBLE" for r, w in ROLE_PRIORITY.items()) + " ELSE 1.0::DOUBLE END"
for kind in ("plain", "scored"):
    step(f"start_{kind}", f"{kind} proteins signal", f"""SELECT p.id, p.seq, coalesce(s.signal_end, 0) AS signal_end, coalesce(b.bond, coalesce(s.signal_end, 0)) + 1 AS mature_start, coalesce(b.value, 0.0) AS sel_score
  FROM proteins p LEFT JOIN signal s ON s.acc = p.id LEFT JOIN (SELECT id, bond, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, motif_ord, bond) AS k FROM (
    SELECT c.id, bond, motif_ord, {PRIORITY} + 3.0::DOUBLE * score + 2.0::DOUBLE * {frac("substring(seq, bond + 1)", "KR")} + CASE WHEN length(seq) - bond <= 60 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS value
    FROM {kind} c LEFT JOIN signal s ON s.acc = c.id WHERE length(seq) - bond BETWEEN 5 AND 120 AND bond > coalesce(s.signal_end, 0))) WHERE k = 1) b ON b.id = p.id""")
    step(f"ends_{kind}", f"start_{kind} {kind}", f"""SELECT s.id, s.seq, s.signal_end, s.mature_start, s.sel_score, coalesce(e.cut, length(s.seq)) AS mature_end, CASE WHEN e.cut IS NULL THEN 'terminus' ELSE 'cterm_cut' END AS mature_end_source
  FROM start_{kind} s LEFT JOIN (SELECT id, max(bond) AS cut FROM (SELECT s.id, bond, substring(s.seq, bond + 1) AS tail, substring(s.seq, mature_start, bond - mature_start + 1) AS mat
    FROM start_{kind} s JOIN (SELECT DISTINCT id, bond FROM {kind}) c ON c.id = s.id WHERE bond > mature_start AND length(s.seq) - bond >= 3 AND bond - mature_start + 1 BETWEEN 5 AND 120)
    WHERE {frac("tail", "DE")} > {frac("tail", "KR")} AND {frac("mat", "KR")} > {frac("tail", "KR")} GROUP BY id) e ON e.id = s.id""")
final("predict_mature_start", "start_plain", f"SELECT id AS precursor_id, signal_end, CAST(mature_start AS INTEGER) AS mature_start, {r6('sel_score')} AS sel_score FROM start_plain")
final("trim_cterm", "ends_plain", "SELECT id AS precursor_id, CAST(mature_start AS INTEGER) AS mature_start, CAST(mature_end AS INTEGER) AS mature_end, mature_end_source FROM ends_plain")
final("predicted_regions", "ends_scored", """SELECT concat(id, '_pred') AS peptide_id, id AS precursor_id, '.' AS gene_symbol, CAST(length(seq) AS INTEGER) AS precursor_len, signal_end, CAST(mature_start AS INTEGER) AS mature_start,
  CAST(mature_end AS INTEGER) AS mature_end, CASE WHEN mature_start - 1 >= signal_end + 1 THEN signal_end + 1 ELSE 0 END AS pro_start, CAST(CASE WHEN mature_start - 1 >= signal_end + 1 THEN mature_start - 1 ELSE 0 END AS INTEGER) AS pro_end,
  '.' AS dibasic_hint, round(sel_score, 3) + 0.0 AS sel_score, mature_end_source FROM ends_scored""")
step("accuracy", "start_plain regions plain", """SELECT r.precursor_id, r.mature_start AS true_mature_start, CAST(s.mature_start AS INTEGER) AS pred_mature_start, CASE WHEN abs(s.mature_start - r.mature_start) <= 2 THEN 1 ELSE 0 END AS boundary_hit,
  CASE WHEN EXISTS (SELECT 1 FROM plain c WHERE c.id = r.precursor_id AND abs(c.bond - r.mature_start) <= 2) THEN 1 ELSE 0 END AS scanner_covered FROM regions r JOIN start_plain s ON s.id = r.precursor_id""")
final("boundary_accuracy", "accuracy", "SELECT * FROM accuracy")
final("boundary_summary", "accuracy", f"SELECT count(*) AS n, {r6('avg(boundary_hit)')} AS accuracy, {r6('avg(scanner_covered)')} AS scanner_recall FROM accuracy")
CUT_SRC = "SELECT id AS protein, enzyme, bond, substring(seq, bond, 1) AS p1_residue, bond AS aa_start, bond AS aa_end FROM sites"
final("cutsites_bed", "sites units", f"SELECT chrom, start0, end0, concat(enzyme, '|', protein, '|cutAfter', bond, '|', p1_residue) AS name, 1.0::DOUBLE AS score, strand FROM ({points(CUT_SRC, 'protein, enzyme, bond, p1_residue')})")

# regulation
step("pwin", "genes", """SELECT symbol, chrom, greatest(CASE WHEN strand = '-' THEN "end" - 200 ELSE "start" - 1000 END, 1) AS p_start, CASE WHEN strand = '-' THEN "end" + 1000 ELSE "start" + 200 END AS p_end, strand FROM genes""")
final("promoter_windows", "pwin", "SELECT * FROM pwin")
step("pairs", "loci map", """SELECT DISTINCT amp_gene, gene AS partner_gene, role AS partner_role FROM (SELECT trim(unnest(string_split(requested_by_families, ','))) AS amp_gene, gene, role FROM loci)
  WHERE amp_gene IN (SELECT gene_symbol FROM map WHERE gene_symbol NOT IN ('', '.'))""")
step("wanted", "loci map", """SELECT gene, arg_max(role, concat(own, role)) AS role FROM (SELECT gene_symbol AS gene, 'amp' AS role, '1' AS own FROM map WHERE gene_symbol NOT IN ('', '.') UNION ALL SELECT gene, role, '0' FROM loci WHERE gene <> '.') GROUP BY gene""")
final("coreg_pairs", "pairs", "SELECT * FROM pairs")
final("wanted_genes", "wanted", "SELECT * FROM wanted")
PROM = """SELECT {gene} AS gene, {role} AS role, w.chrom, p_start, least(p_end, length(dna)) AS p_end, w.strand, p_start - 1 AS start0, least(p_end, length(dna)) AS end0 FROM {src} JOIN dna ON dna.chrom = w.chrom WHERE dna <> ''"""
step("prom_w", "wanted pwin dna", PROM.format(gene="g.gene", role="g.role", src="wanted g JOIN pwin w ON w.symbol = g.gene"))
step("prom_all", "pwin dna", PROM.format(gene="w.symbol", role="'gene'", src="pwin w"))
final("promoter_sequences", "prom_w dna", f"SELECT gene, role, chrom, p_start, p_end, strand, f.seq FROM ({fetched('SELECT * FROM prom_w', 'gene')}) f JOIN prom_w USING (gene)")
step("prom_seq", "prom_all dna", f"SELECT gene, role, chrom, p_start, p_end, strand, f.seq FROM ({fetched('SELECT * FROM prom_all', 'gene')}) f JOIN prom_all USING (gene)")
_COMP = {"A": "T", "C": "G", "G": "C", "T": "A"}


def _tf_sites(tf: str, consensus: str, orient: str) -> str:
    sets = [IUPAC[c] for c in consensus]
    if orient == "-":
        sets = ["".join(_COMP[b] for b in s) for s in reversed(sets)]
    w = len(sets)
    same = " + ".join(f"CASE WHEN substring(p, {j + 1}, 1) IN ({', '.join(repr(b) for b in s)}) THEN 0 ELSE 1 END" for j, s in enumerate(sets))
    return f"SELECT gene, role, '{tf}' AS tf, '{orient}' AS motif_orient, o, chrom, p_start, p_end, strand, substring(p, 1, {w}) AS matched_seq, {w} AS w FROM offs WHERE length(p) >= {w} AND {same} <= 1"


step("offs", "prom_seq", "SELECT gene, role, chrom, p_start, p_end, strand, o, substring(seq, o + 1, 15) AS p FROM (SELECT *, unnest(range(0, length(seq))) AS o FROM prom_seq)")
step("tfbs", "offs", " UNION ALL ".join(_tf_sites(tf, c, o) for tf, c in TF_MOTIFS for o in "+-"))
step("tfbs_at", "tfbs", """SELECT gene, role, tf, motif_orient, CAST(o AS INTEGER) AS promoter_offset, chrom, CASE WHEN strand = '-' THEN p_end - o - w ELSE p_start + o - 1 END AS start0,
  CASE WHEN strand = '-' THEN p_end - o ELSE p_start + o - 1 + w END AS end0, matched_seq FROM tfbs""")
final("tfbs_hits", "tfbs_at", "SELECT gene, tf, motif_orient, promoter_offset, chrom, CAST(start0 AS BIGINT) AS start0, CAST(end0 AS BIGINT) AS end0, matched_seq FROM tfbs_at")
final("tfbs_bed", "tfbs_at", "SELECT chrom, CAST(start0 AS BIGINT) AS start0, CAST(end0 AS BIGINT) AS end0, concat(tf, '|', gene, '|', role) AS name, '.' AS score, '.' AS strand FROM tfbs_at")
step("sets", "tfbs", "SELECT gene, list_sort(list(DISTINCT tf)) AS tfs FROM tfbs GROUP BY gene")
final("tf_sets", "sets", "SELECT gene, array_to_string(tfs, ',') AS tfs FROM sets")
joined = lambda x: f"CASE WHEN len({x}) > 0 THEN array_to_string(list_sort({x}), ',') ELSE '.' END"
final("shared_signatures", "pairs sets", f"""SELECT amp_gene, partner_gene, partner_role, {joined("list_filter(a, lambda x: list_contains(p, x))")} AS shared_tfs, CAST(len(list_filter(a, lambda x: list_contains(p, x))) AS INTEGER) AS n_shared,
  {joined("list_filter(a, lambda x: NOT list_contains(p, x))")} AS amp_only_tfs, {joined("list_filter(p, lambda x: NOT list_contains(a, x))")} AS partner_only_tfs
  FROM (SELECT pairs.*, coalesce(x.tfs, []) AS a, coalesce(y.tfs, []) AS p FROM pairs LEFT JOIN sets x ON x.gene = amp_gene LEFT JOIN sets y ON y.gene = partner_gene)""")

# reports
final("pipeline_summary", "map regions blocks envelopes loci", """SELECT 'peptides_mapped_to_precursor' AS stage, count(*) AS count FROM map UNION ALL SELECT 'regions_defined', count(*) FROM regions
  UNION ALL SELECT 'method1_amp_records', count(*) FROM blocks WHERE method = 1 UNION ALL SELECT 'method2_propeptide_records', count(*) FROM blocks WHERE method = 2
  UNION ALL SELECT 'method3_pro_plus_amp_records', count(*) FROM blocks WHERE method = 3 UNION ALL SELECT 'method5_locus_records', count(*) FROM envelopes
  UNION ALL SELECT 'method4_enzyme_records', count(*) FROM loci WHERE status = 'ok'""")
HAS = ", ".join(f"CASE WHEN peptide_id IN (SELECT peptide_id FROM {'envelopes' if m == 5 else f'blocks WHERE method = {m}'}) THEN 1 ELSE 0 END AS has_m{m}" for m in (1, 2, 3, 5))
final("feature_map", "regions blocks envelopes", f"SELECT peptide_id, precursor_id, gene_symbol, CAST(precursor_len AS INTEGER) AS precursor_len, signal_end, mature_start, mature_end, pro_start, pro_end, {HAS} FROM regions")

# datasets and features
step("cuts", "scored", "SELECT id AS precursor_id, greatest(max(score), 0.0) AS cut_score, CAST(count(*) FILTER (WHERE score >= 0.5) AS INTEGER) AS n_strong_cuts FROM scored GROUP BY id")
final("cut_context", "cuts", f"SELECT precursor_id, {r6('cut_score')} AS cut_score, n_strong_cuts FROM cuts")
step("locusf", "envelopes dna", f"""SELECT e.peptide_id, e.end0 - e.start0 AS locus_len_bp, 1 - e.coding::DOUBLE / (e.end0 - e.start0) AS intron_frac, coalesce({count_of("upper(f.seq)", "GC")}::DOUBLE / length(f.seq), 0.0) AS gc_locus, e.n_exons
  FROM envelopes e LEFT JOIN ({fetched("SELECT * FROM envelopes", "peptide_id")}) f ON f.peptide_id = e.peptide_id""")
final("locus_features", "locusf", f"SELECT peptide_id, locus_len_bp, {r6('intron_frac')} AS intron_frac, {r6('gc_locus')} AS gc_locus, n_exons FROM locusf")
given = {"cut_score": "coalesce(cut_score, 0)", "n_strong_cuts": "coalesce(n_strong_cuts, 0)", **{c: f"coalesce({c}, 0)" for c in ("locus_len_bp", "intron_frac", "gc_locus", "n_exons")}}
FIELDS = ", ".join(f"CAST({given.get(c, '0')} AS DOUBLE) AS {c}" for c in (*ENZYME_FIELDS, *LOCUS_FIELDS))
step("positives", "regions peptides proteins cuts locusf", f"""SELECT r.peptide_id AS id, coalesce(q.seq, '') AS mature_seq, CASE WHEN mature_start > signal_end + 1 THEN substring(coalesce(p.seq, ''), signal_end + 1, mature_start - 1 - signal_end) ELSE '' END AS pro_seq,
  coalesce(p.seq, '') AS precursor_seq, CASE WHEN signal_end > 0 THEN 1 ELSE 0 END AS has_signal, signal_end AS signal_len, CASE WHEN dibasic_hint IN ('.', '') THEN 0 ELSE 1 END AS has_dibasic, {FIELDS}
  FROM regions r LEFT JOIN peptides q ON q.id = r.peptide_id LEFT JOIN proteins p ON p.id = r.precursor_id LEFT JOIN cuts ON cuts.precursor_id = r.precursor_id LEFT JOIN locusf ON locusf.peptide_id = r.peptide_id""")
ROUNDED = ", ".join(f"{r6(c)} AS {c}" for c in (*ENZYME_FIELDS, *LOCUS_FIELDS))
final("assemble_positives", "positives", f"SELECT id, mature_seq, pro_seq, precursor_seq, has_signal, signal_len, has_dibasic, {ROUNDED} FROM positives")
step("decoys", "peptides", """SELECT id, i, string_agg(c, '' ORDER BY md5(concat(id, '|', i, '|', p, '|0')), c) AS s FROM (SELECT id, i, unnest(range(0, length(seq))) AS p, unnest(string_split(seq, '')) AS c
  FROM (SELECT id, seq, unnest(range(0, 2)) AS i FROM peptides)) GROUP BY id, i""")
final("shuffled_decoys", "decoys", "SELECT concat(id, '_shuf', i) AS id, 0 AS label, s AS mature_seq, s AS precursor_seq FROM decoys")
final("make_dataset", "peptides decoys", f"""SELECT id, 1 AS label, seq AS mature_seq, seq AS precursor_seq FROM peptides UNION ALL SELECT concat(id, '_shuf', i), 0, s, s FROM decoys WHERE i = 0
  UNION ALL SELECT concat('neg_b', item_id), 0, {LETTERS}, {LETTERS} FROM benchmark""")


def stats(seq: str, prefix: str) -> str:
    s = f"upper(coalesce({seq}, ''))"
    h = f"CASE WHEN length({s}) > 0 THEN {hyd(s)} / length({s}) ELSE 0.0 END"
    parts = {
        "len": f"CAST(length({s}) AS DOUBLE)", "charge": f"{frac(s, 'KR')} - {frac(s, 'DE')}", "cationic": frac(s, "KR"), "acidic": frac(s, "DE"), "hydropathy": h,
        "aromatic": frac(s, "FWY"), "cys": frac(s, "C"), "gly": frac(s, "G"), "boman": f"-({h})",
    }
    return ", ".join(f"{r6('(' + v + ')')} AS {prefix}_{k}" for k, v in parts.items())


def composition(seq: str, prefix: str) -> str:
    s = f"upper(coalesce({seq}, ''))"
    return ", ".join(f"{r6(f'{count_of(s, a)}::DOUBLE / greatest(length({s}), 1)')} AS {prefix}_aa_{a}" for a in AMINO_ACIDS)


final("seq_stats", "proteins", f"SELECT id, {stats('seq', 'm1')} FROM proteins")
final("aa_composition", "proteins", f"SELECT id, {composition('seq', 'm1')} FROM proteins")
final("method_features", "positives", f"""SELECT id, {stats("mature_seq", "m1")}, {composition("mature_seq", "m1")}, {stats("pro_seq", "m2pro")}, CAST(has_dibasic AS DOUBLE) AS m2_has_dibasic,
  {stats("precursor_seq", "m3prec")}, CAST(has_signal AS DOUBLE) AS m3_has_signal, CAST(signal_len AS DOUBLE) AS m3_signal_len, {ROUNDED} FROM positives""")
LEVELS = ", ".join(f"('M{i + 1}', {n})" for i, n in enumerate((29, 39, 50, 54, 61, 125)))
SQL["q_cumulative_columns"] = f"SELECT n_rows, level, n_features FROM (SELECT count(*) AS n_rows FROM labels) l JOIN (VALUES {LEVELS}) v(level, n_features) ON true"
_bucket = "0"
for _i in range(8):
    _bucket = f"(({_bucket}) * 65536 + CAST(concat('0x', substring(h, {4 * _i + 1}, 4)) AS INTEGER)) % 32"
step("grams", "proteins", f"""SELECT id, {_bucket} AS b, sum(n) AS n FROM (SELECT id, md5(m) AS h, n FROM (SELECT id, m, count(*) AS n FROM (SELECT id, substring(seq, i, 2) AS m FROM (SELECT id, seq, unnest(range(1, length(seq))) AS i FROM proteins)) GROUP BY ALL)) GROUP BY ALL""")
final("kmer_embedding", "proteins grams", """SELECT p.id, array_to_string(list_transform(range(0, 32), lambda i: CAST(CAST(round(coalesce(list_sum(list_transform(list_filter(g.v, lambda x: x.b = i), lambda x: x.n)), 0) / coalesce(g.norm, 1) * 10000) AS BIGINT) AS VARCHAR)), ',') AS vec
  FROM proteins p LEFT JOIN (SELECT id, list({'b': b, 'n': CAST(n AS DOUBLE)}) AS v, sqrt(sum(CAST(n AS DOUBLE) * n)) AS norm FROM grams GROUP BY id) g ON g.id = p.id""")
MERGED = ", ".join(f"{r6(f'coalesce(CAST(embedding[{i + 1}] AS DOUBLE), 0.0)')} AS m6p_{i}" for i in range(64))
final("merge_embeddings", "proteins", f"SELECT id, {MERGED} FROM proteins LEFT JOIN embeddings ON concat('P', vec_id) = id")
_in = lambda x: "(" + ", ".join(f"'{v}'" for v in x) + ")"
ENZ, AMPS = _in(GENES[:5]), _in(GENES[6:])
final("neighbourhood", "envelopes genes", f"""SELECT e.peptide_id, CAST(coalesce(max(CASE WHEN symbol IN {ENZ} THEN 1 ELSE 0 END), 0) AS INTEGER) AS enzyme_present, {r6(f"min(CASE WHEN symbol IN {ENZ} THEN gap END) / 1000.0::DOUBLE")} AS enzyme_dist_kb,
  CAST(coalesce(max(CASE WHEN symbol = 'ABCA1' THEN 1 ELSE 0 END), 0) AS INTEGER) AS transporter_present, {r6("count(symbol) / ((any_value(e.end0 - e.start0) + 2000) / 1000.0::DOUBLE)")} AS gene_density,
  CAST(coalesce(sum(CASE WHEN symbol IN {AMPS} THEN 1 ELSE 0 END), 0) AS INTEGER) AS neighbor_amp_count
  FROM envelopes e LEFT JOIN (SELECT e.peptide_id, symbol, greatest(g."start" - 1 - e.end0, e.start0 - g."end", 0) AS gap FROM envelopes e JOIN genes g ON g.chrom = e.chrom AND greatest(g."start" - 1 - e.end0, e.start0 - g."end", 0) <= 1000) n ON n.peptide_id = e.peptide_id
  GROUP BY e.peptide_id""")

# models: what is exact
SQL["q_cv_folds"] = """WITH l AS (SELECT doc_id AS id, quality AS label FROM labels WHERE quality IS NOT NULL), k AS (SELECT greatest(least(5, CASE WHEN count(*) > 1 THEN min(c) ELSE 0 END), 1) AS k FROM (SELECT count(*) AS c FROM l GROUP BY label))
SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat(id, '|0'))) - 1) % k AS INTEGER) AS fold FROM l, k"""
_std = lambda c: r6(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_samp({c}) OVER () > 1e-12 THEN stddev_samp({c}) OVER () ELSE 1.0 END")
_h = f"CASE WHEN length(seq) > 0 THEN {hyd('seq')} / length(seq) ELSE 0.0 END"
final("standardize", "proteins", f"""SELECT id, {_std("m1_charge")} AS m1_charge, {_std("m1_hydropathy")} AS m1_hydropathy, {_std("m1_aromatic")} AS m1_aromatic
  FROM (SELECT id, {frac("seq", "KR")} - {frac("seq", "DE")} AS m1_charge, {_h} AS m1_hydropathy, {frac("seq", "FWY")} AS m1_aromatic FROM proteins)""")
EMB = ", ".join(r6(count_of("seq", a) + "::DOUBLE / greatest(length(seq), 1)") + f" AS v{i}" for i, a in enumerate("ACDE"))
step("pieces", "proteins", "SELECT id, substring(seq, s + 1, 500) AS p FROM (SELECT id, seq, unnest(CASE WHEN length(seq) <= 500 THEN [0] ELSE range(0, length(seq) - 100, 400) END) AS s FROM proteins)")
final("embed_windows", "pieces", "SELECT id, " + ", ".join(r6(f"sum({count_of('p', a)})::DOUBLE / sum(length(p))") + f" AS v{i}" for i, a in enumerate("ACDE")) + " FROM pieces GROUP BY id")
final("embed_backend", "proteins", f"SELECT id, {EMB} FROM proteins")


# models: what holds at the optimum of a fit, and walks through a forest
step("m1", "proteins", f"SELECT id, n, {stats('seq', 'm1')}, {composition('seq', 'm1')} FROM proteins")
M1 = [f"m1_{k}" for k in ("len", "charge", "cationic", "acidic", "hydropathy", "aromatic", "cys", "gly", "boman")] + [f"m1_aa_{a}" for a in AMINO_ACIDS]
step("m1_labelled", "m1", "SELECT m1.*, quality AS label FROM m1 JOIN labels ON doc_id = n WHERE quality IS NOT NULL")
_moment = lambda c: f"SELECT '{c}' AS term, round(avg({c}) FILTER (WHERE label = 1) / CASE WHEN max(abs({c})) > 0 THEN max(abs({c})) ELSE 1.0 END, 4) + 0.0 AS moment FROM m1_labelled"
final("logreg_optimum", "m1_labelled", "SELECT 'intercept' AS term, 1.0::DOUBLE AS moment UNION ALL " + " UNION ALL ".join(map(_moment, M1)))
_w = lambda v: f"round(avg({v}), 4) + 0.0"
_terms = [_w(f"CASE WHEN substring(win, {i}, 1) = '{a}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END") for i in range(1, 9) for a in AMINO_ACIDS]
_terms += [_w(count_of("win", "KR") + "::DOUBLE / 8"), _w(hyd("win") + " / 8"), *map(_w, (flag(4, "KR"), flag(4, "AGSCT"), flag(5, "FWY")))]
final("cut_model_optimum", "windows", "SELECT 'intercept' AS term, 1.0::DOUBLE AS moment UNION ALL " + " UNION ALL ".join(f"SELECT 'f{i}', {t} FROM windows" for i, t in enumerate(_terms)))
_val = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else repr(x) + ("::DOUBLE" if isinstance(x, float) else "")
step("nodes", "", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_val, r)) + ")" for r in node_rows()) + ') AS v(tree, node, feature, threshold, "left", "right", p)')


def walked(source: str) -> str:
    value = "CASE feature " + " ".join(f"WHEN '{c}' THEN f.{c}" for c in M1) + " END"
    return f"""(WITH RECURSIVE walk(id, tree, node) AS (SELECT id, tree, 0 FROM {source}, (SELECT DISTINCT tree FROM nodes)
  UNION ALL SELECT w.id, w.tree, CASE WHEN {value} <= threshold THEN n."left" ELSE n."right" END FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node JOIN {source} f ON f.id = w.id WHERE feature IS NOT NULL)
  SELECT w.id, avg(p) AS score FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE feature IS NULL GROUP BY w.id)"""


final("predict_peptides", "m1 nodes", f"""SELECT id, CAST(m1_len AS INTEGER) AS length, round(score, 4) AS amp_probability, CASE WHEN score >= 0.5 THEN 'AMP' ELSE 'non-AMP' END AS call
  FROM {walked("m1")} JOIN m1 USING (id)""")
final("forest_scores", "m1_labelled nodes", f"SELECT id, label, {r6('score')} AS score FROM {walked('m1_labelled')} JOIN m1_labelled USING (id)")
_bucket3 = "0"
for _i in range(8):
    _bucket3 = f"(({_bucket3}) * 65536 + CAST(concat('0x', substring(h, {4 * _i + 1}, 4)) AS INTEGER)) % 30"
step("locus_seq", "envelopes dna", f"SELECT peptide_id, upper(seq) AS seq FROM ({fetched('SELECT * FROM envelopes', 'peptide_id')})")
step("dna_grams", "locus_seq", f"""SELECT id, {_bucket3} AS b, sum(n) AS n FROM (SELECT id, md5(m) AS h, n FROM (SELECT id, m, count(*) AS n FROM
  (SELECT peptide_id AS id, substring(seq, i, 3) AS m FROM (SELECT peptide_id, seq, unnest(range(1, length(seq) - 1)) AS i FROM locus_seq)) GROUP BY ALL)) GROUP BY ALL""")
final("dna_embedding", "locus_seq dna_grams", """SELECT p.peptide_id, array_to_string(list_transform(range(0, 30), lambda i: CAST(CAST(round(coalesce(list_sum(list_transform(list_filter(g.v, lambda x: x.b = i), lambda x: x.n)), 0) / coalesce(g.norm, 1) * 10000) AS BIGINT) AS VARCHAR)), ',') AS vec
  FROM locus_seq p LEFT JOIN (SELECT id, list({'b': b, 'n': CAST(n AS DOUBLE)}) AS v, sqrt(sum(CAST(n AS DOUBLE) * n)) AS norm FROM dna_grams GROUP BY id) g ON g.id = p.peptide_id""")

# sources and sinks
final("read_fasta", "proteins", "SELECT id, seq FROM proteins")
final("read_genome", "chunks", "SELECT chrom, chunk_id, seq FROM chunks")
final("read_promoters", "prom_seq", 'SELECT gene, role, chrom, p_start AS "start", p_end AS "end", strand, seq FROM prom_seq')
final("read_hits", "hits", f"SELECT qseqid, sseqid, {r6('pident')} AS pident, CAST(length AS INTEGER) AS length, qlen, slen, {r6('evalue')} AS evalue, {r6('bitscore')} AS bitscore, stitle, full_sseq FROM hits")
final("read_gff", "mrna cds", f"""SELECT CAST(m.mrna_id AS VARCHAR) AS mrna_id, protein, chrom, strand, {r6('score')} AS score, c."start", c."end", CAST(phase AS INTEGER) AS phase
  FROM mrna m JOIN cds c ON c.mrna_id = m.mrna_id""")
final("read_gene_index", "genes", 'SELECT symbol, chrom, "start", "end", strand FROM genes')
final("read_signal", "signal", "SELECT acc, signal_end FROM signal")
SQL["q_read_rules"] = SQL["q_enzyme_rules"]
SQL["q_read_table"] = SQL["q_define_regions"]
final("read_bed", "blocks", "SELECT chrom, CAST(start0 AS BIGINT) AS start0, CAST(end0 AS BIGINT) AS end0, name, strand FROM blocks")
SQL["q_load_pwm"] = SQL["q_pwm"]
