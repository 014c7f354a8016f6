"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.components import spread
from .licenses import scan_lines_sql, scan_sql

QUERIES = {}
SQL = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def register(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


@register
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


@register
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


SQL["op8_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), o AS (
  SELECT payload_digest, max(page_id) AS origin FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN o.origin IS NULL OR o.origin = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN o.origin = p.page_id THEN NULL ELSE o.origin END AS refers_to
FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest AND p.payload_bytes >= 1000
"""


@register
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"))


@register
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import known_digests, scan

    return scan(_table(spark, sf_dir, "documents"), known_digests(spark))


SQL["op10_licenses"] = scan_sql()


@register
def license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that are licences by themselves: in the driver's table no whole text is one, but many lines are."""
    from .licenses import known_digests, scan_lines

    return scan_lines(_table(spark, sf_dir, "documents"), known_digests(spark))


SQL["license_lines"] = scan_lines_sql()


@register
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import search_table

    return search_table(_table(spark, sf_dir, "embeddings"))


SQL["op6_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@register
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


@register
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .suffix_dedup import remove_repeats

    left = remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


@register
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import link

    return link(_table(spark, sf_dir, "documents"))


SQL["op5_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.root AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""


@register
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_dropped")


#: Lines of documents d, those that go, and the texts left: used for the query and for the pipeline's stage.
SQL["op2_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(range(0, len(a))) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)
), u AS (
  SELECT line, length(line) AS n, min(doc_id * 1000000 + pos) AS at FROM l GROUP BY line
), near AS (
  SELECT DISTINCT x.line FROM u x JOIN u y ON y.n = x.n AND x.n >= 20 AND y.at < x.at WHERE levenshtein(x.line, y.line) <= 1
  UNION SELECT DISTINCT x.line FROM u x JOIN u y ON y.n = x.n + 1 AND x.n >= 20 AND y.at < x.at WHERE levenshtein(x.line, y.line) <= 1
  UNION SELECT DISTINCT x.line FROM u x JOIN u y ON y.n = x.n - 1 AND x.n >= 21 AND y.at < x.at WHERE levenshtein(x.line, y.line) <= 1
), j AS (
  SELECT l.doc_id, l.pos, l.line,
         regexp_matches(l.line, '[^ \t\n\x0B\f\r]') AND (near.line IS NOT NULL OR u.at <> l.doc_id * 1000000 + l.pos) AS gone
  FROM l LEFT JOIN u ON u.line = l.line LEFT JOIN near ON near.line = l.line
), t AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text,
         count(*) FILTER (WHERE gone) AS n_dropped
  FROM j GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text,
       CAST(coalesce(t.n_dropped, 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id
"""


@register
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .fill_middle import fill_in_middle, restored

    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL["op13_fill_middle"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
  FROM documents
), c AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n,
         CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(c1, c2)], '') AS prefix,
         array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle, array_to_string(u[greatest(c1, c2) + 1:], '') AS suffix
  FROM c
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@register
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(_table(spark, sf_dir, "documents"))


SQL["op12_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS a
  FROM documents
), w AS (
  SELECT r, lang, source, unnest(a) AS term FROM d
), kept AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), g AS (
  SELECT DISTINCT lang, source FROM d
), v AS (
  SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang
), c AS (
  SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN kept ON kept.lang = w.lang AND kept.term = w.term GROUP BY ALL
), t AS (
  SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source
), full_counts AS (
  SELECT g.lang, g.source, kept.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n, CAST(coalesce(t.n, 0) AS HUGEINT) + 2 * v.v AS total
  FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
  LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // total AS p FROM full_counts
), l AS (
  SELECT f.lang, f.term, 1 + (1000000000 * (sum(f.n) + 2)) // (any_value(x.n) + 2 * any_value(v.v)) AS q
  FROM full_counts f JOIN (SELECT lang, sum(n) AS n FROM full_counts GROUP BY lang) x ON x.lang = f.lang JOIN v ON v.lang = f.lang
  GROUP BY f.lang, f.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(pairs.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, CAST(((p.p - l.q) * (p.p - l.q)) // (p.p + l.q) AS BIGINT)
  FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE p.n > 0 AND p.p > l.q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@register
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import scratch
    from .token_files import read_tokens, write_tokens

    folder = scratch(spark)
    write_tokens(_table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return read_tokens(spark, folder)
