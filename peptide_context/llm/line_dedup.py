"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

A line goes if an earlier line of any document is the same or lies within one edit (a character put in, taken out
or replaced). Deleting one character at each place gives a line's variants; lines within one edit share a variant.
To emit few of them, a coarse round comes first: a line is cut into blocks, and each block in turn is deleted; lines
within one edit agree on such a remainder, and only where two lines do are the block's own characters deleted one
by one. Hashed variants are joined, the edit distance is verified, the earliest line stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields_of, materialize, small_side, whole_row

BLOCKS = 3
MIN_CHARS = 20
LINE = "\n"


def _remainders(line: Column, length: Column) -> Column:
    """Array of (r, j, key): the line without block j, the blocks taken for a length of r: the line's own, and one
    less, for partners that lack a character."""
    found = []
    for less in (0, 1):
        r = length - less
        for j in range(BLOCKS):
            start, end = F.floor(r * j / BLOCKS).cast("int"), F.floor(r * (j + 1) / BLOCKS).cast("int")
            key = F.xxhash64(F.left(line, start), F.right(line, r - end), r, F.lit(j))
            found.append(F.struct(F.lit(less).alias("less"), F.lit(j).alias("j"), key.alias("key")))
    return F.array(*found)


def _variants(line: Column, length: Column, less: Column, j: Column, key: Column) -> Column:
    """Array of (v, role): hashed deletion variants of block j under the remainder ``key``.

    role 0: the block without the character at one place, and that place (lines of one length that differ there);
    role 1: the whole block; role 2: the block of a line longer by one, without one character.
    """
    r = length - less
    start = F.floor(r * j / BLOCKS).cast("int")
    size = F.floor(r * (j + 1) / BLOCKS).cast("int") - start + less
    block = F.substring(line, start + 1, size)
    places = F.sequence(F.lit(1), size)
    left = lambda i: F.concat(F.left(block, i - 1), F.right(block, size - i))
    row = lambda v, role: F.struct(v.alias("v"), F.lit(role).alias("role"))
    swap = F.transform(places, lambda i: row(F.xxhash64(key, i, left(i)), 0))
    whole = F.array(row(F.xxhash64(key, F.lit(0), block), 1))
    longer = F.transform(places, lambda i: row(F.xxhash64(key, F.lit(0), left(i)), 2))
    return F.when(less == 0, F.concat(swap, whole)).otherwise(longer)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, short: bool = True) -> DataFrame:
    """``docs`` with its columns, ``text`` without the lines that go, ``n_chars`` (if there) counted again, and n_dropped.

    Lines are what stands between line feeds, in the order of doc_id (null first) and place in the text. Lines of
    fewer than ``min_chars`` characters go if an earlier line is exactly the same, as one edit makes another word of a short
    line; blank ones always stay, and without ``short`` all of them. A line is judged against all
    earlier lines, also those that go themselves. Every row stays, with an empty text if all its lines go; null texts stay null.
    Rows alike in doc_id and text share their fate: both keep the lines that come first there. Other columns are
    passed on (an n_dropped of the input is replaced); an empty table gives an empty result.

    Scale: a line's place and hashes are shuffled, not its text; a line that very many documents share is
    pre-aggregated to one row before anything is joined; texts are fetched only for lines whose remainder is shared. To be
    built again, the rows are shuffled once, at every size alike, by doc_id and hash, without a sort: the lists of places are the hashed side.
    """
    if min_chars < 2 * BLOCKS:
        raise ValueError(f"min_chars must be at least {2 * BLOCKS}")
    lines = docs.select(
        F.col("doc_id").alias("_d"), F.xxhash64("doc_id", "text").alias("_r"), F.posexplode(F.split("text", LINE)).alias("_pos", "_line")
    )
    lines = lines.withColumn("_len", F.length("_line"))
    long = F.col("_len") >= min_chars
    lines = lines.where(long | F.rlike("_line", F.lit(r"\S")) if short else long)
    ids = [F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(7), F.col("_line")).alias("_h2")]
    at = F.struct("_d", "_r", "_pos")
    keyed = lines.select(*ids, at.alias("_at"), F.when(long, _remainders(F.col("_line"), F.col("_len"))).alias("_keys"))
    kept = [F.count("*").alias("_n"), F.min("_at").alias("_at"), F.first("_keys").alias("_keys")]
    distinct = materialize(keyed.groupBy("_h1", "_h2").agg(*kept))

    # lines that share a remainder, with their texts
    keys = distinct.select("_at", F.explode("_keys").alias("_k")).select("_at", "_k.*")
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("_m")).where("_m > 1").select("key"))
    close = keys.join(small_side(shared), "key").select("_at._d", "_at._r", "_at._pos", "less", "j", "key")
    wanted = close.groupBy(F.col("_d").alias("_wd"), F.col("_r").alias("_wr")).agg(F.collect_set(F.struct("_pos", "less", "j", "key")).alias("_want"))
    wanted = small_side(materialize(wanted))
    fetched = lines.join(wanted, F.col("_d").eqNullSafe(F.col("_wd")) & (F.col("_r") == F.col("_wr")))
    fetched = fetched.select(at.alias("_at"), "_line", "_len", F.explode("_want").alias("_w")).where("_w._pos = _at._pos")
    fetched = materialize(fetched.select("_at", "_line", "_len", "_w.less", "_w.j", "_w.key"))

    # equal variants: the earliest line that a line may be within one edit of
    expanded = fetched.select("_at", F.explode(_variants(*(F.col(c) for c in ("_line", "_len", "less", "j", "key")))).alias("_v"))
    expanded = expanded.select("_at", "_v.*")
    first = [F.min(F.when(F.col("role") == k, F.col("_at"))).alias(f"_m{k}") for k in range(3)]
    groups = expanded.groupBy("v").agg(F.count("*").alias("_m"), *first).where("_m > 1").drop("_m")
    earlier = F.when(F.col("role") == 0, F.col("_m0")).when(F.col("role") == 1, F.col("_m2")).otherwise(F.col("_m1"))
    pairs = expanded.join(groups, "v").select("_at", earlier.alias("_before")).where("_before < _at").distinct()
    texts = fetched.select("_at", "_line").distinct()
    pairs = pairs.join(texts, "_at").join(texts.toDF("_before", "_other"), "_before")
    pairs = pairs.where(F.levenshtein("_line", "_other", 1).between(0, 1))
    edited = materialize(pairs.select(*ids).distinct())

    # which occurrences go, and their documents without them
    near = small_side(edited.withColumn("_near", F.lit(True)))
    judged = distinct.drop("_keys").join(near, ["_h1", "_h2"], "left").where("_n > 1 or _near")
    judged = small_side(materialize(judged.select("_h1", "_h2", F.col("_at").alias("_first"), F.coalesce("_near", F.lit(False)).alias("_near"))))
    gone = lines.select(*ids, "_d", "_r", "_pos").join(judged, ["_h1", "_h2"])
    gone = gone.where(F.col("_near") | (at != F.col("_first"))).groupBy(F.col("_d").alias("_gd"), F.col("_r").alias("_gr"))
    gone = materialize(gone.agg(F.collect_set("_pos").alias("_gone"))).hint("shuffle_hash")
    full = docs.select(whole_row(docs), F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_rk"))
    full = full.join(gone, F.col("_id").eqNullSafe(F.col("_gd")) & (F.col("_rk") == F.col("_gr")), "left")
    full = full.withColumn("_text", F.col("_row").getField("text").cast("string"))
    stays = F.filter(F.split("_text", LINE), lambda x, i: ~F.array_contains("_gone", i))
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(stays, LINE))
    full = full.select("_row", text.alias("_text"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_dropped"))
    made = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long"), "n_dropped": F.col("_dropped")}
    own = zip(docs.columns, fields_of(docs), strict=True)
    rest = [] if "n_dropped" in docs.columns else [F.col("_dropped").alias("n_dropped")]
    return full.select(*[made[c].alias(c) if c in made else x for c, x in own], *rest)
