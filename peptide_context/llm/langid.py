"""Language identification by interpolated Kneser-Ney character models, one a language.

A text is read as the sequence of its lower-case words (runs of letters), each framed by a boundary mark. Every
language's model gives a word a cross-entropy; the language of the lowest length-normalised cross-entropy wins,
and texts that no model explains as well as it explains its own training texts are rejected.

A language's model is a table of n-grams in sorted 64-bit hash arrays, found by binary search: log-probabilities of
seen n-grams and back-off weights of seen contexts. It is built by one task from the counts of its sample.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, materialize, small_batches

UNKNOWN = "und"
ORDER = 4
FIT_DOCS = 1500  # bound of the fit: documents a language, chosen by a seeded hash of their text
FIT_CALIBRATE = 5  # every fifth of them is kept from the counts and sets the rejection level,
CALIBRATE_FROM = 20  # in languages with so many different texts; a language with fewer learns from all of them
DISCOUNT = 0.75
TEXT_BYTES = 6 << 20  # of texts that a task scores at a time
_WORDS = regex.compile(r"\p{L}+")
_MARK = "\x02"


def letters(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def gram_hash(codes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the n-gram of ``length`` code points that starts at each position of ``codes`` (uint64)."""
    n = len(codes) - length + 1
    h = np.full(n, 0x51ED270B + length, dtype=np.uint64)
    for i in range(length):
        h = (h ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial n-gram counts of a task's training texts: (lang, n, gram, count)."""
    counts: dict[tuple[str, int], dict[str, int]] = {}
    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words: dict[str, int] = {}
            for w in letters(text):
                words[w] = words.get(w, 0) + 1
            for w, k in words.items():
                framed = _MARK + w + _MARK
                for n in range(1, ORDER + 1):
                    table = counts.setdefault((lang, n), {})
                    for i in range(len(framed) - n + 1):
                        g = framed[i : i + n]
                        table[g] = table.get(g, 0) + k
    for (lang, n), table in counts.items():
        yield pa.record_batch(
            [pa.array([lang] * len(table)), pa.array([n] * len(table), pa.int32()), pa.array(list(table)), pa.array(list(table.values()), pa.int64())],
            ["lang", "n", "gram", "c"],
        )


class Model:
    """For each language, and each order n: ``keys`` and ``contexts`` sorted, with their ``logp`` and ``backoff``."""

    def __init__(self, langs: list[str]):
        none = [np.empty(0, np.uint64), np.empty(0, np.float32)] * 2
        self.langs = langs
        self.tables = [[none for _ in range(ORDER + 1)] for _ in langs]  # keys, logp, contexts, backoff
        self.floor = np.full(len(langs), -16.0)
        self.letters = np.zeros(len(langs))  # number of different ones
        self.limit = np.full((len(langs), 2), np.inf)  # mean, scaled deviation of own texts' cross-entropy

    def _find(self, n: int, at: int, grams: np.ndarray, missing: float) -> np.ndarray:
        """(grams, languages): the values of each n-gram, looked up once for each different one."""
        found, back = np.unique(grams, return_inverse=True)
        out = np.full((len(found), len(self.langs)), missing, np.float32)
        for column, tables in enumerate(self.tables):
            keys, values = tables[n][at : at + 2]
            if len(keys):
                i = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                out[:, column] = np.where(keys[i] == found, values[i], np.float32(missing))
        return out[back]

    def score_words(self, words: list[str]) -> np.ndarray:
        """Sum of log2 probabilities of every word's letters and end mark: (words, languages)."""
        if not words:
            return np.zeros((0, len(self.langs)))
        text = "".join(_MARK + w for w in words) + _MARK
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        mark = codes == ord(_MARK)
        # each predicted position: letters and the end marks; the mark that starts a word is not predicted
        starts = np.flatnonzero(mark)[:-1]
        lengths = np.diff(np.flatnonzero(mark))
        at = np.arange(1, len(codes))
        word = np.repeat(np.arange(len(words)), lengths)
        depth = at - starts[word]  # characters of the word and its start mark before the position
        total = np.zeros((len(at), len(self.langs)), np.float32)
        open_ = np.ones((len(at), len(self.langs)), dtype=bool)
        for n in range(ORDER, 0, -1):
            reach = np.flatnonzero((depth >= n - 1) & open_.any(axis=1))
            if not len(reach):
                continue
            p = self._find(n, 0, gram_hash(codes, n)[at[reach] - n + 1], np.nan)
            use = open_[reach] & ~np.isnan(p)
            sub = total[reach]
            sub[use] += p[use]
            still = open_[reach] & ~use
            if n > 1 and still.any():
                sub += np.where(still, self._find(n, 2, gram_hash(codes, n - 1)[at[reach] - n + 1], 0.0), 0)
            total[reach] = sub
            open_[reach] = still
        total += np.where(open_, self.floor[None, :], 0.0)
        return np.add.reduceat(total, np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0)

    def cross_entropies(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(bits a predicted character for each language, number of predicted characters); 0 characters: no letter.

        Texts are split at white space, and of some megabytes of texts each different piece is scored once.
        """
        bits, size = [np.zeros((0, len(self.langs)))], [np.zeros(0, np.int64)]
        for a, b in byte_slices(texts, TEXT_BYTES):
            lists = pc.ascii_split_whitespace(pc.fill_null(texts.slice(a, b - a), ""))
            pieces = pc.list_flatten(lists).dictionary_encode()
            words = [letters(p) for p in pieces.dictionary.to_pylist()]
            place = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
            names = list(place)
            each = np.concatenate([np.zeros((0, len(self.langs))), *(self.score_words(names[i : i + 20_000]) for i in range(0, len(names), 20_000))])
            used = np.fromiter((place[w] for ws in words for w in ws), np.int64)
            lengths = np.fromiter((len(w) + 1 for w in names), np.int64, len(names))
            edge = np.cumsum([0, *map(len, words)])
            piece_bits = _sums(-each[used], edge)
            piece_size = _sums(lengths[used].astype(np.float64)[:, None], edge)[:, 0]
            code, ends = pieces.indices.to_numpy(), lists.offsets.to_numpy()
            bits.append(_sums(piece_bits[code], ends))
            size.append(np.rint(_sums(piece_size[code][:, None], ends)[:, 0]).astype(np.int64))
        bits, size = np.concatenate(bits), np.concatenate(size)
        return bits / np.maximum(size, 1)[:, None], size


def _sums(rows: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of rows[edge[i] : edge[i + 1]], in doubles."""
    out = np.zeros((len(edge) - 1, rows.shape[1]))
    full = np.flatnonzero(edge[1:] > edge[:-1])
    if len(full):
        out[full] = np.add.reduceat(rows, edge[:-1][full], axis=0, dtype=np.float64)
    return out


def _built(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One language's model from its counts, a row an order. Interpolated Kneser-Ney: the highest order by counts, lower
    orders by how many different characters come before; every stored probability already holds its interpolated lower orders."""
    tables: dict[int, dict[str, int]] = {n: {} for n in range(1, ORDER + 1)}
    for batch in batches:
        for n, gram, c in zip(*(batch.column(x).to_pylist() for x in ("n", "gram", "c")), strict=True):
            tables[n][gram] = c
    alphabet = set(tables[1]) | {_MARK}
    uniform, floor = 1.0 / (len(alphabet) + 64), 0.0
    out: list[list] = [[] for _ in range(7)]
    lower: dict[str, float] = {}
    for n in range(1, ORDER + 1):
        use = dict(tables[n])
        if n < ORDER:
            use = {}
            for g in tables[n + 1]:
                use[g[1:]] = use.get(g[1:], 0) + 1
            for g, c in tables[n].items():  # nothing stands before a start mark: its plain count
                if g[0] == _MARK and len(g) > 1:
                    use[g] = c
        if n == 1:
            use.setdefault(_MARK, 1)
        total: dict[str, float] = {}
        kinds: dict[str, int] = {}
        for g, c in use.items():
            total[g[:-1]] = total.get(g[:-1], 0) + c
            kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
        now = {}
        for g, c in use.items():
            h = g[:-1]
            now[g] = max(c - DISCOUNT, 0) / total[h] + DISCOUNT * kinds[h] / total[h] * (lower.get(g[1:], uniform) if n > 1 else uniform)
        back = {h: DISCOUNT * kinds[h] / total[h] for h in total} if n > 1 else {}
        if n == 1:
            floor = float(np.log2(DISCOUNT * kinds[""] / total[""] * uniform))
        lower = now
        columns = [n]
        for table, size in ((now, n), (back, n - 1)):
            codes = np.frombuffer("".join(table).encode("utf-32-le"), "<u4").astype(np.uint64)
            keys = gram_hash(codes, size)[::size] if table else np.empty(0, np.uint64)
            order = np.argsort(keys)
            columns += [keys[order].tobytes(), np.log2(np.fromiter(table.values(), np.float64, len(table)))[order].astype(np.float32).tobytes()]
        for column, value in zip(out, [*columns, floor, len(alphabet) - 1], strict=True):
            column.append(value)
    kinds_ = (pa.int32(), *[pa.binary()] * 4, pa.float64(), pa.int64())
    names = ["n", "keys", "logp", "contexts", "backoff", "floor", "letters"]
    lang = pa.array([key[0].as_py()] * ORDER, pa.string())
    yield pa.record_batch([lang, *(pa.array(c, k) for c, k in zip(out, kinds_, strict=True))], ["lang", *names])


def training_sample(docs: DataFrame, per_language: int = FIT_DOCS, seed: int = 5) -> DataFrame:
    """At most about ``per_language`` labelled rows a language, by the hash of their text: different texts are
    counted over all rows, and each language keeps the share of hashes that its count calls for, so that one with few
    texts keeps all of them, however many copies there are. Copies of a text count once."""
    h = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30))
    counts = docs.where("lang is not null and text is not null").groupBy("lang").agg(F.approx_count_distinct(h).alias("_n"))
    kept = docs.join(F.broadcast(counts), "lang").withColumn("_h", h)
    kept = kept.where(F.col("_h") * F.col("_n") < F.lit(float(per_language) * (1 << 30)))
    return kept.select("lang", "text", "_h").dropDuplicates(["lang", "text"])


def fit(docs: DataFrame, per_language: int = FIT_DOCS) -> Model:
    """Learns from labelled rows docs(lang, text). The sample is bounded by ``per_language`` documents a language; the model
    holds all n-grams of its sample. Without labelled rows the model has no language.

    A language of at least ``CALIBRATE_FROM`` different texts with letters sets its rejection level by the fifth of them
    that is held back. Any other learns from all its texts, and gets the calibrated languages' pooled level, or, if there
    are none, the level of a uniform code over its letters.
    """
    sample = training_sample(docs, per_language).withColumn("_held", F.pmod(F.col("_h"), F.lit(FIT_CALIBRATE)) == 0)
    sample = materialize(sample.where(F.rlike("text", F.lit(r"\p{L}"))))
    texts = sample.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("_held").alias("held"))
    enough = F.broadcast(materialize(texts.where((F.col("n") >= CALIBRATE_FROM) & (F.col("held") > 1)).select("lang", F.lit(True).alias("_enough"))))
    sample = sample.join(enough, "lang", "left").withColumn("_held", F.col("_held") & F.coalesce("_enough", F.lit(False)))
    grams = sample.where(~F.col("_held")).select("lang", "text").mapInArrow(_count, "lang string, n int, gram string, c long")
    grams = materialize(grams.groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")))
    schema = "lang string, n int, keys binary, logp binary, contexts binary, backoff binary, floor double, letters long"
    rows = grams.groupBy("lang").applyInArrow(_built, schema).collect()
    model = Model(sorted({r["lang"] for r in rows}))
    for r in rows:
        i = model.langs.index(r["lang"])
        pairs = ((r["keys"], r["logp"]), (r["contexts"], r["backoff"]))
        model.tables[i][r["n"]] = [x for k, v in pairs for x in (np.frombuffer(k, np.uint64), np.frombuffer(v, np.float32))]
        model.letters[i] = r["letters"]
        model.floor[i] = r["floor"]
    if not rows:
        return model
    _calibrate(model, sample.where("_held").select("lang", "text"))
    return model


def _calibrate(model: Model, sample: DataFrame) -> None:
    """Mean, and deviation for one square root of a character, of each language's own texts' cross-entropy."""
    shipped = sample.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shipped.value)
        column = {x: i for i, x in enumerate(m.langs)}
        for batch in batches:
            lang = batch.column(0).to_pylist()
            ce, size = m.cross_entropies(batch.column(1))
            own = [ce[i, column[x]] if x in column else np.nan for i, x in enumerate(lang)]
            yield pa.record_batch([pa.array(lang, pa.string()), pa.array(own, pa.float64()), pa.array(size, pa.int64())], ["lang", "ce", "size"])

    seen = sample.mapInArrow(measure, "lang string, ce double, size long").where("size > 0 and not isnan(ce)")
    mean = F.sum(F.col("ce") * F.col("size")) / F.sum("size")
    w = F.least(F.col("size"), F.lit(400))
    sums = [F.avg(x) for x in (w * F.col("ce") * F.col("ce"), w * F.col("ce"), w)]
    for lang, at, a, b, c in seen.groupBy("lang").agg(mean, *sums).collect():
        scaled = a - 2 * at * b + at * at * c  # mean of size * (ce - at) ** 2
        model.limit[model.langs.index(lang)] = (at, max(np.sqrt(max(scaled, 0.0)), 1.0))
    # too few texts to hold any back: the mean of the languages that have a level, with the widest deviation
    known = np.isfinite(model.limit[:, 0])
    if known.any():
        model.limit[~known] = (model.limit[known, 0].mean(), model.limit[known, 1].max())
    else:
        model.limit[:] = np.column_stack([np.log2(model.letters + 1), np.ones(len(model.langs))])


def judge(m: Model, texts: pa.StringArray, deviations: float, margin: float):
    """Lists over texts: language, score, cross-entropy, accepted; see ``classify``."""
    n = len(texts)
    if not m.langs:
        has = [bool(t) and _WORDS.search(t) is not None for t in texts.to_pylist()]
        return [UNKNOWN] * n, np.zeros(n), np.full(n, np.nan), np.array(has, dtype=bool)
    ce, size = m.cross_entropies(texts)
    win = ce.argmin(axis=1)
    has = size > 0
    best = np.where(has, ce[np.arange(n), win], np.nan)
    share = 1.0 / np.exp2(-np.minimum((ce - ce.min(axis=1, keepdims=True)) * 12, 60)).sum(axis=1)
    mean, deviation = m.limit[win, 0], m.limit[win, 1]
    level = mean + np.maximum(margin, deviations * deviation / np.sqrt(np.clip(size, 1, 400)))
    return [m.langs[w] if h else UNKNOWN for w, h in zip(win, has, strict=True)], np.where(has, share, 0.0), best, has & ~(best > level)


def classify(docs: DataFrame, model: Model, deviations: float = 8.0, margin: float = 1.0) -> DataFrame:
    """Rows of docs(doc_id, text) with (lang_pred, score, cross_entropy, accepted).

    score is the winner's share when the languages are weighed by 2 to the minus bits of one average word pair;
    accepted is false for texts without a letter, and where the cross-entropy lies more than ``deviations`` of the
    calibrated deviation (scaled by the root of the length, up to 400 characters), and more than ``margin`` bits,
    above the winner's mean.
    Ties go to the first language in code point order. Null and empty texts are ``und`` with score 0; repeated rows
    are each classified; other columns are ignored. Without a learned language every row is ``und``, and accepted if it has
    a letter: nothing is known that could reject it.
    """
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shipped.value)
        for batch in batches:
            for a, b in byte_slices(batch.column(1), TEXT_BYTES):
                part = batch.slice(a, b - a)
                pred, score, best, ok = judge(m, part.column(1), deviations, margin)
                yield pa.record_batch(
                    [part.column(0), pa.array(pred), pa.array(score), pa.array(best, from_pandas=True), pa.array(ok)],
                    ["doc_id", "lang_pred", "score", "cross_entropy", "accepted"],
                )

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return read.mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, accepted boolean")


def keep_accepted(docs: DataFrame, model: Model, deviations: float = 8.0, margin: float = 1.0) -> DataFrame:
    """The rows of ``docs`` that ``classify`` accepts, with all their columns and without a shuffle."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shipped.value)
        for batch in batches:
            for a, b in byte_slices(batch.column(text), TEXT_BYTES):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(judge(m, part.column(text), deviations, margin)[3]))

    text = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # mapInArrow resolves no names with dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text is divisible by 5; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, accepted): learns from the rows that are not held out."""
    model = fit(docs.where(~held_out()).select("lang", "text"))
    return classify(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "accepted")

