"""Every dealt operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns;
results against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

llm = pytest.importorskip("peptide_context.llm")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, rank int"


def sentence(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()):
    return " ".join(rng.choice(words) + str(rng.randint(0, 9)) for _ in range(n))


def corpus():
    rng = random.Random(7)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    passage = sentence(rng, 90)
    texts = [base, " ".join(near), base, sentence(rng, 40) + "\n" + passage, passage + "\n" + sentence(rng, 30), None, "", "   \n\t", "one two", "one two", "x" * 30_000]
    texts += [sentence(rng, rng.randint(1, 60)) for _ in range(30)]
    line = "this line is repeated word for word"
    texts += [f"{line}\nown {i} {sentence(rng, 8)}" for i in range(5)] + [f"{line[:-1]}t\nmore {sentence(rng, 9)}", f"{line}s\nlast {sentence(rng, 9)}"]
    sources = ["b", "a", None, "c"]
    return [(i, t, "en" if i % 2 else None, sources[i % 4], 0, -1, "n", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    from peptide_context.llm.packing import pack_documents, solve

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = pack_documents(docs, path, 256).toPandas()
    for i, text, *_ in corpus():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = rows[rows.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0] and own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length, strict=True)]
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256
    assert pack_documents(none, path).count() == 0
    used = Counter()
    for combo, n in solve({3: 10, 5: 7, 8: 2, 1: 30}, 8):
        assert sum(combo) <= 8
        for k in combo:
            used[k] += n
    assert used == {3: 10, 5: 7, 8: 2, 1: 30}


def test_packing_words():
    import public_tokenizers
    import pyarrow as pa
    import pyarrow.compute as pc

    from peptide_context.llm.packing import _spans, _Words

    k = _Words(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    chars = [*"abeiosStRLléÉßñÀÿªµºĳŉįİıΣσς", *"'.,!?%$#&*()<|>-_`~", *"0129", *" \t\n\r\x0b\x0c\x1c\x85\xa0\u2003", "\u0301", "\u0327", "가", "漢", "🙂", "'s", "'LL", "<|endoftext|>", "<|startoftext|>"]
    texts = ["Émile's ÀÉ don't stop, now...", "İstanbul ΣΑΣ x́y ẞ ª º", "<|endoftext|> a,. 12a3", "a b\x1cc d", "", "  ", "x" * 5000 + "!" * 300]
    texts += ["".join(rng.choice(chars) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    for at in range(0, len(texts), 1500):
        lists = pc.ascii_split_whitespace(pa.array(texts[at : at + 1500]))
        words = pc.list_flatten(lists).dictionary_encode()
        pool, start, length = k.encode(words.dictionary)
        code, edge = words.indices.to_numpy(), lists.offsets.to_numpy()
        for i, text in enumerate(texts[at : at + 1500]):
            own = code[edge[i] : edge[i + 1]]
            assert _spans(pool, start[own], length[own]).tolist() == k.plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_rows(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from peptide_context.llm.packing import pack_documents

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    long = " ".join(f"word{k}" for k in range(60_000))
    rows = [(1, "the same row", 5), (1, "the same row", 5), (None, "no id", 0), (None, None, 0), (2, long, 1), (3, " \n", 2)] + [(10 + k, "tie tie", 0) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank long").withColumn("part", F.lit(1)).withColumn("at", F.lit(1)).withColumn("_base", F.lit(1))
    got = pack_documents(df.repartition(3), path, 64, ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    want = Counter((i, s, len(ids[s : s + 64])) for i, text, _ in rows for ids in [[*t.encode(text or "", add_special_tokens=False).ids, 1]] for s in range(0, len(ids), 64))
    assert Counter((r["doc_id"], r["start"], r["length"]) for r in got) == want
    own = sorted((r["start"], r["ids"]) for r in got if r["doc_id"] == 2)
    assert np.frombuffer(b"".join(x for _, x in own), "<u4").tolist() == [*t.encode(long, add_special_tokens=False).ids, 1]
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all([o for o, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1].tolist()] and sum(n for _, n in p) <= 64 for p in places.values())


def test_mixing(docs, none):
    from peptide_context.llm.mixing import fit_counts, mix

    rows = mix(docs).toPandas()
    again = mix(docs.repartition(3)).toPandas()
    key = ["doc_id", "taken"]
    assert rows[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in corpus()}
    assert rows.set_index("doc_id")["size"].to_dict() == sizes
    assert (rows.taken <= 3 * rows["size"]).all() and ((rows.taken == 0) | (rows.taken % rows["size"].clip(lower=1) == 0)).all()
    per = rows.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert per.target.sum() == pytest.approx(sum(sizes.values())) and (per.target <= 3 * per.index + 1e-6).all()
    assert ((per.taken - per.target).abs() < 30).all()
    assert mix(none).count() == 0
    got = fit_counts(np.array([3, 7, 50]), np.array([10, 10, 10]), 254)
    assert (got * [3, 7, 50]).sum() == 254 and (got <= 10).all()


def brute_lines(rows, least=20):
    def close(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]

    seen, short, out = [], set(), {}
    for i, text, *_ in rows:
        if text is None:
            out[i] = None
            continue
        kept = []
        for line in text.split("\n"):
            if len(line) >= least:
                if any(close(line, s) for s in seen):
                    seen.append(line)
                    continue
                seen.append(line)
            elif line.strip(" \t\n\x0b\f\r"):  # short ones go where they repeat
                if line in short:
                    continue
                short.add(line)
            kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_line_dedup(docs, none):
    from peptide_context.llm.line_dedup import dedup_lines

    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_dropped"]
    want = brute_lines(corpus())
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    assert got.where("n_dropped > 0").count() >= 7 and dedup_lines(none).count() == 0


def test_suffix_dedup(docs, none):
    from peptide_context.llm.suffix_dedup import remove_repeats

    texts = {i: (t or "").encode() for i, t, *_ in corpus()}
    seen = Counter(t[k : k + 400] for t in texts.values() for k in range(len(t) - 399))
    got = {r["doc_id"]: r for r in remove_repeats(docs).collect()}
    removed = 0
    for i, t in texts.items():
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        assert (got[i]["n_bytes"], got[i]["n_removed"], bytes(got[i]["kept"])) == (len(t), int(gone.sum()), kept)
        removed += int(gone.sum())
    assert removed > 2000 and remove_repeats(none).count() == 0
    twice = docs.where("doc_id = 0")
    assert [r["n_removed"] for r in remove_repeats(twice.union(twice)).collect()] == [len(texts[0])] * 2


def test_ngram_join(docs, none):
    from peptide_context.llm.ngram_join import link

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t, *_ in corpus()}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in link(docs).collect()}
    assert got == {i: (len(s), comp[i]) for i, s in sets.items()}
    assert comp[1] == 0 and link(none).count() == 0


EMB = "vec_id long, embedding array<float>, label int, rank int, unit string"


def vectors(dim=16, n=240):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim))
    x[50:90] = x[50] + rng.normal(size=(40, dim)) * 0.04
    x[100] = x[101]
    rows = [(i, [float(np.float32(v)) for v in x[i]], i % 2 if i >= 90 else 1, 0, "u") for i in range(n)]
    bad = [(n, None, 1, 0, "u"), (n + 50, [1.0, None], 1, 0, "u"), (n + 100, [float("nan")] * dim, 1, 0, "u"), (n + 101, [0.0] * dim, 1, 0, "u"), (n + 102, rows[50][1], None, 0, "u"), (n + 103, [1.0, 2.0], 1, 0, "u")]
    return rows + bad


def test_topk(spark):
    from peptide_context.llm.topk import search_table

    rows = vectors()
    good = {i: np.floor(256 * np.array(v, dtype=float)).astype(int) for i, v, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in good:
        if q % 50 == 0:
            scores = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])}
    df = spark.createDataFrame(rows, EMB)
    assert {tuple(r) for r in search_table(df.repartition(5)).collect()} == want
    assert search_table(df.where("false")).count() == 0


def test_topk_products():
    """Bounds leave few products to compute, whatever the vectors, and the result is exact, with ties and repeats."""
    from peptide_context.llm.topk import BlockSearch

    rng = np.random.default_rng(5)
    for dim, share, make in ((64, 0.08, lambda n: rng.normal(size=(n, 64))), (32, 0.2, lambda n: np.repeat(rng.normal(size=(n // 4 + 1, 32)), 4, axis=0)[:n]), (2, 1.0, lambda n: rng.normal(size=(n, 2)))):
        q, x = (np.floor(256 * make(n)).astype(np.int64) for n in (100, 6000))
        search = BlockSearch(np.arange(100), q, 5)
        for at in range(0, 6000, 1000):
            search.add(np.arange(at, at + 1000), x[at : at + 1000])
        full = q @ x.T
        full[np.arange(100), np.arange(100)] = -(2**62)
        want = {(i, int(j), int(full[i, j])) for i in range(100) for j in sorted(range(6000), key=lambda j: (-full[i, j], j))[:5]}
        assert {(int(a), int(b), int(c)) for a, b, c in zip(search.row, search.vec, search.score, strict=True)} == want
        assert search.products <= share * full.size, (dim, search.products / full.size)


def test_topk_multiplications():
    """Bounds never cost much more than all products, and save most of them where few components carry the vectors."""
    from peptide_context.llm.topk import BlockSearch, levels

    rng = np.random.default_rng(6)
    spread = np.where(np.arange(64) % 8 == 3, 1.0, 0.05)
    for limit, order, make in ((1.1, None, lambda n: rng.normal(size=(n, 64))), (0.35, np.argsort(-spread, kind="stable").tolist(), lambda n: rng.normal(size=(n, 64)) * spread)):
        q, x = (np.floor(256 * make(n)).astype(np.int64) for n in (200, 20_000))
        search = BlockSearch(np.arange(-200, 0), q, 5, order)
        for at in range(0, 20_000, 1000):
            search.add(np.arange(at, at + 1000), x[at : at + 1000])
        full = q @ x.T
        assert sorted(search.score.tolist()) == sorted(np.sort(full, axis=1)[:, -5:].ravel().tolist())
        assert search.multiplications <= limit * full.size * 64, search.multiplications / full.size / 64
    assert levels(64) == [8, 16, 32, 48, 56, 64] and levels(1) == [1] and levels(0) == [0]


def test_topk_same_id_huge_numbers_and_dimensions(spark):
    from peptide_context.llm.topk import component_orders, top_k

    big = 1 << 30
    rows = [(0, [5, 1]), (0, [2, 9]), (1, [1, 1]), (1, [1, 1]), (2, [-3, 4]), (3, []), (4, []), (5, [1]), (6, [big, -big, 3]), (7, [big, big, 1]), (8, [-big, -big, 5])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = {}
    for r in top_k(df, df, 2, block=2, lane_bytes=40).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {
        0: [(2, 30), (1, 11)], 1: [(0, 11), (0, 6)], 2: [(0, 30), (1, 1)], 3: [(4, 0)], 4: [(3, 0)], 6: [(8, 15), (7, 3)],
        7: [(6, 3), (8, 5 - 2 * big * big)], 8: [(6, 15), (7, 5 - 2 * big * big)],
    }
    assert component_orders(df)[2] in ([0, 1], [1, 0]) and component_orders(df.where("false")) == {}


def test_embedding_dedup(spark):
    from peptide_context.llm.embedding_dedup import decode, near_duplicates, roots

    rows = vectors()
    ok = {i: (np.array(v, dtype=float) / np.linalg.norm(v), lab) for i, v, lab, *_ in rows if v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {(a, b) for a in ok for b in ok if a != b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= 0.98}
    df = spark.createDataFrame(rows, EMB)
    got = {r["vec_id"]: r for r in near_duplicates(df, size=16).collect()}
    assert len(got) == len(rows)
    found, true = sum(r["n_links"] for r in got.values()), len(links)
    assert true > 500 and 0.9 * true <= found <= true
    assert got[242 + 100]["n_links"] == 0 and got[60]["component_id"] == 50 and not got[60]["kept"] and got[50]["kept"]
    assert near_duplicates(df.where("false")).count() == 0
    x = np.random.default_rng(1).normal(size=(200, 8))
    p = decode(x)
    assert len(roots()) == 240 and ((((x - p)[:, None] - roots()[None]) ** 2).sum(2).min(1) >= ((x - p) ** 2).sum(1) - 1e-9).all()


def test_warc(spark, tmp_path):
    from peptide_context.llm.warc import plan_records, read_records, read_warc_files, round_trip, write_archives

    big = "<p>é" + "word " * 300
    rows = [(1, "http://a/\r\nx", big), (2, None, big), (7, "u", big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", "")]
    rows += [(100 + i, "u", f"<html>{i} " + "text " * 50) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("content", F.lit(1))
    got = {r["page_id"]: r for r in round_trip(df).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert got[i]["refers_to"] == (7 if i in (1, 2) else None) and got[i]["record_type"] == ("revisit" if i in (1, 2) else "response")
        assert got[i]["payload"] == (None if i in (1, 2) else html or "")
    blobs = [bytes(r["content"]) for r in write_archives(plan_records(df)).collect()]
    (tmp_path / "a.warc.zst").write_bytes(blobs[0])
    assert read_warc_files(spark, str(tmp_path)).count() == sum(1 for _ in read_records(blobs[0]))
    with pytest.raises(ValueError):
        list(read_records(blobs[0][:-3]))
    with pytest.raises(ValueError):
        list(read_records(b"\x00" * 20))
    assert round_trip(df.where("false")).count() == 0


def test_langid(spark):
    from peptide_context.llm.langid import fit, identify, keep_accepted

    rng = random.Random(9)
    syll = {"aa": "ka to mi ra su ne".split(), "bb": "schl ung ber eich ter".split()}
    rows = []
    for i in range(240):
        lang = "aa" if i % 3 else "bb"
        rows.append((i, " ".join("".join(rng.choice(syll[lang]) for _ in range(rng.randint(1, 4))) for _ in range(40)), lang if i % 17 else None))
    rows += [(900, None, "aa"), (901, "", None), (902, "123 !? 4", "bb"), (903, "qxzj wqpx zzxq jjqw " * 30, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in identify(df).collect()}
    assert all(got[i]["lang_pred"] == ("aa" if i % 3 else "bb") for i in range(240))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902)) and not got[903]["accepted"]
    kept = {r["doc_id"] for r in keep_accepted(df, fit(df.select("lang", "text"))).collect()}
    assert kept == set(range(240))
    assert all(r["lang_pred"] == "und" for r in identify(df.withColumn("lang", df["lang"].substr(9, 1)).where("lang is null and doc_id < 20")).collect())
    assert identify(df.where("false")).count() == 0


def test_licenses(spark, docs, none):
    from peptide_context.llm.licenses import ISC, MIT, known_digests, scan

    rows = [(1, "Copyright (c) 2020 A. Nobody\n\n" + MIT.upper()), (2, MIT.replace("\n", "  ").replace(",", " ;")), (3, MIT + " and more"), (4, None), (5, ""),
            (6, "(C) Me. All rights reserved.\n" + ISC), (7, "Released under the MIT Licence!"), (7, "Released under the MIT Licence!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(0))
    got = [(r["doc_id"], r["license_id"]) for r in scan(df, known_digests(spark)).orderBy("doc_id").collect()]
    assert got == [(1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, "ISC"), (7, "MIT"), (7, "MIT")]
    assert scan(none, known_digests(spark)).count() == 0
