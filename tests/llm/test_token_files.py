"""Token files: an exact round trip against the tokenizer itself, lost attempts, other widths, damaged files."""

import os
import zlib

import numpy as np
import pytest

pytest.importorskip("peptide_context.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, shard int, name string, base long"
PATH = public_tokenizers.path("word_bpe_49k.json")


def rows():
    texts = ["Some words, and more words.", None, "", " \n", "naïve café 日本 😀", "x" * 5_000, "word " * 300_000, "<|endoftext|> inside", "a", "a"]
    found = [(7 * i % 10 - 3, t) for i, t in enumerate(texts)]
    return found + [(100, "same row"), (100, "same row"), (101, "tie one"), (101, "tie two"), (None, "no id"), (None, None)]


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    from peptide_context.llm.token_files import read_index, read_tokens, write_tokens

    t = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(*r, 0, "n", 1) for r in rows()], SCHEMA).repartition(4)
    folder = str(tmp_path / "tokens")
    manifest = write_tokens(docs, folder, PATH).orderBy("shard").collect()
    got = sorted((tuple(r) for r in read_tokens(spark, folder).collect()), key=lambda r: r[1])
    order = [r[0] for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    at, left = 0, sorted((-9 if i is None else i, len(ids_of(t, x)), zlib.crc32(ids_of(t, x).tobytes())) for i, x in rows())
    assert sorted((-9 if r[0] is None else r[0], r[2], r[3]) for r in got) == left
    for _, start, n, _ in got:
        assert start == at
        at += n
    # the files themselves: bases are prefix sums, ids stand where the index says, two bytes each
    base = 0
    for m in manifest:
        width, offsets, ids, _ = read_index(folder, m.name)
        assert (m.base, width, len(ids)) == (base, 2, m.n_docs) and offsets[0] == base
        assert os.path.getsize(f"{folder}/{m.name}.bin") == 2 * m.n_tokens
        base += m.n_tokens
    assert base == at and sum(m.n_docs for m in manifest) == len(rows())


def test_strays_and_damage(spark, tmp_path):
    from peptide_context.llm.token_files import read_tokens, write_tokens

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    folder = str(tmp_path / "tokens")
    manifest = write_tokens(docs, folder, PATH, end_id=70_000).where("n_docs > 0").collect()
    assert {m.width for m in manifest} == {4}
    (tmp_path / "tokens" / "shard-000000-lost.bin").write_bytes(b"half an attempt")
    assert read_tokens(spark, folder).count() == 20
    name = f"{folder}/{manifest[0].name}.bin"
    with open(name, "r+b") as f:
        f.truncate(os.path.getsize(name) - 4)
    with pytest.raises(Exception, match="cut off"):
        read_tokens(spark, folder).count()


def test_empty_table(spark, tmp_path):
    from peptide_context.llm.token_files import read_tokens, write_tokens

    write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"), PATH)
    assert read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_steps_of_few_ids(monkeypatch):
    from peptide_context.llm import token_files

    monkeypatch.setattr(token_files, "STEP", 3)
    ids = np.arange(40, dtype="<u2")
    ends = np.array([0, 1, 2, 2 + 11, 14, 15, 16, 40])
    expected = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert token_files._checksums(ids, ends) == expected


def test_stems_are_learnt_once(monkeypatch):
    from collections import Counter

    import pyarrow as pa
    from tokenizers import Tokenizer

    from peptide_context.llm import packing

    plain, learn, learnt = Tokenizer.from_file(PATH), packing._Words._learn, Counter()

    def counted(self, stems):
        learnt.update(stems.to_pylist() if isinstance(stems, pa.Array) else stems)
        return learn(self, stems)

    monkeypatch.setattr(packing._Words, "_learn", counted)
    texts = [f"Once{'abcdefghij'[k % 10]}, é{chr(97 + k % 26)} zürich. {chr(97 + k // 26)}x 12 don't" for k in range(200)] + [None, "", " "]

    def encode():
        batches = [pa.record_batch([pa.array([k]), pa.array([t], pa.string())], ["doc_id", "text"]) for k, t in enumerate(texts)]
        return [flat.tolist() for _, _, flat in packing.encoded(iter(batches), PATH, 2)]

    want = [ids_of(plain, t).tolist() for t in texts]
    assert encode() == want
    assert len(learnt) >= 40 and max(learnt.values()) == 1


def test_few_stems_kept(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from peptide_context.llm import packing

    plain = Tokenizer.from_file(PATH)
    texts = ["alpha beta, gamma", "beta delta epsilon zeta!", "beta", "", "alpha beta"]
    for most in ({"most": 0}, {"most": 3}, {"most_ids": 5}, {"most": 4}):
        known = packing._Words(PATH, **most)
        for t in [*texts, *texts]:
            words = pa.array(t.split(), pa.string())
            pool, start, length = known.encode(words)
            assert packing._spans(pool, start, length).tolist() == plain.encode(t, add_special_tokens=False).ids
            assert len(known.stems) <= known.most and len(known.at) == len(known.stems) + 1 and known.at[-1] == len(known.pool) <= known.most_ids
