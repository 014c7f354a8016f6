"""Texts that spell the vocabulary's special tokens."""

import zlib

import numpy as np
import pytest

packing = pytest.importorskip("peptide_context.llm.packing")


def test_special_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [(1, "one <|endoftext|> two"), (2, "a<|startoftext|>b <|endoftext|>. <|ENDOFTEXT|> <|endof text|>"), (3, "<|endoftext|><|endoftext|>\n"), (4, "plain")]
    got = {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    for i, text in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))
    assert 49407 in t.encode(rows[0][1], add_special_tokens=False).ids
