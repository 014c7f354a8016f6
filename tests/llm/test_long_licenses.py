"""Whole texts of the long licences."""

from pathlib import Path

import pytest

licenses = pytest.importorskip("peptide_context.llm.licenses")


def test_long_licenses(spark):
    folder = Path(licenses.__file__).with_name("license_texts")
    texts = {p.stem: p.read_text(encoding="utf-8") for p in folder.iterdir()}
    assert set(texts) == set(licenses.LONG) and {"Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0", "CC0-1.0", "Unlicense"} <= set(texts)
    rows = [(k, t) for k, t in texts.items()] + [(k, "Copyright (c) 2020 A. Nobody\n\n" + t.upper()) for k, t in texts.items()]
    rows += [("Apache-2.0", texts["Apache-2.0"].split("   APPENDIX")[0]), (None, texts["GPL-3"] + " and more"), (None, texts["MPL-2.0"][:3000])]
    rows += [("GPL-2", texts["GPL-2"].split("            How to Apply")[0].replace("\n", "\r\n"))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string"), licenses.known_digests(spark)).collect()
    assert len(got) == len(rows) and all(r["license_id"] == licenses.LONG.get(r["doc_id"]) for r in got)
