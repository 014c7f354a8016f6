"""Licence scan by canonical digest: entire texts, normalised and hashed, joined to known licences' digests."""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings that licence matching guidelines treat as one.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "https": "http", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

#: The licences' own texts (those short enough to state).
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
BSD_TAIL = """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
GPL3_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""

#: (licence id, text): whole licences and the usual one-line grants; titles that may stand above count as the same text.
KNOWN = [
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC), ("0BSD", ZERO_BSD), ("0BSD", "Zero-Clause BSD\n\n" + ZERO_BSD),
    ("BSD-2-Clause", BSD_HEAD + BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_HEAD + BSD_TAIL),
    ("BSD-3-Clause", BSD_HEAD + BSD_THIRD + BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_HEAD + BSD_THIRD + BSD_TAIL),
    ("Zlib", ZLIB), ("Zlib", "zlib License\n\n" + ZLIB), ("Apache-2.0", APACHE_NOTICE), ("GPL-3.0-or-later", GPL3_NOTICE),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]

#: SPDX ids of the long licences; the files of ``license_texts`` hold the texts. Where a licence comes as "only" and "or
#: later", the text is the same and does not say which.
LONG = {
    "Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2-only",
    "GFDL-1.3": "GFDL-1.3-only", "GPL-1": "GPL-1.0-only", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2": "LGPL-2.0-only",
    "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "Unlicense": "Unlicense",
}
END = "END OF TERMS AND CONDITIONS"


def long_licences() -> list[tuple[str, str]]:
    """(licence id, text) of ``LONG``: each text whole, and without the appendix that follows its terms; both also with a
    line for each paragraph, as taking out copyright lines depends on where lines end. Read by the driver."""
    found = []
    for name, spdx in LONG.items():
        text = (Path(__file__).with_name("license_texts") / f"{name}.txt").read_text(encoding="utf-8")
        for form in {text, text[: text.index(END) + len(END)] if END in text else text}:
            found += [(spdx, form), (spdx, re.sub(r"(?<=\S)[ \t]*\n[ \t]*(?=\S)", " ", form))]
    return found


#: A line that says who holds the copyright, after lower-casing; a wrapped line of a licence that goes on with the
#: word ("copyright holders be liable") is none.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|by |:|[^\n]*[0-9]{4})|\(c\)|©|all rights reserved)[^\n]*"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, every run of characters but letters and digits one blank, one spelling.

    Only ASCII letters and digits count. A null text is an empty one.
    """
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bare = F.regexp_replace(low, COPYRIGHT_LINE, "\n")
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(bare, r"[^a-z0-9]+", " ")), F.lit(" "))
    # British spellings can only be there where one of their stems is: most texts skip the replacements
    # each word between blanks of its own, so that neighbours are both replaced
    spelt = F.replace(flat, F.lit(" "), F.lit("  "))
    for old, new in sorted(SPELLINGS.items()):
        spelt = F.replace(spelt, F.lit(f" {old} "), F.lit(f" {new} "))
    spelt = F.replace(spelt, F.lit("  "), F.lit(" "))
    has = F.regexp_like(flat, F.lit(f" ({'|'.join(sorted(SPELLINGS))}) "))
    return F.trim(F.when(has, spelt).otherwise(flat))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows (digest, license_id), one a digest: the same normalisation as for documents, run by Spark. Without ``known``:
    the short and the long licences."""
    rows = spark.createDataFrame(known or KNOWN + long_licences(), "license_id string, text string")
    return rows.select(F.md5(canonical(F.col("text"))).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, n_words, digest, license_id) for every row of docs(doc_id, text); license_id is null for no licence.

    The whole text must be the licence. Null and empty texts have the empty text's digest and no licence; rows
    with the same doc_id are each scanned; other columns are ignored. The table of licences is a fixed list given
    by the caller, and is broadcast as that; documents are not shuffled.
    """
    text = docs.select("doc_id", canonical(F.col("text")).alias("_c"))
    words = F.when(F.col("_c") == "", 0).otherwise(F.length("_c") - F.length(F.replace(F.col("_c"), F.lit(" "))) + 1)
    hashed = text.select("doc_id", words.cast("long").alias("n_words"), F.md5(F.col("_c")).alias("digest"))
    return hashed.join(F.broadcast(known), "digest", "left").select("doc_id", "n_words", "digest", "license_id")


def scan_lines(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, line, license_id): every line of docs(doc_id, text) that is a known licence by itself, lines counted from 1.

    Each line is judged as ``scan`` judges a text. Null texts have no line; rows that repeat are each read; no row is moved."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    hashed = lines.select("doc_id", (F.col("at") + 1).cast("long").alias("line"), F.md5(canonical(F.col("text"))).alias("digest"))
    return hashed.join(F.broadcast(known), "digest").select("doc_id", "line", "license_id")


def canonical_digest(text: str) -> str:
    """The digest of ``canonical`` for one text, worked out by the driver: the SQL names the long licences by it."""
    flat = re.sub(r"[^a-z0-9]+", " ", re.sub(COPYRIGHT_LINE, "\n", text.translate({c: c + 32 for c in range(65, 91)}))).strip()
    return hashlib.md5(" ".join(SPELLINGS.get(w, w) for w in flat.split(" ")).encode()).hexdigest()


def _sql_parts(known: list[tuple[str, str]] | None) -> tuple:
    """(SQL of a text's canonical form, SQL of the digests of ``known``)."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def form(text: str) -> str:
        low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        bare = f"regexp_replace({low}, {quote(COPYRIGHT_LINE)}, chr(10), 'g')"
        flat = f"' ' || trim(regexp_replace({bare}, '[^a-z0-9]+', ' ', 'g')) || ' '"
        flat = f"replace({flat}, ' ', '  ')"
        for old, new in sorted(SPELLINGS.items()):
            flat = f"replace({flat}, ' {old} ', ' {new} ')"
        return f"trim(replace({flat}, '  ', ' '))"

    short = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in known or KNOWN)
    long = ", ".join(f"({quote(a)}, {quote(canonical_digest(b))})" for a, b in ([] if known else long_licences()))
    more = f" UNION ALL SELECT digest, license_id FROM (VALUES {long}) AS w(license_id, digest)" if long else ""
    return form, f"""
WITH k AS (
  SELECT digest, min(license_id) AS license_id FROM (
    SELECT md5({form("t")}) AS digest, license_id FROM (VALUES {short}) AS v(license_id, t){more}
  ) GROUP BY 1
)"""


def scan_sql(known: list[tuple[str, str]] | None = None) -> str:
    """The scan of the table documents as DuckDB SQL, long licences included."""
    form, digests = _sql_parts(known)
    return f"""{digests}, d AS (
  SELECT doc_id, {form("text")} AS c FROM documents
)
SELECT d.doc_id, CAST(CASE WHEN c = '' THEN 0 ELSE length(c) - length(replace(c, ' ', '')) + 1 END AS BIGINT) AS n_words,
       md5(c) AS digest, k.license_id
FROM d LEFT JOIN k ON k.digest = md5(c)
"""


def scan_lines_sql(known: list[tuple[str, str]] | None = None) -> str:
    """``scan_lines`` of the table documents as DuckDB SQL."""
    form, digests = _sql_parts(known)
    return f"""{digests}, l AS (
  SELECT doc_id, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)
)
SELECT l.doc_id, CAST(l.line AS BIGINT) AS line, k.license_id FROM l JOIN k ON k.digest = md5({form("t")})
"""
