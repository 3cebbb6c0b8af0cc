"""Licence scan by canonical digest: whole texts against known licence texts.

A text is cut into lines; each line is lower-cased, punctuation and white space
become single spaces, and equivalent spellings become one; copyright lines are
dropped.  The digest of all remaining lines is looked up among the digests of
known texts, and so is the digest of each line, as licence notices stand on a
line of their own.  Only DataFrame functions run; documents aren't shuffled for
the lookup as long as the known digests are few, which is checked.

The list of known texts is small: five whole licences (MIT, ISC, 0BSD and two BSD)
and nine one-line notices; other whole texts and headers get no licence.

Defined cases: a null text has a null digest and no licence; an empty text, or
one that is only a copyright line, has the digest of the empty text, which no
known text may have; rows with null or repeated ids are scanned one by one; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 20_000  # of 100 bytes at most; a larger list is joined by shuffle

# Spellings that count as equal, the second form is kept.
EQUIVALENT = [
    ("licence", "license"), ("organisation", "organization"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("judgement", "judgment"),
    ("merchantibility", "merchantability"), ("modelled", "modeled"), ("utilisation", "utilization"),
    ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("whilst", "while"), ("per cent", "percent"),
]
# A copyright line, in lower case and before punctuation goes: the word with a year, a sign or "by" behind it, or alone;
# "(c)" with a year or the word; a copyright sign; or nothing but the reservation of all rights.  A clause that only
# begins with a letter c in brackets, or with the word, stays.
COPYRIGHT = (
    r"^[^\pL\pN\n(\x{A9}]*(?:"
    r"(?:copyright|copr)[^\pL\pN\n\x{A9}]*(?:$|\x{A9}[^\n]*$|(?:c[^\pL\pN\n]|by[^\pL\pN\n]|[0-9]{4})[^\n]*$)"
    r"|\(c\)[^\pL\pN\n]*(?:[0-9]{4}|copyright)[^\n]*$|\x{A9}[^\n]*$|all rights reserved[^\pL\pN\n]*$)"
)

# Known texts, as published.
_WARRANTY_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_WARRANTY_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN_TEXTS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _WARRANTY_MIT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _WARRANTY_ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _WARRANTY_ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
]


def canonical_lines(text: Column) -> Column:
    """Canonical form of each line that says something; copyright lines are left out."""
    without = F.regexp_replace(F.lower(text), "(?md)" + COPYRIGHT, "")
    whole = F.regexp_replace(without, r"[^\p{L}\p{N}\n]+", " ")
    for other, kept in EQUIVALENT:
        whole = F.replace(whole, F.lit(other), F.lit(kept))
    return F.transform(
        F.filter(F.split(whole, "\n"), lambda line: F.trim(line) != ""), lambda line: F.trim(line))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] = KNOWN_TEXTS) -> DataFrame:
    """(digest, license_id) of known texts; the smallest id where texts are canonically equal."""
    frame = spark.createDataFrame(texts, "license_id string, text string")
    body = F.array_join(canonical_lines(F.col("text")), " ")
    return frame.where(body != "").select(digest(body).alias("digest"), "license_id").groupBy("digest").agg(
        F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: digest of the whole canonical text, its licence, and the licences of its lines."""
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast(known) if few else known
    lines = docs.select(F.col(id_column).alias("doc_id"), canonical_lines(F.col(text_column)).alias("lines"))
    marked = lines.select("doc_id", "lines", F.when(
        F.col("lines").isNotNull(), digest(F.array_join("lines", " "))).alias("text_digest"))
    whole = marked.drop("lines").join(side.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
    # Rows with equal ids and equal texts have equal lines, so a match needs no row number.
    matched = marked.select("doc_id", "text_digest", F.explode("lines").alias("line")).select(
        "doc_id", "text_digest", digest(F.col("line")).alias("digest")).join(side, "digest").groupBy(
        F.col("doc_id").alias("id"), F.col("text_digest").alias("text")).agg(
        F.array_sort(F.collect_set("license_id")).alias("line_licenses"))
    return whole.join(matched, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_digest") == F.col("text")), "left").select(
        "doc_id", "text_digest", "license_id",
        F.array_join(F.coalesce("line_licenses", F.array().cast("array<string>")), ",").alias("line_licenses"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def scan_sql(texts: list[tuple[str, str]] = KNOWN_TEXTS) -> str:
    """The same scan of ``documents`` in DuckDB SQL."""
    def lines(text):
        without = f"regexp_replace(lower({text}), {_sql_text('(?m)' + COPYRIGHT)}, '', 'g')"
        whole = f"regexp_replace({without}, '[^\\pL\\pN\n]+', ' ', 'g')"
        for other, kept in EQUIVALENT:
            whole = f"replace({whole}, {_sql_text(other)}, {_sql_text(kept)})"
        return f"list_transform(list_filter(string_split({whole}, chr(10)), lambda x: trim(x) <> ''), lambda x: trim(x))"

    values = ", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in texts)
    return f"""
WITH known AS (
  SELECT sha256(array_to_string({lines("t")}, ' ')) AS digest, min(i) AS license_id
  FROM (VALUES {values}) AS v(i, t) GROUP BY 1),
marked AS (SELECT doc_id, row_number() OVER () AS r, {lines("text")} AS lines FROM documents),
whole AS (SELECT doc_id, r, lines, CASE WHEN lines IS NOT NULL THEN sha256(array_to_string(lines, ' ')) END AS text_digest FROM marked),
matched AS (
  SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses
  FROM (SELECT r, sha256(unnest(lines)) AS digest FROM whole) JOIN known USING (digest) GROUP BY r)
SELECT w.doc_id, w.text_digest, k.license_id, coalesce(m.line_licenses, '') AS line_licenses
FROM whole w LEFT JOIN known k ON k.digest = w.text_digest LEFT JOIN matched m USING (r)"""
