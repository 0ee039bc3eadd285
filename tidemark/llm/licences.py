"""Licence scan by canonical digests.

A text is brought to a canonical form (lower case, copyright lines dropped, punctuation to blanks,
equivalent spellings to one) and its SHA-256 is joined with the digests of known licence texts.
The same look-up is made for every line, since short notices stand on lines of their own. Built-in
functions only, no wildcard or fuzzy matching.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.rows import ROW, numbered

COPYRIGHT_LINE = r"(?m)^[ \t#*/;>-]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}]+"
# fixed values: equivalent spellings, after punctuation has gone
SPELLINGS = (
    (r"\blicence(s|d)?\b", r"license\1"),
    (r"\bsub license\b", "sublicense"),
    (r"\bnon commercial\b", "noncommercial"),
    (r"\bnon infringement\b", "noninfringement"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\bcopyright holder(s?)\b", r"copyright owner\1"),
    (r"\bversion (\d+) 0\b", r"version \1"),
    (r"\bv(\d+) 0\b", r"version \1"),
)

# fixed values: texts of known licences and of their usual notices
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
""" + _BSD_TAIL),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License 2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)


def canonical(text: Column) -> Column:
    """The form that is hashed; a null text counts as empty."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, PUNCTUATION, " ")
    for pattern, spelling in SPELLINGS:
        out = F.regexp_replace(out, pattern, spelling.replace("\\", "$"))
    return F.trim(out)


def known_digests(spark: SparkSession, texts=KNOWN) -> DataFrame:
    """``license_id, digest`` of known texts; texts that are equal in canonical form need one id."""
    table = spark.createDataFrame(list(texts), "license_id string, text string")
    return table.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).distinct()


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, canonical_sha256, license_id, notices, n_notice_lines`` for every row of ``docs``.

    ``license_id`` is that of the known text which the whole text equals in canonical form, else null;
    ``notices`` are the distinct ids of lines that do, sorted and joined by commas. Null, empty
    and punctuation-only texts have the digest of the empty text and match only if that is known.
    Repeated rows each get a row; an empty table gives none; other columns are not read. Lines
    are looked up by a join, which is broadcast only while the known digests are small.
    """
    rows = numbered(
        docs, F.col(doc_id).alias("doc_id"), F.sha2(canonical(F.col(text)), 256).alias("digest"),
        F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
                    lambda line: F.unhex(F.sha2(canonical(line), 256))).alias("lines"))
    whole = known.select("digest", F.col("license_id"))
    of_line = known.select(F.unhex("digest").alias("digest"), "license_id")
    lines = rows.select(ROW, F.explode("lines").alias("digest")).join(of_line, "digest").groupBy(ROW).agg(
        F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"),
        F.count("*").alias("n"))
    return rows.select(ROW, "doc_id", "digest").join(whole, "digest", "left").join(lines, ROW, "left").select(
        "doc_id", F.col("digest").alias("canonical_sha256"), "license_id",
        F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n", F.lit(0)).alias("n_notice_lines"))


def canonical_sql(text: str) -> str:
    """The canonical form in SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(lower(coalesce({text}, '')), {quoted(COPYRIGHT_LINE)}, '', 'g')"
    out = f"regexp_replace({out}, {quoted(PUNCTUATION)}, ' ', 'g')"
    for pattern, spelling in SPELLINGS:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(spelling)}, 'g')"
    return f"trim({out})"


def scan_sql() -> str:
    """The scan of ``documents`` in SQL."""
    values = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in KNOWN)
    return f"""
WITH known AS (
  SELECT DISTINCT license_id, sha256({canonical_sql("t")}) AS digest
  FROM (VALUES {values}) AS k(license_id, t)),
rows AS (SELECT doc_id, text, sha256({canonical_sql("text")}) AS digest FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
found AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(*) AS n
  FROM (SELECT doc_id, sha256({canonical_sql("line")}) AS digest FROM lines) JOIN known USING (digest)
  GROUP BY doc_id)
SELECT r.doc_id, r.digest AS canonical_sha256, k.license_id, coalesce(f.notices, '') AS notices,
       coalesce(f.n, 0) AS n_notice_lines
FROM rows r LEFT JOIN known k USING (digest) LEFT JOIN found f ON r.doc_id = f.doc_id"""
