"""Licence scan by canonical digests, with DataFrame functions only.

A licence text, a document and each line of a document are brought to one canonical
form: case, copyright lines, equivalent spellings and punctuation are normalised.
Entire canonical texts are hash-joined to digests of known licences; the table of
known licences is a constant of the library, so its broadcast is bounded.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# SPDX identifiers and wordings of short licences and notices, as published.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Distributed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("proprietary", "All rights reserved."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n'
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
)
_MIT = next(text for name, text in NOTICES if name == "MIT" and len(text) > 500)
_ISC = next(text for name, text in NOTICES if name == "ISC" and len(text) > 100) + (
    '\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
)
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_REFERENCE = "\nFor more information, please refer to <{}://unlicense.org{}>"


def _bsd(clauses: int, mark: str, holder: str) -> str:
    """The BSD text of 2 or 3 clauses, numbered or with the list mark `mark`."""
    conditions = (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    )[:clauses]
    return "\n".join((
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        *(f"{mark or f'{i}.'} {c}" for i, c in enumerate(conditions, 1)),
        f'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT {holder} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {holder} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ))


# Titles that files of these licences carry.
_TITLED = (
    ("MIT", ("", "MIT License", "The MIT License", "The MIT License (MIT)"), (_MIT,)),
    ("ISC", ("", "ISC License", "The ISC License"), (_ISC,)),
    ("BSD-2-Clause", ("", "BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'), tuple(_bsd(2, mark, holder) for mark in ("", "*") for holder in ("HOLDER", "HOLDERS"))),
    ("BSD-3-Clause", ("", "BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'), tuple(_bsd(3, mark, holder) for mark in ("", "*") for holder in ("HOLDER", "HOLDERS"))),
    ("Unlicense", ("", "The Unlicense", "Unlicense"), (_UNLICENSE, *(_UNLICENSE + _REFERENCE.format(*x) for x in (("http", "/"), ("https", ""), ("http", ""), ("https", "/"))))),
)
#: Whole licence texts with and without title and the sentence that often follows the copyright line.
TEXTS = tuple((name, f"{title}\n{rights}\n{text}") for name, titles, texts in _TITLED for title in titles for rights in ("", "All rights reserved.") for text in texts)
#: The tag line of every licence that a notice names.
TAGS = tuple((name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in NOTICES} - {"proprietary"}))
KNOWN = NOTICES + TAGS + TEXTS
# Equivalent spellings; the first of each pair is read as the second.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("copyrighted", "copyright"), ("favour", "favor"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("per cent", "percent"), ("ver", "version"), ("v", "version"))

# A copyright line: the word or mark with a number after it, both marks, or the word first and a year anywhere.
_MARK = r"(\(c\)|©)"
_COPYRIGHT = rf"(?m)^[ \t/*#;-]*((copyright|{_MARK})[ \t:]*({_MARK}[ \t]*)?[0-9]|copyright[ \t:]*{_MARK}|{_MARK}[ \t]*copyright|copyright[ \t:][^\n]*(19|20)[0-9][0-9])[^\n]*$"
_PUNCTUATION = r"[^0-9a-zß-öø-ÿ]+"
# In order: copyright lines go, then punctuation becomes a space, then spellings, then spaces.
_RULES = [(_COPYRIGHT, " "), (_PUNCTUATION, " "), *((rf"\b{a}\b", b) for a, b in SPELLINGS)]


def canonical_text(text: str) -> str:
    """The canonical form in Python, for digests of known texts."""
    out = text.lower()
    for pattern, replacement in _RULES:
        out = re.sub(pattern, replacement, out)
    return out.strip(" ")


def _spelled(words: Column) -> Column:
    for pattern, replacement in _RULES[2:]:
        words = F.regexp_replace(words, pattern, replacement)
    return F.trim(words)


def canonical(text: Column) -> Column:
    """The same form as a Column."""
    out = F.lower(text)
    for pattern, replacement in _RULES[:2]:
        out = F.regexp_replace(out, pattern, replacement)
    return _spelled(out)


def _possible(words: Column, known: tuple[tuple[str, str], ...]) -> Column:
    """Whether the spelled form of `words` can be that of a known text: its first and last word are theirs, or become theirs by spelling.

    Spelling changes whole words of a-z only, so a word with any other letter always passes.
    """
    forms, tests = [canonical_text(text) for _, text in known], []
    for place, at in ((0, 1), (-1, -1)):
        allowed = {f.split(" ")[place] for f in forms}
        while more := {a.split(" ")[place] for a, b in SPELLINGS if b.split(" ")[place] in allowed} - allowed:
            allowed |= more
        word = F.substring_index(words, " ", at)
        tests.append(word.isin(sorted(allowed)) | word.rlike("[^0-9a-z]"))
    return tests[0] & tests[1]


def texts_in(spark: SparkSession, folder: str, most: int = 5000) -> tuple[tuple[str, str], ...]:
    """(name, text) of the files of a folder, each one whole licence text named by its identifier, to be passed on as `known` beside KNOWN.

    Known texts are a table that every task holds, so a folder of more than `most` files is refused.
    """
    files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))
    rows = files.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{folder} holds more than {most} texts")
    return tuple(sorted((re.sub(r"\.txt$", "", r["name"]), r["text"]) for r in rows))


def known_licenses(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """digest, license: one row a distinct canonical text."""
    rows = sorted({hashlib.sha256(canonical_text(text).encode()).hexdigest(): name for name, text in known}.items())
    return spark.createDataFrame(rows, "digest string, license string")


def _units(docs: DataFrame, known: tuple[tuple[str, str], ...]) -> DataFrame:
    """doc_id, tk (a hash of the text, which tells rows of one doc_id apart), line, license.

    Copyright lines and punctuation go from a text once; only units whose first and last
    word can be those of a known text are spelled and digested.
    """
    low, marked = F.col("low"), F.col("low").contains("copyright") | F.col("low").contains("(c)") | F.col("low").contains("©")
    plain = F.regexp_replace(F.when(marked, F.regexp_replace(low, _COPYRIGHT, " ")).otherwise(low), _PUNCTUATION.replace("]+", r"\n ]+"), " ")
    texts = docs.select("doc_id", F.xxhash64("text").alias("tk"), F.lower(F.coalesce("text", F.lit(""))).alias("low")).select("doc_id", "tk", plain.alias("plain"))
    every = F.concat(F.array(F.translate("plain", "\n", " ")), F.split("plain", "\n"))
    both = texts.select("doc_id", "tk", F.posexplode(every).alias("place", "unit")).select("doc_id", "tk", (F.col("place") - 1).alias("line"), F.trim("unit").alias("unit"))
    likely = both.filter(_possible(F.col("unit"), known)).withColumn("unit", F.regexp_replace("unit", " +", " "))
    units = likely.select("doc_id", "tk", "line", F.sha2(_spelled(F.col("unit")).cast("binary"), 256).alias("digest"))
    return units.join(F.broadcast(known_licenses(docs.sparkSession, known)), "digest").select("doc_id", "tk", "line", "license")


def license_units(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """doc_id, line (-1: the entire text), license of every text unit that is a known licence.

    Lines and texts are brought to their canonical form; those whose first or last word no
    known text has go before spellings are read, which loses none. Null and empty texts have no unit; a null doc_id is kept, repeated rows each.
    """
    return _units(docs, known).drop("tk")


def license_scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """doc_id, is_license, n_lines, licenses (sorted, comma-joined) of every document.

    is_license: the entire text is a known licence; n_lines: its lines that are one.
    Null and empty texts match nothing. Matches belong to a doc_id and its text, so rows
    without a doc_id or with a repeated one have those of their own text. An
    empty table gives no rows. Only doc_id and text are read; texts are scanned whole.
    """
    found = _units(docs, known).groupBy("doc_id", "tk").agg(F.max(F.col("line") == -1).alias("is_license"), F.countDistinct(F.when(F.col("line") >= 0, F.col("line"))).alias("n_lines"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("tk"))
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["tk"] == found["tk"]), "left")
    return joined.select(rows["doc_id"], F.coalesce("is_license", F.lit(False)).alias("is_license"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("licenses", F.lit("")).alias("licenses"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    form = "lower(coalesce({}, ''))"
    for pattern, replacement in _RULES:
        form = f"regexp_replace({form}, {quoted(pattern)}, {quoted(replacement)}, 'g')"
    form = f"trim({form}, ' ')"
    known = ", ".join(f"({quoted(digest)}, {quoted(name)})" for digest, name in sorted({hashlib.sha256(canonical_text(t).encode()).hexdigest(): n for n, t in KNOWN}.items()))
    return f"""
WITH known(digest, license) AS (VALUES {known}),
units AS (SELECT doc_id, -1 AS line, text AS unit FROM documents
  UNION ALL SELECT doc_id, line, unit FROM (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line, unnest(string_split(text, chr(10))) AS unit FROM documents)),
found AS (SELECT doc_id, line, license FROM units JOIN known ON known.digest = sha256({form.format("unit")})),
g AS (SELECT doc_id, bool_or(line = -1) AS is_license, count(DISTINCT CASE WHEN line >= 0 THEN line END) AS n_lines, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.is_license, false) AS is_license, CAST(coalesce(g.n_lines, 0) AS BIGINT) AS n_lines, coalesce(g.licenses, '') AS licenses FROM documents d LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
