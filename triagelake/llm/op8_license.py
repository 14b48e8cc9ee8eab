"""Licence scans by canonical digest lookup (DataFrame functions only).

Texts are brought to a canonical form -- lower case, equivalent spellings,
no copyright lines, no punctuation, single spaces -- and their SHA-256 is
hash-joined to the digests of known licences. The units looked up are whole
texts and whole lines: a document that *is* a licence matches as a whole, and
a stated licence ("Released under the MIT License.") matches as a line.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

# ---- Fixed values: names and public standard texts -------------------------
NAMES = [
    ("MIT", ["MIT License"]),
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"]),
    ("GPL-2.0", ["GNU General Public License, version 2", "GPLv2", "GPL-2.0"]),
    ("GPL-3.0", ["GNU General Public License, version 3", "GPLv3", "GPL-3.0"]),
    ("LGPL-2.1", ["GNU Lesser General Public License, version 2.1"]),
    ("LGPL-3.0", ["GNU Lesser General Public License, version 3"]),
    ("AGPL-3.0", ["GNU Affero General Public License, version 3"]),
    ("MPL-2.0", ["Mozilla Public License, version 2.0"]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "Simplified BSD License"]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "New BSD License"]),
    ("ISC", ["ISC License"]),
    ("CC0-1.0", ["CC0 1.0"]),
    ("CC-BY-4.0", ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"]),
    ("CC-BY-SA-4.0", ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"]),
    ("CC-BY-NC-4.0", ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"]),
    ("CC-BY-ND-4.0", ["CC BY-ND 4.0"]),
    ("Unlicense", ["Unlicense"]),
]
NOTICES = [
    "Licensed under {}.",
    "Licensed under the {}.",
    "Released under the {}.",
    "Distributed under the {}.",
    "This work is licensed under the {}.",
    "This work is licensed under {}.",
    "This project is licensed under the {}.",
    "This software is released under the {}.",
]
TEXTS = [
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
]
#: First lines that a short text may have or lack.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License"],
    "Zlib": ["zlib License", "The zlib License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"],
    "Unlicense": ["The Unlicense"],
}
#: Last line of a licence's terms; what follows tells how to apply it.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"
#: Spellings that licence matching treats as equal: found, taken as.
SPELLINGS = [
    ("licence", "license"),
    ("copyright holder", "copyright owner"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("non-commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("whilst", "while"),
    ("https:", "http:"),
    ("&", " and "),
]
COPYRIGHT_LINE = r"^[^a-z0-9©]*(copyright|\(c\)|©)[^a-z]*(\(c\)|©|[0-9]{4}|<year>|by ).*|^[^a-z0-9]*all rights reserved[^a-z0-9]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"
# ---- End of fixed values ----------------------------------------------------


def canonical_lines(text: Column) -> Column:
    """Canonical form of every line; copyright lines and lines without a
    letter or digit become ''. NULL text has no lines."""
    t = F.lower(text)
    for found, taken in SPELLINGS:
        t = F.replace(t, F.lit(found), F.lit(taken))
    return F.transform(
        F.split(t, "\n"),
        lambda x: F.when(x.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(F.btrim(F.regexp_replace(x, NOT_WORD, " "))))


def canonical_text(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def full_texts() -> list[tuple[str, str]]:
    """Licence id and text of TEXTS and of the files of ``licenses`` (an id, and
    a number if there are more for it), with the forms in which they are
    usual: with or without a title, clauses numbered or not, with or without
    what follows the terms."""
    files = sorted((f for f in resources.files(__package__).joinpath("licenses").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    texts = TEXTS + [(re.sub(r"(\.[2-9])?\.txt$", "", f.name), f.read_text(encoding="utf-8")) for f in files]
    out = []
    for i, text in texts:
        forms = [text]
        if END_OF_TERMS in text:
            terms = text[:text.index(END_OF_TERMS)]
            forms += [terms, terms + END_OF_TERMS]
        if i in TITLES:
            first, _, rest = text.partition("\n")
            plain = rest if first in TITLES[i] else text
            bare = re.sub(r"(?m)^\s*\d\. ", "", plain)
            forms += [f for body in (plain, bare) for f in (body, *[f"{t}\n{body}" for t in TITLES[i]])]
        out += [(i, f) for f in dict.fromkeys(forms)]
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    """``digest``, ``license_id`` of the full texts and of every notice line
    that the notice patterns make of the names."""
    rows = full_texts()
    rows += [(i, n.format(name)) for i, names in NAMES for name in names for n in NOTICES]
    rows += [(i, f"SPDX-License-Identifier: {i}") for i, _ in NAMES]
    values = ", ".join(f"({_sql(i)}, {_sql(t)})" for i, t in rows)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t(license_id, text)")
    canon = canonical_text(canonical_lines(F.col("text")))
    return df.groupBy(F.sha2(canon, 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def scan_licenses(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``text_sha256`` (digest of its canonical
    text), ``license`` (known licence the whole text equals, else NULL),
    ``n_lines`` (lines with a canonical form), ``n_notices`` (lines that equal
    a known text) and ``notices`` (their licence ids, sorted, comma-joined).

    NULL text: as an empty one, with no line; its digest is that of ''.
    Repeated rows give repeated results. ``licenses`` is a fixed-size table
    (``known_licenses`` has under 400 rows), so both hash joins broadcast it;
    only matched lines are shuffled, grouped by the row's id and text hash, so
    a notice that a third of all lines repeat is spread over its documents.
    """
    known = F.broadcast(licenses.select(F.col("digest").alias("_digest"), F.col("license_id").alias("_license")))
    rows = (docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
            .select("_id", F.xxhash64("_text").alias("_th"), canonical_lines(F.col("_text")).alias("_lines"))
            .select("_id", "_th", "_lines", F.sha2(canonical_text(F.col("_lines")), 256).alias("_digest"),
                    F.size(F.filter("_lines", lambda x: x != "")).cast("long").alias("n_lines")))
    lines = (rows.select("_id", "_th", F.explode(F.filter("_lines", lambda x: x != "")).alias("_line"))
             .select("_id", "_th", F.sha2("_line", 256).alias("_digest")))
    # repeated rows would count their lines twice: count the rows as well
    copies = rows.groupBy("_id", "_th").agg(F.count(F.lit(1)).alias("_copies"))
    found = (lines.join(known, "_digest").groupBy("_id", "_th")
             .agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_set("_license")).alias("_ids")))
    found = (found.join(copies, (found["_id"].eqNullSafe(copies["_id"])) & (found["_th"] == copies["_th"]))
             .select(found["_id"].alias("_fid"), found["_th"].alias("_fth"),
                     (F.col("_n") / F.col("_copies")).cast("long").alias("_n"), F.array_join("_ids", ",").alias("_ids")))
    whole = rows.drop("_lines").join(known, "_digest", "left")
    return (whole.join(found, whole["_id"].eqNullSafe(found["_fid"]) & (whole["_th"] == found["_fth"]), "left")
            .select(F.col("_id").alias(id_col), F.col("_digest").alias("text_sha256"), F.col("_license").alias("license"),
                    "n_lines", F.coalesce("_n", F.lit(0)).cast("long").alias("n_notices"),
                    F.coalesce("_ids", F.lit("")).alias("notices")))


def op8_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents", "doc_id", "text"), known_licenses(spark))
