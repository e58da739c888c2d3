"""License scans by canonical digests, in DataFrame functions only.

A text's canonical form has A-Z in lower case, no copyright lines, one blank for any punctuation or
space, and one spelling for equivalent ones. Its SHA-256 is looked up among the digests of known
licences, so only entire texts match. Both sides go through the same steps.

Known licences come as a table (licence, text), any number of wordings each. ``licence_texts`` gives
short licences in their usual wordings and the long ones of a folder of licence files.

Null texts count as empty; texts without a letter or digit have no licence. Where two licences
have one canonical form, the first name in order stands for both. Repeated rows are answered one
by one. Other columns are not read.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Steps on the lower-cased text, in order: a pattern (of Java and RE2 alike) or, where the first is False, a plain string.
STEPS = [
    # a line that names a holder or a year; text that happens to wrap before "copyright holder" or "(c) you must" is none
    (True, r"(^|\n)[ \t]*((portions )?copyright([ \t:]*(\(c\)|©|[0-9]{4}|<|\[|\{)|[ \t]*:)|(\(c\)|©)[ \t]*([0-9]{4}|<|\[|\{))[^\n]*", "\n"),
    (True, r"(^|\n)[ \t]*all rights reserved[. \t\r]*(\n|$)", "\n"),
    (True, r"[^a-z0-9\x{AA}-\x{1FFF}\x{2C00}-\x{10FFFF}]+", " "),
    (True, r"(licen|defen|offen|practi)ce", r"\1se"),
    (True, r"is(e|ed|es|er|ing|ation|ations)( |$)", r"iz\1\2"),
    (True, r"(col|fav|hon|lab|behavi)our", r"\1or"),
    (True, r"(cancel|label|model|signal)l(ed|ing|er)", r"\1\2"),
    (False, "sub license", "sublicense"),
    (False, "non infringement", "noninfringement"),
    (False, "non commercial", "noncommercial"),
    (False, "copyright owner", "copyright holder"),
    (False, "acknowledgement", "acknowledgment"),
    (False, "judgement", "judgment"),
    (False, "analogue", "analog"),
    (False, "catalogue", "catalog"),
    (False, "centre", "center"),
    (False, "wilful", "willful"),
    (False, "whilst", "while"),
    (False, "per cent", "percent"),
    (False, "https", "http"),
]

#: Folder of whole licence texts; those of FILES that are there are taken. Each is read by the driver, up to MOST_BYTES.
FOLDER = "/usr/share/common-licenses"
MOST_BYTES = 1 << 20
# Names of licences by file.
FILES = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause-UC", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0",
    "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
# Texts of public licences, and the titles that they go by; each stands without a title, too.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "ISC License (ISC)", "The ISC License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License'], "Zlib": ["zlib License", "The zlib/libpng License"],
}
_PERMIT = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_TERMS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_TERMS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_BOTH = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
LICENCES = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _PERMIT,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_TERMS,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_TERMS,
    "BSD-2-Clause": _BSD_BOTH + _BSD_TERMS,
    "BSD-3-Clause": _BSD_BOTH + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TERMS,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def canonical(text: Column) -> Column:
    """The canonical form of a text column; a null gives an empty one."""
    out = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    for pattern, old, new in STEPS:
        if pattern:
            for k in "12":
                new = new.replace(f"\\{k}", f"${k}")
            out = F.regexp_replace(out, old, new)
        else:
            out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def digest(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def _files(folder: str) -> list[tuple[str, str]]:
    """(licence, path) of the licence files of a folder."""
    found = [(name, os.path.join(folder, file)) for file, name in sorted(FILES.items()) if os.path.isfile(os.path.join(folder, file))]
    for _, path in found:
        if os.path.getsize(path) > MOST_BYTES:
            raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    return found


def _short_texts() -> list[tuple[str, str]]:
    return [(name, f"{title}\n\n{text}") for name, text in LICENCES.items() for title in ["", *TITLES[name]]]


def licence_texts(folder: str = FOLDER) -> list[tuple[str, str]]:
    """(licence, text): the short licences, with each of their titles and without, and those of the folder's files."""
    out = _short_texts()
    for name, path in _files(folder):
        with open(path, encoding="utf-8") as f:
            out.append((name, f.read()))
    return out


def known_licences(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(licence, text) rows of a list, by default of ``licence_texts``."""
    rows = F.array(*(F.struct(F.lit(k).alias("licence"), F.lit(v).alias("text")) for k, v in (licence_texts() if texts is None else texts)))
    return spark.range(1).select(F.inline(rows))


def scan_licences(docs: DataFrame, licences: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, canonical_chars, canonical_sha256, licence) per row; licence is null where the digest is unknown.

    Texts are not shuffled: only id, length and digest meet the digests of ``licences`` (licence, text),
    which Spark broadcasts if they turn out small and otherwise joins by digest, splitting hot ones.
    """
    known = (licences.select("licence", canonical(F.col("text")).alias("form")).where("form <> ''")
             .groupBy(digest(F.col("form")).alias("canonical_sha256")).agg(F.min("licence").alias("licence")))
    forms = docs.select(F.col(id_col).alias(id_col), canonical(F.col(text_col)).alias("form"))
    return (forms.select(id_col, F.length("form").cast("bigint").alias("canonical_chars"), digest(F.col("form")).alias("canonical_sha256"))
            .join(known, "canonical_sha256", "left").select(id_col, "canonical_chars", "canonical_sha256", "licence"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest of every document, and the licence that its entire text is."""
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"), known_licences(spark))


def _sql(text: str) -> str:
    out = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    for pattern, old, new in STEPS:
        old, new = (x.replace("'", "''") for x in (old, new))
        out = f"regexp_replace({out}, '{old}', '{new}', 'g')" if pattern else f"replace({out}, '{old}', '{new}')"
    return f"trim({out})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licence_sql(folder: str = FOLDER) -> str:
    """DuckDB SQL for ``op4_licences`` with the licences of a folder."""
    known = "VALUES " + ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in _short_texts())
    for name, path in _files(folder):
        known += f" UNION ALL SELECT {_quoted(name)}, content FROM read_text({_quoted(path)})"
    return f"""
WITH k AS (SELECT sha256(f) AS g, min(licence) AS licence FROM (SELECT licence, {_sql('text')} AS f FROM ({known}) AS v(licence, text)) WHERE f <> '' GROUP BY 1),
d AS (SELECT doc_id, {_sql('text')} AS f FROM documents)
SELECT doc_id, CAST(length(f) AS BIGINT) AS canonical_chars, sha256(f) AS canonical_sha256, licence FROM d LEFT JOIN k ON k.g = sha256(f)
"""


OP4_SQL = licence_sql()
