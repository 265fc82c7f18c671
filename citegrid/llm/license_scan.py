"""Licence scan by canonical digest.

A text and the known licence texts get the same canonical form, whose digests are
compared, so a match is a whole text that differs from a licence only in case,
punctuation, white space, copyright lines or equivalent spellings. All of it is built-in
column functions in one scan; the table of known digests is small and Spark measures it
before broadcasting.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Signs outside ASCII that count as punctuation or white space.
SIGNS = " §«®·»‐‑‒–—―‘’‚“”„" \
        "•…  ™−　﻿"

#: A line that states a copyright, in lower case and with its line break before it.
COPYRIGHT_LINE = (
    r"(^|\n)[ \t\r#*/;.!%-]*((portions |parts )?copyright[ \t:]*(\(c\)|©|[0-9]{4}|<year>|\[year\]|\[yyyy\]|\{year\})"
    r"|(\(c\)|©)[ \t]*[0-9]{4}|all rights reserved[. \t\r]*(\n|$))[^\n]*").replace(r"©", "©")

#: Spellings that count as equal: the second replaces the first in the canonical form,
#: where words are in lower case and set apart by single spaces.
SPELLINGS = (
    (" licence", " license"),
    (" sub license", " sublicense"),
    (" sublicence", " sublicense"),
    (" acknowledgement", " acknowledgment"),
    (" judgement", " judgment"),
    (" analogue", " analog"),
    (" catalogue", " catalog"),
    (" centre", " center"),
    (" favour", " favor"),
    (" honour", " honor"),
    (" labour", " labor"),
    (" authoris", " authoriz"),
    (" organis", " organiz"),
    (" recognis", " recogniz"),
    (" utilis", " utiliz"),
    (" initialis", " initializ"),
    (" artefact", " artifact"),
    (" whilst ", " while "),
    (" wilful", " willful"),
    (" fulfil ", " fulfill "),
    (" non commercial", " noncommercial"),
    (" per cent ", " percent "),
    (" copyright owner", " copyright holder"),
    (" https ", " http "),
)

#: Known texts by SPDX name, long ones in files; notices of one line are marked as such.
MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_BSD_HEAD = """Copyright (c) <year> <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_TAIL = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
ZLIB = """Copyright (c) <year> <copyright holders>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>
"""
_BSD2, _BSD3 = _BSD_HEAD + _BSD_TAIL, _BSD_HEAD + _BSD_NAMES + _BSD_TAIL
_ISC = (_ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n"
        + _ISC_TAIL)


def _file(name: str) -> str:
    return files("citegrid.llm").joinpath("licenses", f"{name}.txt").read_text(encoding="utf-8")


def _titled(name: str, titles: Sequence[str], *bodies: str) -> list[tuple[str, str]]:
    """Each text alone and under each title, with and without the numbers of its points."""
    bodies = tuple(dict.fromkeys(b for body in bodies for b in (body, re.sub(r"(?m)^[1-9]\. ", "", body))))
    return [(name, title + "\n\n" + body) for title in ("", *titles) for body in bodies]


def _long(name: str, title_lines: Sequence[int], end: str = "") -> list[tuple[str, str]]:
    """A file as it is and without its first lines, each also up to ``end``, where what follows is advice."""
    lines = _file(name).strip().splitlines(keepends=True)
    texts = ["".join(lines[n:]) for n in (0, *title_lines)]
    return [(name, t) for text in texts for t in ([text, text[:text.index(end) + len(end)]] if end else [text])]


_END = "END OF TERMS AND CONDITIONS"
KNOWN = (
    *_titled("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)"), MIT.removeprefix("MIT License\n")),
    *_titled("BSD-2-Clause", ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'), _BSD2),
    *_titled("BSD-3-Clause", ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'),
             _BSD3, _file("BSD-3-Clause")),
    *_titled("ISC", ("ISC License", "The ISC License", "ISC License (ISC)"), _ISC),
    *_titled("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD"), _ISC_GRANT + ".\n" + _ISC_TAIL),
    *_titled("Zlib", ("zlib License", "The zlib License", "The zlib/libpng License"), ZLIB),
    *_titled("Unlicense", ("The Unlicense", "Unlicense"), UNLICENSE),
    *_long("Apache-2.0", (3,), _END),
    *_long("GPL-1.0", (2,), _END),
    *_long("GPL-2.0", (2,), _END),
    *_long("GPL-3.0", (2,), _END),
    *_long("LGPL-2.0", (2,), _END),
    *_long("LGPL-2.1", (2,), _END),
    *_long("LGPL-3.0", (2,)),
    *_long("MPL-2.0", (2,)),
    *_long("CC0-1.0", (1, 3)),
    ("notice: MIT", "Released under the MIT License."),
    ("notice: Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("notice: GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("notice: CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

# --- end of fixed values --------------------------------------------------------------

#: Runs of ASCII signs and white space, once letters are in lower case.
_GAPS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def canonical(text: Column) -> Column:
    """The canonical form: words in lower case, each with one space before and one behind the last."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    kept = F.regexp_replace(low, COPYRIGHT_LINE, "\n")
    words = F.regexp_replace(F.translate(kept, SIGNS + "©", " " * (len(SIGNS) + 1)), _GAPS, " ")
    form = F.concat(F.lit(" "), F.trim(words), F.lit(" "))
    for spelling, same in SPELLINGS:
        form = F.replace(form, F.lit(spelling), F.lit(same))
    return form


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] = KNOWN) -> DataFrame:
    """``(digest, license)`` of the known texts, one row per digest."""
    rows = spark.range(1).select(F.explode(F.array(
        *[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in known])).alias("k"))
    return (rows.select(F.sha2(canonical(F.col("k.text")), 256).alias("digest"), F.col("k.license").alias("license"))
            .groupBy("digest").agg(F.min("license").alias("license")))


def scan(docs: DataFrame, known: Sequence[tuple[str, str]] = KNOWN) -> DataFrame:
    """``(doc_id, canonical_length, canonical_sha256, license)``, one row per input row.

    ``license`` is null where the whole text is no known one. Null and empty texts, and
    texts of signs or copyright lines alone, have an empty canonical form of two spaces
    and no licence. Equal rows give equal rows; of licences with equal canonical forms
    the first name counts. An empty table gives an empty result; further columns are
    not read.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), canonical(F.col("text").cast("string")).alias("form")).select(
        "doc_id", F.length("form").cast("bigint").alias("canonical_length"), F.sha2(F.col("form"), 256).alias("digest"))
    return rows.join(known_digests(docs.sparkSession, known), "digest", "left").select(
        "doc_id", "canonical_length", F.col("digest").alias("canonical_sha256"), "license")


def scan_sql(table: str = "documents", known: Sequence[tuple[str, str]] = KNOWN) -> str:
    """The same scan as SQL for the check."""

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def form(column: str) -> str:
        low = f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"
        kept = f"regexp_replace({low}, {text(COPYRIGHT_LINE)}, chr(10), 'g')"
        signs = f"translate({kept}, {text(SIGNS + chr(0xa9))}, '{' ' * (len(SIGNS) + 1)}')"
        out = f"' ' || trim(regexp_replace({signs}, '{_GAPS}', ' ', 'g'), ' ') || ' '"
        for spelling, same in SPELLINGS:
            out = f"replace({out}, '{spelling}', '{same}')"
        return out

    values = ", ".join(f"({text(name)}, {text(body)})" for name, body in known)
    return f"""
WITH k AS (SELECT sha256({form('body')}) AS digest, min(license) AS license FROM (VALUES {values}) v(license, body) GROUP BY 1),
d AS (SELECT doc_id, {form('text')} AS form FROM {table})
SELECT doc_id, length(form)::BIGINT AS canonical_length, sha256(form) AS canonical_sha256, k.license
FROM d LEFT JOIN k ON sha256(form) = k.digest"""
