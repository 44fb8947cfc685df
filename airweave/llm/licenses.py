"""Licence scan by canonical digests, in DataFrame functions only.

A text is brought to a canonical form (lower case, no copyright lines, one
spelling for equivalent ones, punctuation and white space as single spaces) and
its digest is looked up among those of known licence texts by a hash join. These
are a table of ids and texts; without one, the constants of this module and the
texts in ``known`` are built into the plan, with the title lines that they are
found under, and broadcast, as their number is fixed. The lines of a text that
speak of a licence are looked up alike, among one-line notices.

Defined cases: null and empty texts have the canonical form "" and match
nothing; repeated rows give repeated results; null ids are carried; extra
columns are ignored; of known texts with one canonical form the smallest id counts.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public licence texts (without their copyright lines) by SPDX id.
MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{more}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD2 = _BSD.replace("{more}", "")
BSD3 = _BSD.replace("{more}", "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n")
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
MIT_0 = MIT.split("\n\nThe above")[0].replace("MIT License", "MIT No Attribution").replace(", subject to the following conditions:", ".") + "\n\n" + MIT.split("\n\n")[-1]
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
LICENSES = {"MIT": MIT, "MIT-0": MIT_0, "ISC": ISC, "0BSD": ZERO_BSD, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "Zlib": ZLIB, "Unlicense": UNLICENSE, "BSL-1.0": BOOST}
#: Lines that stand above these texts; "" for none.
TITLES = {
    "MIT": ["", "MIT License", "The MIT License", "The MIT License (MIT)"],
    "MIT-0": ["", "MIT No Attribution", "MIT-0 License"],
    "ISC": ["", "ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["", "BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"],
    "BSD-2-Clause": ["", "BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["", "BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License", "Modified BSD License"],
    "Zlib": ["", "zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
    "Unlicense": ["", "The Unlicense", "Unlicense"],
    "BSL-1.0": ["", "Boost Software License - Version 1.0 - August 17th, 2003"],
}
#: One-line notices.
NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under the MIT License.": "MIT",
    "Released under the MIT License.": "MIT",
    "Licensed under the BSD 3-Clause License.": "BSD-3-Clause",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0-only",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "SPDX-License-Identifier: MIT": "MIT",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
QUOTES, PLAIN = "‘’“”–—", "''\"\"--"
#: (pattern, replacement with \1, \2): copyright lines; punctuation and space; then equivalent spellings.
RULES = [
    (r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|:|[0-9<{]|\[)|copyright[ \t][^\n]*([12][0-9][0-9][0-9]|foundation|and other contributors|, inc\b|\bltd\b|\bllc\b|\bgmbh\b|corporation)|\(c\)[ \t]*(copyright|[0-9])|©)[^\n]*", r"\1"),
    (r"(^|\n)[^a-z0-9\n]*all rights reserved[^\n]*", r"\1"),
    (r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " "),
]
SPELLINGS = [
    (r"\b(sub ?)licen[cs](e|es|ed|ing|or|ors|ee|ees)\b", r"sublicens\2"),
    (r"\blicenc(e|es|ed|ing|or|ors|ee|ees)\b", r"licens\1"),
    (r"\b(organi|authori|recogni|utili|reali|optimi|initiali|minimi|customi)s(e|ed|es|ing|ation|ations)\b", r"\1z\2"),
    (r"\b(col|fav|behavi|hon)our", r"\1or"),
    (r"\bnon (infringement|commercial|exclusive)\b", r"non\1"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bcopyright owner(s?)\b", r"copyright holder\1"),
]


def canonical(text: Column) -> Column:
    """Canonical form of a text; see :data:`RULES` and :data:`SPELLINGS`."""
    out = F.translate(F.translate(F.coalesce(text, F.lit("")), QUOTES, PLAIN), UPPER, LOWER)
    for pattern, to in RULES:
        out = F.regexp_replace(out, pattern, to.replace("\\", "$"))
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to.replace("\\", "$"))
    return F.trim(out)


def known(spark, table: DataFrame | None = None) -> DataFrame:
    """(canonical_md5, license_id) of a table of known texts (license_id, text), or of those built in."""
    if table is None:
        rows = F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("text")) for k, v in known_texts()])
        table = spark.range(1).select(F.inline(rows))
    return table.groupBy(F.md5(canonical(F.col("text"))).alias("canonical_md5")).agg(F.min("license_id").alias("license_id"))


def known_texts() -> list[tuple[str, str]]:
    """Known texts under each of their titles; the Apache licence also without its appendix."""
    out = []
    for k, text in LICENSES.items():
        head, _, rest = text.partition("\n\n")
        out += [(k, f"{t}\n\n{rest if head in TITLES[k] else text}") for t in TITLES[k]]
    for f in sorted(resources.files("airweave.llm").joinpath("known").iterdir(), key=lambda f: f.name):
        text = f.read_text(encoding="utf-8", errors="replace")
        out += [(f.name.removesuffix(".txt"), x) for x in {text: 0, text.partition("APPENDIX: How to apply")[0]: 0}]
    return out


def scan(df: DataFrame, table: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, canonical_md5, license_id (null unless the whole text is a known licence), notices (ids that its lines give).

    ``table``: known texts (license_id, text) in place of those built in, of any size.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[Ll][Ii][Cc][Ee][Nn][CcSs]"))
    ids = F.create_map(*[F.lit(x) for k, v in NOTICES.items() for x in (_plain_canonical(k), v)])
    notices = F.array_sort(F.array_distinct(F.filter(F.transform(lines, lambda x: F.try_element_at(ids, canonical(x))), lambda x: x.isNotNull())))
    rows = df.select(F.col(id_col).alias("doc_id"), F.md5(canonical(text)).alias("canonical_md5"), F.concat_ws(",", notices).alias("notices"))
    texts = known(df.sparkSession, table)
    return rows.join(texts if table is not None else F.broadcast(texts), "canonical_md5", "left").select("doc_id", "canonical_md5", "license_id", "notices")


def _plain_canonical(text: str) -> str:
    """:func:`canonical` of a constant, in Python when the plan is built."""
    import re

    out = text.translate(str.maketrans(QUOTES, PLAIN)).translate(str.maketrans(UPPER, LOWER))
    for pattern, to in RULES + SPELLINGS:
        out = re.sub(pattern, to, out)
    return out.strip(" ")


def sql() -> str:
    """DuckDB SQL for :func:`scan` over ``documents``."""

    def form(x: str) -> str:
        q = lambda s: "'" + s.replace("'", "''") + "'"
        out = f"translate(translate(coalesce({x}, ''), {q(QUOTES)}, {q(PLAIN)}), '{UPPER}', '{LOWER}')"
        for pattern, to in RULES + SPELLINGS:
            out = f"regexp_replace({out}, {q(pattern)}, {q(to)}, 'g')"
        return f"trim({out}, ' ')"

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return f"""WITH known AS (SELECT md5({form('t')}) AS canonical_md5, min(l) AS license_id FROM (VALUES {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in known_texts())}) v(l, t) GROUP BY ALL),
notice AS (SELECT {form('t')} AS c, l FROM (VALUES {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in NOTICES.items())}) v(t, l)),
lines AS (SELECT rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM (SELECT rowid AS rid, text FROM (SELECT row_number() OVER () AS rowid, text FROM documents))),
hits AS (SELECT rid, list_sort(list(DISTINCT l)) AS ls FROM lines JOIN notice ON {form('line')} = c WHERE regexp_matches(line, '[Ll][Ii][Cc][Ee][Nn][CcSs]') GROUP BY rid),
docs AS (SELECT doc_id, rid, md5({form('text')}) AS canonical_md5 FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents))
SELECT doc_id, canonical_md5, license_id, coalesce(array_to_string(ls, ','), '') AS notices FROM docs LEFT JOIN known USING (canonical_md5) LEFT JOIN hits USING (rid)"""
