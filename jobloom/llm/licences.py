"""Licence scan by canonical digest lookup (DataFrame functions only).

A text is made canonical: lower case, copyright lines out, punctuation to blanks, equivalent
spellings to one, blanks to one.  Its SHA-256 digest is hash-joined to the digests of known
licence texts, themselves made canonical by the same expressions, so that entire texts that
differ in nothing else are equal.  Lines that are known notices as a whole are listed too.

Defined cases: a null text counts as empty; an empty or blank text, or one of copyright lines
alone, has the digest of the empty text and no licence; repeated rows get the same result; two
licence texts with one canonical form are named by the smaller id; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, saved

# fixed values: a line that starts (after signs only) like this is a copyright line; a line of a wrapped
# licence text may start with the word too ("copyright holders be liable"), so a mark or a year must follow
COPYRIGHT_LINE = (r"(^|\n)[^\p{L}\p{N}\n]*(copyright[ \t]*(\(c\)|©)|copyright[^\n]*(19|20)[0-9][0-9]"
                  r"|\(c\)[ \t]*(19|20)[0-9][0-9]|c\)[ \t]*(19|20)[0-9][0-9]|©)[^\n]*")
# fixed values: spellings that licence matching guidelines take as equal, in canonical form
SPELLINGS = [
    (r"licence", "license"),
    (r"\bsub license", "sublicense"),
    (r"\bnon commercial", "noncommercial"),
    (r"\bcopyright (holder|owner)", "copyright holder"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bfavour", "favor"),
    (r"\bwhil(st|e)\b", "while"),
    (r"\bpercent\b", "per cent"),
    (r"\bhttps?\b", "https"),
]
SIGNS = r"[^\p{L}\p{N}\n]+"
BLANKS = r"\s+"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest
in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of
our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future
rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
def _full_texts() -> list[tuple[str, str]]:
    """The files of licence_texts, named by their identifiers; without copyright lines, which the canonical form leaves out."""
    return [(p.stem, re.sub(r"(?im)^[\W_]*copyright[ \t]*(\(c\)|©).*$", "", p.read_text("utf-8")))
            for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]


# fixed values: public licence texts and short notices, named by their usual identifiers
TEXTS = [
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC),
    ("BSD-2-Clause", BSD_HEAD + BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_HEAD + BSD_TAIL),
    ("BSD-3-Clause", BSD_HEAD + BSD_THIRD + BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_HEAD + BSD_THIRD + BSD_TAIL),
    ("Zlib", ZLIB), ("Zlib", "zlib License\n\n" + ZLIB), ("Unlicense", UNLICENSE), ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "All rights reserved."),
    *_full_texts(),
]


def canonical_lines(text: Column) -> Column:
    """Lower case, copyright lines out, signs to blanks, spellings to one; line ends stay."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "$1")
    out = F.regexp_replace(out, SIGNS, " ")
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return out


def canonical(text: Column) -> Column:
    return F.trim(F.regexp_replace(canonical_lines(text), BLANKS, " "))


def known(spark, texts: DataFrame | None = None) -> DataFrame:
    """(license_id, digest, canonical) of the known texts: one row for each of the constants above and
    of ``texts`` (license_id, text); rows of it with a null or blank text name nothing."""
    rows = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in TEXTS])
    table = spark.range(1).select(F.inline(rows))
    if texts is not None:
        table = table.union(texts.where("license_id is not null").select("license_id", "text"))
    return (table.withColumn("canonical", canonical(F.col("text"))).where("canonical <> ''")
            .groupBy("canonical").agg(F.min("license_id").alias("license_id"))
            .select("license_id", F.sha2("canonical", 256).alias("digest"), "canonical"))


def scan(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, digest (SHA-256 of the canonical text), license_id (null if the
    entire text is no known licence) and notices (licences of the lines that are known notices as a
    whole, sorted, comma-joined).  ``texts`` (license_id, text) are known beside the constants; the
    short ones among them are notices too."""
    table = known(docs.sparkSession, texts)
    if texts is not None:
        table = saved(table, "licence-texts")
    digests = table.select("digest", "license_id")
    digests = F.broadcast(digests) if texts is None else checked_broadcast(digests)
    short = table.where(F.length("canonical") < 120).agg(F.map_from_entries(F.collect_list(F.struct("canonical", "license_id"))).alias("notice_of"))
    lines = F.filter(F.transform(F.split("lines", "\n"), lambda x: F.try_element_at("notice_of", F.trim(x))), lambda x: x.isNotNull())
    found = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines")).crossJoin(F.broadcast(short)).select(
        "doc_id", F.sha2(F.trim(F.regexp_replace("lines", BLANKS, " ")), 256).alias("digest"),
        F.array_join(F.array_sort(F.array_distinct(lines)), ",").alias("notices"))
    return found.join(digests, "digest", "left").select("doc_id", "digest", "license_id", "notices")


def _sql_text(expr: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(lower(coalesce({expr}, '')), {quote(COPYRIGHT_LINE)}, '\\1', 'g')"
    out = f"regexp_replace({out}, {quote(SIGNS)}, ' ', 'g')"
    for pattern, to in SPELLINGS:
        out = f"regexp_replace({out}, {quote(pattern)}, '{to}', 'g')"
    return out


def oracle() -> str:
    """The same question in DuckDB SQL over the table documents."""
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in TEXTS)
    return f"""
with texts(license_id, text) as (values {values}),
table_ as (select min(license_id) as license_id, canonical from (
    select license_id, trim(regexp_replace({_sql_text('text')}, '\\s+', ' ', 'g')) as canonical from texts) group by canonical),
docs as (select doc_id, {_sql_text('text')} as lines, row_number() over () as rn from documents),
line_ as (select rn, trim(unnest(string_split(lines, chr(10)))) as line from docs),
notice as (select rn, string_agg(distinct license_id, ',' order by license_id) as notices
    from line_ join table_ on line = canonical where length(canonical) < 120 group by rn)
select doc_id, digest, license_id, coalesce(notices, '') as notices
from (select doc_id, rn, sha256(trim(regexp_replace(lines, '\\s+', ' ', 'g'))) as digest from docs) d
left join (select license_id, sha256(canonical) as digest from table_) t using (digest)
left join notice using (rn)"""
