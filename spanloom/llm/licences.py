"""Licence scan by canonical digests, in DataFrame functions alone.

A text is brought to a canonical form (lower case, copyright lines dropped, all but letters and digits turned into single
blanks, equivalent spellings made one), and its SHA-256 is joined with the digests of known licences. The whole text,
each of its lines and each run of a few of its paragraphs are looked up, so a licence within a text is found, too. The table of known texts is a literal of fixed size, or one that the caller
gives, of a size to broadcast.

Results on odd input: a null text counts as empty; an empty canonical form has a digest and no licence; repeated
documents each get their row, with the lines of all rows of their id; a text of any length is looked up whole; one that is
known under two names has the smaller; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Equivalent spellings, the first form read as the second, both after punctuation has become blanks.
SPELLINGS = [
    ("licence", "license"), ("licencing", "licensing"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("organisation", "organization"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("favour", "favor"), ("fulfil ", "fulfill "), ("whilst", "while"), ("wilful", "willful"), ("acknowledgement", "acknowledgment"),
    ("copyright holder", "copyright owner"), ("initialise", "initialize"), ("merchantibility", "merchantability"), ("per cent", "percent"), ("https ", "http "), ("judgement", "judgment"),
]
# Header lines that say nothing of the licence, by patterns that both engines read alike, in lower case. A line that begins
# with the word copyright names a holder, unless a word follows with which running text goes on: such lines are shielded.
RUNNING = r"(^|\n)([^a-z0-9\n]*)copyright([ \t]+(?:holders?|owners?|notices?|laws?|statements?|licen[sc]es?|disclaimers?|interests?|and|or|in|is|as|to|of|are|under|management|treaty)\b)"
HOLDER = r"(^|\n)[^a-z0-9\n]*(?:copyright\b|\(c\)[^a-z0-9\n]*(?:copyright|[0-9]{4})|©)[^\n]*"
RESERVED = r"(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*(\n|\z)"
#: The number, letter or sign of a list's entry.
MARKER = r"(^|\n)[^a-z0-9\n]*(?:\(?[0-9]{1,2}[.)]|\(?[a-z]\)|\([ivx]{1,4}\))[ \t]+"
#: (what the text must hold, pattern, replacement): the steps in their order.
HEADERS = [("copyright", RUNNING, r"\1\2 kopyright\3"), ("(c)|copyright|©", HOLDER, r"\1"), ("kopyright", "kopyright", "copyright"), ("all rights reserved", RESERVED, r"\1\n"), ("", MARKER, r"\1")]
PARAGRAPHS = r"\n[ \t\r]*\n"

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_0BSD_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB_BODY = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

# The headings under which whole licences stand, the licences, and the statements that are known.
WHOLE = {
    "MIT": (["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License", "License: MIT", "License", "The MIT License (Expat)"], _MIT_BODY),
    "ISC": (["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "License: ISC", "License"], _ISC_BODY),
    "0BSD": (["BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "0BSD License", "License: 0BSD", "License"], _0BSD_BODY),
    "Zlib": (["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License", "zlib License (Zlib)", "License: Zlib", "License"], _ZLIB_BODY),
    "BSD-2-Clause": (["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "FreeBSD License", "The 2-Clause BSD License", "BSD License", "The BSD License", "License: BSD-2-Clause", "License"], _BSD_TERMS + _DISCLAIMER),
    "BSD-3-Clause": (["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "The 3-Clause BSD License", "BSD License", "The BSD License", "License: BSD-3-Clause", "License"], _BSD_TERMS + _BSD_NAMES + _DISCLAIMER),
}
STATEMENTS = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]


def _bodies() -> list[tuple[str, str]]:
    """Whole licences under each heading and under none, by lines and as one line, in which list markers stay."""
    return [(name, sep.join([*heading, *body.strip().split("\n")])) for name, (titles, body) in WHOLE.items() for heading in ([], *([t] for t in titles)) for sep in ("\n", " ")]


KNOWN = [*_bodies(), *STATEMENTS]
#: A line without this is none of the known ones that have such a word; ``_may_be_known`` sees to the others.
TRIGGER = "(?i)licen[sc]"


def canonical(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    for needs, pattern, to in HEADERS:
        step = F.regexp_replace(out, pattern, to.replace("\\n", "\n").replace("\\", "$"))
        held = [F.contains(out, F.lit(word)) for word in needs.split("|") if word]
        out = F.when(functools.reduce(Column.__or__, held), step).otherwise(out) if held else step
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    for form, to in SPELLINGS:
        out = F.replace(out, F.lit(form), F.lit(to))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark, texts: list[tuple[str, str]]) -> DataFrame:
    rows = spark.createDataFrame(texts, "licence string, __text string").select("licence", canonical(F.col("__text")).alias("form"))
    return rows.filter("form <> ''").groupBy("form").agg(F.min("licence").alias("licence")).select("form", F.sha2("form", 256).alias("digest"), "licence")


def _anchor(form: str) -> str | None:
    """The longest word of a canonical form that no respelling makes, so that lines of this form have it, too."""
    made = {piece for _, to in SPELLINGS for piece in to.split()}
    words = [word for word in form.split() if word.isascii() and not any(piece in word for piece in made)]
    return max(words, key=lambda word: (len(word), word), default=None)


def _may_be_known(forms: list[str]) -> Callable[[Column], Column]:
    """The filter of the texts and lines to look up: they have the trigger or the anchor of a form that lacks it."""
    anchors = {_anchor(form) for form in forms if "licens" not in form}
    if None in anchors:
        return lambda text: F.lit(True)
    return lambda text: text.rlike("|".join(["(?iu)" + TRIGGER.removeprefix("(?i)"), *sorted(anchors)]))


def _units(docs: DataFrame, looked_up: Callable[[Column], Column], lengths: list[int], most: int) -> DataFrame:
    """doc_id, is_line and form: the canonical forms of lines and of runs of one to most paragraphs that are as long as a
    known form. Documents are read once for both."""
    lines = F.transform(F.filter(F.split("text", "\n"), looked_up), canonical).alias("ls")
    paragraphs = docs.filter(looked_up(F.col("text"))).select("doc_id", lines, F.filter(F.transform(F.split("text", PARAGRAPHS), canonical), lambda p: p != "").alias("ps"))
    ends = lambda i: F.sequence(F.lit(1), F.least(F.lit(most), F.size("ps") - i))
    known_length = lambda form: F.length(form).isin(lengths)
    runs = F.flatten(F.transform("ps", lambda _, i: F.filter(F.transform(ends(i), lambda n: F.array_join(F.slice("ps", i + 1, n), " ")), known_length)))
    of = lambda forms, is_line: F.transform(forms, lambda form: F.struct(F.lit(is_line).alias("is_line"), form.alias("form")))
    return paragraphs.select("doc_id", F.inline(F.concat(of(F.filter("ls", known_length), True), of(runs, False))))


def scan(docs: DataFrame, texts: list[tuple[str, str]] = KNOWN, most_paragraphs: int = 8) -> DataFrame:
    """For each document its digest, the licence that its whole text is, and those that lines of it are and that runs of
    up to most_paragraphs paragraphs of it are.

    texts: identifiers and texts of the licences and statements to know.
    """
    forms = known(docs.sparkSession, texts)
    table = F.broadcast(forms.select("digest", "licence"))  # as many rows as texts has
    own_forms = [r.form for r in forms.collect()]
    looked_up = _may_be_known(own_forms)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    units = _units(own, looked_up, sorted({len(form) for form in own_forms}), most_paragraphs)
    line, block = F.when(F.col("is_line"), F.col("licence")), F.when(~F.col("is_line"), F.col("licence"))
    hits = units.select("doc_id", "is_line", F.sha2("form", 256).alias("digest")).join(table, "digest").groupBy("doc_id")
    hits = hits.agg(names(line).alias("line_licences"), F.count(line).alias("n_licence_lines"), names(block).alias("block_licences"))
    whole = own.select("doc_id", digest(F.col("text")).alias("digest")).join(table, "digest", "left")
    none = F.lit("")
    return whole.join(hits, "doc_id", "left").select(
        "doc_id", "digest", F.col("licence").alias("text_licence"), F.coalesce("line_licences", none).alias("line_licences"), F.coalesce("n_licence_lines", F.lit(0)).cast("long").alias("n_licence_lines"), F.coalesce("block_licences", none).alias("block_licences")
    )


def _sql(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for _, pattern, to in HEADERS:
        out = f"regexp_replace({out}, '{pattern}', " + " || ".join(["chr(10)" if part == "\\n" else f"'{part}'" for part in re.split(r"(\\n)", to) if part]) + ", 'g')"
    out = rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
    for form, to in SPELLINGS:
        out = f"replace({out}, '{form}', '{to}')"
    return f"trim({out})"


def sql() -> str:
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    return f"""
with known as (select digest, min(licence) licence from (select licence, sha256({_sql("t")}) digest from (values {rows}) v(licence, t)) group by digest),
named as (select doc_id, text from documents where regexp_matches(text, '{TRIGGER}')),
lines as (select doc_id, unnest(string_split(text, chr(10))) line from named),
paragraphs as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '{PARAGRAPHS}'), lambda p: {_sql("p")}), lambda p: p <> '') ps from named),
starts as (select doc_id, ps, unnest(range(1, len(ps) + 1)) i from paragraphs),
blocks as (select doc_id, array_to_string(ps[i:i + n - 1], ' ') form from (select *, unnest(range(1, least(8, len(ps) - i + 1) + 1)) n from starts)),
units as (select doc_id, sha256({_sql("line")}) digest, true is_line from lines union all select doc_id, sha256(form), false from blocks),
hits as (select doc_id, string_agg(distinct licence, ',' order by licence) filter (is_line) line_licences, count(*) filter (is_line) n_licence_lines,
  string_agg(distinct licence, ',' order by licence) filter (not is_line) block_licences from units join known using (digest) group by doc_id)
select d.doc_id, d.digest, k.licence text_licence, coalesce(h.line_licences, '') line_licences, coalesce(h.n_licence_lines, 0)::bigint n_licence_lines, coalesce(h.block_licences, '') block_licences
from (select doc_id, sha256({_sql("text")}) digest from documents) d left join known k using (digest) left join hits h using (doc_id)"""
