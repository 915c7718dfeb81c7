"""Operator 5: licence scans by canonical digests, in DataFrame functions only.

A text is made canonical (lower case, no copyright lines, one spelling of words that have two, letters and digits alone between
single spaces) and its digest is joined to the digests of known licences.  Entire texts are matched: the whole document; each of its lines as a text
of its own, which finds notices; and, for known texts of ``RUN`` words or more, each run of as many words that begins with the text's first
``ANCHOR`` words, which finds a licence of several lines, however wrapped, in a longer document.  A licence's name inside prose is no match.

Scale: one scan, and one shuffle of row numbers, identifiers and matches, not of texts; the catalogue has a row for each known text.  Only documents
and lines that hold a word which every known text holds are made canonical.

Edge cases: a null or empty text has no match; repeated rows each get a row; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import empty_text

# Words that have two spellings, each with the one that counts.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "https": "http",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "non commercial": "noncommercial",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "per cent": "percent",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}
COPYRIGHT_LINE = r"^[^a-z0-9]*(copyright|\(c\)|©)[^a-z0-9].*$"
HINT = "licen|warrant"
ANCHOR, RUN = 8, 30

# Known licence texts and notices, by SPDX identifier.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THREE = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("ISC", "Licensed under the ISC License."),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THREE + _BSD_TAIL),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)


def canonical_text(text: str) -> str:
    """The canonical form in plain Python, for the catalogue."""
    lines = [x for x in text.lower().split("\n") if not re.search(COPYRIGHT_LINE, x)]
    out = f" {re.sub('[^a-z0-9]+', ' ', ' '.join(lines)).strip()} "
    for old, new in SPELLINGS.items():
        out = out.replace(f" {old} ", f" {new} ")
    return out.strip()


# Whole licence texts and the terms alone, as Debian installs them: SPDX identifier, words of the canonical form, the first eight, SHA-256.
FULL = (
    ("Apache-2.0", 1571, "apache license version 2 0 january 2004 http", "ebc600199db9838b4fc2d5288a12598c2702142177a89b3443f5cc87b137d94b"),
    ("Apache-2.0", 1400, "apache license version 2 0 january 2004 http", "98378616989e23431b15181388a001fdeac0999db741918e302c5162392bcfbd"),
    ("Artistic-1.0-Perl", 954, "the artistic license preamble the intent of this", "f273930184a9b8de03336e9ae5d74bef291165524044f55455ee5117f494811a"),
    ("CC0-1.0", 1088, "creative commons legal code cc0 1 0 universal", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", 3305, "gnu free documentation license version 1 2 november", "37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f"),
    ("GFDL-1.3", 3710, "gnu free documentation license version 1 3 3", "7befa86e5ee53162018d597eee81db6c727f3e64fab4641af93e19deab1807b4"),
    ("GPL-1.0", 2055, "gnu general public license version 1 february 1989", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-1.0", 1641, "gnu general public license version 1 february 1989", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", 2965, "gnu general public license version 2 june 1991", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-2.0", 2494, "gnu general public license version 2 june 1991", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999"),
    ("GPL-3.0", 5650, "gnu general public license version 3 29 june", "59a779feaae4de539260be3c8adb19c287a771586d211e12d93932777da37349"),
    ("GPL-3.0", 5207, "gnu general public license version 3 29 june", "f7bb29d9a31c3a1a68ccff0d8d9053350dc0b10b52b62d46d0f2e36a41e32975"),
    ("LGPL-2.0", 4163, "gnu library general public license version 2 june", "96685b4d8003c3671feddcde58622afa814a3ac15dcc419f38b388aff5e16d1d"),
    ("LGPL-2.0", 3840, "gnu library general public license version 2 june", "a07313094d4e63b099417491ebc80c933bf85c36d5afddbf13be9a11457c8513"),
    ("LGPL-2.1", 4364, "gnu lesser general public license version 2 1", "22bd2802b7b313faf9750f494c8f07c9eaa0e00ba5b9f7a300e8fa36cfd1319e"),
    ("LGPL-2.1", 4040, "gnu lesser general public license version 2 1", "bfe8e5dc6cef43d0c4777d9c1891f596159cda682ef40545ad2105f66b9746f1"),
    ("LGPL-3.0", 1231, "gnu lesser general public license version 3 29", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 3760, "mozilla public license version 1 1 1 definitions", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", 2414, "mozilla public license version 2 0 1 definitions", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
)


def catalogue(more: dict[str, str] | None = None) -> list[tuple[str, str, int, str]]:
    """(digest, SPDX identifier, words, anchor) of each known text, and of ``more`` (identifier -> text)."""
    found = {digest: (digest, name, words, anchor) for name, words, anchor, digest in FULL}
    for name, text in (*KNOWN, *(more or {}).items()):
        words = canonical_text(text).split(" ")
        digest = hashlib.sha256(" ".join(words).encode()).hexdigest()
        found.setdefault(digest, (digest, name, len(words), " ".join(words[:ANCHOR])))
    return list(found.values())


def canonical(lowered: Column) -> Column:
    """The canonical form of a lower-case text."""
    lines = F.filter(F.split(lowered, "\n"), lambda x: ~x.rlike(COPYRIGHT_LINE))
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.array_join(lines, " "), "[^a-z0-9]+", " ")), F.lit(" "))
    for old, new in SPELLINGS.items():
        out = F.call_function("replace", out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(out)


def license_scan(docs: DataFrame, more: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, n_notices, notices, contained): a row for each document.

    ``license`` is set if the whole document is a known text; ``n_notices`` counts the lines that are, ``notices`` lists their
    identifiers, and ``contained`` those of texts of ``RUN`` words or more that the document holds; both sorted, each once.
    """
    known = catalogue(more)
    begins: dict[str, list[int]] = {}
    for _, _, words, anchor in known:
        if words >= RUN and words not in begins.setdefault(anchor, []):
            begins[anchor].append(words)
    lengths = F.create_map(*[x for anchor, n in begins.items() for x in (F.lit(anchor), F.array(*map(F.lit, n)))])
    lowered = F.lower(empty_text())
    text = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), lowered.alias("lowered")).withColumn("whole", F.when(F.col("lowered").rlike(HINT), canonical(F.col("lowered"))))
    lines = F.filter(F.split("lowered", "\n"), lambda x: x.rlike(HINT))
    words = F.when(F.col("whole").rlike("|".join(begins)), F.split("whole", " "))
    ahead = lambda i, n: F.array_join(F.slice(F.col("words"), i, n), " ")
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size("words") - ANCHOR + 1, F.lit(1))), lambda i: F.map_contains_key(lengths, ahead(i, ANCHOR)))
    runs = F.flatten(F.transform(places, lambda i: F.transform(F.element_at(lengths, ahead(i, ANCHOR)), lambda n: F.sha2(ahead(i, n), 256))))
    kinds = {"whole": F.array(F.sha2("whole", 256)), "line": F.when(F.col("whole").isNotNull(), F.transform(lines, lambda x: F.sha2(canonical(x), 256))), "run": F.when(F.col("words").isNotNull(), runs)}
    none = F.array().cast("array<string>")

    def marked(kind: str) -> Column:
        return F.transform(F.coalesce(kinds[kind], none), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("digest")))

    tried = [marked(kind) for kind in kinds]
    each = text.withColumn("words", words).select("row", "doc_id", F.explode_outer(F.concat(*tried)).alias("t")).select("row", "doc_id", "t.*")
    names = docs.sparkSession.createDataFrame([(d, n) for d, n, _, _ in known], "digest string, name string")
    of_kind = lambda kind: F.when(F.col("kind") == kind, F.col("name"))
    listed = lambda kind: F.array_join(F.array_sort(F.collect_set(of_kind(kind))), ",")
    found = each.join(names, "digest", "left").groupBy("row", "doc_id")
    out = found.agg(F.max(of_kind("whole")).alias("license"), F.count(of_kind("line")).alias("n_notices"), listed("line").alias("notices"), listed("run").alias("contained"))
    return out.drop("row")


def license_sql() -> str:
    """The same in DuckDB's SQL."""

    def form(text: str) -> str:
        out = f"' ' || trim(regexp_replace(array_to_string(list_filter(string_split({text}, chr(10)), lambda y: NOT regexp_matches(y, '{COPYRIGHT_LINE}')), ' '), '[^a-z0-9]+', ' ', 'g')) || ' '"
        for old, new in SPELLINGS.items():
            out = f"replace({out}, ' {old} ', ' {new} ')"
        return f"trim({out})"

    known = catalogue()
    values = ", ".join(f"('{d}', '{name}', {words}, '{anchor}')" for d, name, words, anchor in known)
    anchors = "|".join(sorted({anchor for _, _, words, anchor in known if words >= RUN}))
    return f"""
WITH known(digest, name, words, anchor) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS n, doc_id, lower(coalesce(text, '')) AS t FROM documents),
hinted AS (SELECT n, t, {form("t")} AS c FROM d WHERE regexp_matches(t, '{HINT}')),
whole AS (SELECT n, sha256(c) AS digest FROM hinted),
line AS (SELECT n, sha256({form("x")}) AS digest FROM (SELECT n, unnest(string_split(t, chr(10))) AS x FROM hinted) WHERE regexp_matches(x, '{HINT}')),
notice AS (SELECT n, count(*) AS c, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM line JOIN known USING (digest) GROUP BY n),
place AS (SELECT n, w, unnest(generate_series(1, len(w) - {ANCHOR} + 1)) AS i FROM (SELECT n, string_split(c, ' ') AS w FROM hinted WHERE regexp_matches(c, '{anchors}'))),
run AS (SELECT p.n, sha256(array_to_string(p.w[p.i : p.i + k.words - 1], ' ')) AS digest FROM place p
  JOIN (SELECT DISTINCT anchor, words FROM known WHERE words >= {RUN}) k ON array_to_string(p.w[p.i : p.i + {ANCHOR - 1}], ' ') = k.anchor),
held AS (SELECT n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM run JOIN known USING (digest) GROUP BY n)
SELECT doc_id, k.name AS license, coalesce(notice.c, 0) AS n_notices, coalesce(notice.names, '') AS notices, coalesce(held.names, '') AS contained
FROM d LEFT JOIN whole USING (n) LEFT JOIN known k USING (digest) LEFT JOIN notice USING (n) LEFT JOIN held USING (n)
"""
