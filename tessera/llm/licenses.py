"""Licence scan: canonical digests of whole texts, hash-joined to the digests of known licences.

The canonical form lower-cases A-Z, drops copyright statements, turns runs of punctuation and white space into one space
and maps equivalent spellings to one.  The SHA-256 of the canonical whole text is joined to the registry's digests
(the registry is a constant of this module, so its broadcast has a fixed size).  Lines that are a known notice by
themselves are reported too, by the same digests.  DataFrame functions only.

Null and empty texts have the digest of the empty string and no licence.  Ties: a digest belongs to one licence.
Repeated rows each get their own row, with equal results; no rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the standard texts of licences
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."""
_ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

REGISTRY: list[tuple[str, str]] = [
    ("MIT", _MIT), ("MIT", f"MIT License\n{_MIT}"), ("MIT", f"The MIT License (MIT)\n{_MIT}"),
    ("BSD-2-Clause", "\n".join([_BSD_HEAD, _BSD_1, _BSD_2, _BSD_TAIL])), ("BSD-2-Clause", "\n".join(["BSD 2-Clause License", _BSD_HEAD, _BSD_1, _BSD_2, _BSD_TAIL])),
    ("BSD-3-Clause", "\n".join([_BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_TAIL])), ("BSD-3-Clause", "\n".join(["BSD 3-Clause License", _BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_TAIL])),
    ("ISC", f"{_ISC}\n{_ISC_TAIL}"), ("ISC", f"ISC License\n{_ISC}\n{_ISC_TAIL}"), ("0BSD", f"{_0BSD}\n{_ISC_TAIL}"), ("Zlib", _ZLIB), ("Apache-2.0", _APACHE), ("Unlicense", _UNLICENSE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Released under CC0 1.0."),
]

# fixed values: canonical digests of whole texts too long to hold here: Apache-2.0 with and without its appendix and without its last
# line, the Unlicense, and those that Debian distributes
WHOLE: list[tuple[str, str]] = [
    ("Apache-2.0", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("Apache-2.0", "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f"),
    ("Unlicense", "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2-only", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3-only", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0-only", "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6"),
    ("GPL-2.0-only", "e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1"),
    ("GPL-3.0-only", "0a85ab25a52f42a58c2cc4bf76b4808eb5d0505467f60ad614ac4d676f443478"),
    ("LGPL-2.0-only", "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d"),
    ("LGPL-2.1-only", "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "ad164cdd08feae08d94e21fea94df4f43d81588fbf2e9fe25da8af5330fc1d63"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# a statement of copyright, not running text that happens to begin a line with the word: a sign, a year or a place for
# one, or a holder that ends the line
COPYRIGHT = (
    r"(^|\n)[ \t#/*;-]*((portions )?copyright[ \t:,]*(by[ \t]+)?(\(c\)|©|&copy;|[\[{<]|(19|20)[0-9][0-9])[^\n]*|(\(c\)|©)[ \t,]*(copyright[ \t]*)?[\[{<]?((19|20)[0-9][0-9]|yyyy|year)[^\n]*|©[^\n]*"
    r"|(portions )?copyright[ \t:][^\n]*((19|20)[0-9][0-9]|authors|contributors|inc|llc|ltd|foundation|corporation|team|developers)[ \t.,\r]*(?=\n|$)|all rights reserved[ \t.,\r]*(?=\n|$))"
)
STATED = r"(^|\n)[ \t#/*;-]*(copyright|\(c\)|©|portions copyright|all rights reserved)[^\n]*"  # the SQL's; the two agree where no line of text begins with such a word
PUNCTUATION = r"([^a-z0-9\x{80}-\x{10FFFF}]|[‘’“”–—…])+"
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("organisation", "organization"), ("favour", "favor"), ("judgement", "judgment"), ("acknowledgement", "acknowledgment"),
    ("programme", "program"), ("fulfill", "fulfil"), ("whilst", "while"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("behaviour", "behavior"), ("authorised", "authorized"), ("https", "http"), ("copyright owner", "copyright holder"),
]
NOTICE = r"(?i)licen[sc]e|released under|public domain"


def canonical(text: Column) -> Column:
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    out = F.regexp_replace(out, COPYRIGHT, "$1")
    out = F.trim(F.regexp_replace(out, PUNCTUATION, " "))
    for said, meant in SPELLINGS:
        out = F.replace(out, F.lit(said), F.lit(meant))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def registry(spark: SparkSession) -> DataFrame:
    """digest, license_id of the known texts."""
    known = F.array(*(F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("known")) for i, t in REGISTRY))
    short = spark.range(1).select(F.inline(known)).select(digest(F.col("known")).alias("digest"), "license_id")
    whole = F.array(*(F.struct(F.lit(d).alias("digest"), F.lit(i).alias("license_id")) for i, d in WHOLE))
    return short.unionByName(spark.range(1).select(F.inline(whole))).dropDuplicates(["digest"])


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, digest, license_id (of the whole text, or null), n_notices, notices (sorted licence ids of single lines)."""
    known = registry(docs.sparkSession)
    by_digest = F.create_map(*(F.lit(v) for r in known.orderBy("digest").collect() for v in (r.digest, r.license_id)))
    text = F.col("text").cast("string")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: s.rlike(NOTICE))
    found = F.filter(F.transform(lines, lambda s: F.try_element_at(by_digest, digest(s))), lambda x: x.isNotNull())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", digest(F.col("text")).alias("digest"), found.alias("found"))
    joined = rows.join(F.broadcast(known), "digest", "left")
    return joined.select("doc_id", "digest", "license_id", F.size("found").cast("long").alias("n_notices"), F.array_join(F.sort_array(F.array_distinct("found")), ",").alias("notices"))


def oracle() -> str:
    """The same in DuckDB's SQL, without WHOLE and with STATED for COPYRIGHT."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def norm(x: str) -> str:
        out = f"translate(coalesce({x}, ''), '{UPPER}', '{LOWER}')"
        out = f"regexp_replace({out}, {q(STATED)}, '\\1', 'g')"
        out = f"trim(regexp_replace({out}, {q(PUNCTUATION)}, ' ', 'g'))"
        for a, b in SPELLINGS:
            out = f"replace({out}, {q(a)}, {q(b)})"
        return f"sha256({out})"

    values = ", ".join(f"({q(i)}, {q(t)})" for i, t in REGISTRY)
    return f"""
WITH known AS (SELECT DISTINCT {norm('t')} AS digest, i AS license_id FROM (VALUES {values}) AS v(i, t)),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
hits AS (SELECT l.doc_id, k.license_id FROM (SELECT doc_id, {norm('line')} AS digest FROM lines WHERE regexp_matches(line, {q(NOTICE)})) l JOIN known k USING (digest)),
per AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS s FROM hits GROUP BY doc_id),
whole AS (SELECT doc_id, {norm('text')} AS digest FROM documents)
SELECT w.doc_id, w.digest, k.license_id, coalesce(p.n, 0)::BIGINT AS n_notices, coalesce(p.s, '') AS notices
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN per p ON p.doc_id = w.doc_id
"""
