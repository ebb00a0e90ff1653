"""Licence scan by canonical digest: texts are normalised, hashed and joined to the digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that count as equal, the first for the second (fixed values).
SPELLINGS = (
    ("acknowledgment", "acknowledgement"), ("analog", "analogue"), ("analyze", "analyse"), ("artifact", "artefact"), ("authorization", "authorisation"),
    ("authorized", "authorised"), ("center", "centre"), ("customization", "customisation"), ("favor", "favour"), ("favorite", "favourite"),
    ("fulfill", "fulfil"), ("fulfillment", "fulfilment"), ("initialize", "initialise"), ("judgment", "judgement"), ("labeled", "labelled"),
    ("license", "licence"), ("licensed", "licenced"), ("licenses", "licences"), ("merchantability", "merchantibility"), ("modeling", "modelling"), ("noncommercial", "non commercial"),
    ("organization", "organisation"), ("organizations", "organisations"), ("percent", "per cent"), ("program", "programme"), ("realize", "realise"), ("recognize", "recognise"),
    ("sublicense", "sub license"), ("sublicense", "sublicence"), ("sublicense", "sub licence"), ("utilization", "utilisation"), ("while", "whilst"), ("willful", "wilful"),
)
#: A line with a copyright mark and a year, one that begins with "©" or with "copyright" and a mark, a colon or "by", and
#: "all rights reserved" at the beginning of a line; each with the line feed before it. Lines of licences that begin with
#: "copyright notice" or "(c) you must" stay.
COPYRIGHT_LINE = (
    r"(^|\n)([^\n]*(copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*|[^\p{L}\p{N}\n©]*(copyright[ \t]*(\(c\)|©|&copy;|:|by[ \t])|©|&copy;)[^\n]*"
    r"|[^\p{L}\p{N}\n]*all[ \t]+rights[ \t]+reserved)"
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
""" + _ISC.split("\n")[1]
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO."""
_MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."


def _gnu(name: str, version: str, what: str = "This program") -> str:
    """The notice that files under a licence of this family have."""
    return f"""{what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
{what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.
You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""


#: Known licences and notices: identifier and whole text (fixed values).
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("MIT-0", _MIT.replace(", subject to the following conditions:", ".").replace("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n", "")),
    ("0BSD", _0BSD),
    ("BSD-2-Clause", _BSD_HEAD + "\n" + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + "\n" + _BSD_TAIL),
    ("BSD-3-Clause", "\n".join([_BSD_HEAD, _BSD_3, _BSD_TAIL])),
    ("BSD-3-Clause", "\n".join(["BSD 3-Clause License", _BSD_HEAD, _BSD_3, _BSD_TAIL])),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <https://unlicense.org>"),
    ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <http://unlicense.org/>"),
    ("BSL-1.0", _BOOST),
    ("WTFPL", _WTFPL),
    ("MPL-2.0", _MPL_NOTICE),
    ("GPL-2.0-or-later", _gnu("GNU General Public License", "2")),
    ("GPL-3.0-or-later", _gnu("GNU General Public License", "3")),
    ("LGPL-3.0-or-later", _gnu("GNU Lesser General Public License", "3")),
    ("LGPL-2.1-or-later", _gnu("GNU Lesser General Public License", "2.1", "This library")),
    ("AGPL-3.0-or-later", _gnu("GNU Affero General Public License", "3")),
    ("Apache-2.0", _APACHE_NOTICE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)


def canonical(text: Column) -> Column:
    """Lower case; copyright lines go (``COPYRIGHT_LINE``); all but letters and digits becomes one blank; spellings are levelled.

    Each word has two blanks of its own while spellings are levelled, so neighbours are both found.
    """
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "\n")
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for ours, other in SPELLINGS:
        t = F.replace(t, F.lit(f" {other.replace(' ', '  ')} "), F.lit(f" {ours} "))
    return F.trim(F.regexp_replace(t, " +", " "))


def known_digests(spark, known=KNOWN) -> DataFrame:
    """``digest`` and ``license``, one row a digest, of identifiers and whole texts: pairs, or a table ``license``, ``text``."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "license string, text string")
    digest = F.sha2(canonical(F.col("text")).cast("binary"), 256)
    return rows.select(digest.alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, text: str = "text", known=KNOWN, digests: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``digest`` (of the canonical text), ``license`` (of the whole text, or null) and ``line_licenses``.

    ``line_licenses``: identifiers of lines that are a known text in full, sorted and joined by commas; empty if
    none. Null and empty texts have the digest of the empty text and no licence. Repeated rows stay. Columns of the
    input with these names are replaced. ``digests`` (``digest``, ``license``) stands in for ``known``; it is looked up
    in lines only for texts of one line, as a line holds no other.
    """
    digest = lambda c: F.sha2(canonical(c).cast("binary"), 256)
    table = known_digests(docs.sparkSession, known) if digests is None else digests.select("digest", "license").groupBy("digest").agg(F.min("license").alias("license"))
    pairs = [F.lit(v) for r in table.collect() for v in (r["digest"], r["license"])]  # one pair for each known text
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    names = F.array_compact(F.transform(lines, lambda x: F.try_element_at(F.create_map(*pairs), digest(x)))) if pairs else F.array().cast("array<string>")
    own = docs.drop("digest", "license", "line_licenses")
    out = own.withColumn("digest", digest(own[text])).withColumn("line_licenses", F.array_join(F.sort_array(F.array_distinct(names)), ","))
    return out.join(table, "digest", "left")


def op6_canonical_digest(docs: DataFrame) -> DataFrame:
    """Per document the digest of its canonical text, the licence that the text is, and those of its lines."""
    return scan_licenses(docs.select("doc_id", "text")).select("doc_id", "digest", "license", "line_licenses")


def oracle() -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def canonical_sql(t: str) -> str:
        t = f"regexp_replace(lower(coalesce({t}, '')), {quote(COPYRIGHT_LINE)}, chr(10), 'g')"
        t = f"' ' || regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' '"
        for ours, other in SPELLINGS:
            t = f"replace({t}, ' {other.replace(' ', '  ')} ', ' {ours} ')"
        return f"sha256(trim(regexp_replace({t}, ' +', ' ', 'g')))"

    rows = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in KNOWN)
    return f"""
with known as (select {canonical_sql("t")} as digest, min(license) as license from (values {rows}) as v(license, t) group by 1),
lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
found as (select l.doc_id, string_agg(distinct k.license, ',' order by k.license) as line_licenses from lines l join known k on {canonical_sql("l.line")} = k.digest where regexp_matches(l.line, '[\\p{{L}}\\p{{N}}]') group by 1),
whole as (select doc_id, {canonical_sql("text")} as digest from documents)
select w.doc_id, w.digest, k.license, coalesce(f.line_licenses, '') as line_licenses
from whole w left join known k using (digest) left join found f using (doc_id)
"""
