"""License scans by canonical digests.

A text is brought to a canonical form: letters lowered, everything but letters
and digits one blank, copyright lines and titles dropped, equivalent spellings
made equal. Its SHA-256 is looked up among the digests of known licences by a
hash join; lines are looked up likewise among known one-line notices. Only
built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Equivalent spellings, applied in this order to text of blanks, letters and digits.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("isation", "ization"),
    ("ised ", "ized "),
    ("ising ", "izing "),
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
    ("artefact", "artifact"),
    ("centre", "center"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("wilful", "willful"),
    ("whilst", "while"),
    ("programme", "program"),
    ("offence", "offense"),
    ("practise", "practice"),
    ("catalogue", "catalog"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("https ", "http "),
    ("copyright owner", "copyright holder"),
)
#: Titles and phrases that stand on a line of their own.
TITLES = (
    "all rights reserved",
    "mit license",
    "the mit license",
    "the mit license mit",
    "isc license",
    "the isc license",
    "bsd 2 clause license",
    "bsd 3 clause license",
    "zlib license",
    "boost software license version 1 0 august 17th 2003",
    "this font software is licensed under the sil open font license version 1 1",
    "this license is copied below and is also available with a faq at",
    "http scripts sil org ofl",
    "http openfontlicense org",
)
COPYRIGHT = "^(portions )?(copyright|c) (c )?(copyright )?([0-9]{4}|year|yyyy|by )|^with reserved font name "

#: Whole texts of known licences.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
}
#: One-line notices.
NOTICES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "SPDX-License-Identifier: MIT": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
    "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is in the public domain.": "public-domain",
}


#: Digests of the canonical whole texts of licences that are too long to be written out.
DIGESTS = {
    "Apache-2.0": "e6a451dce42ab8d4680fad924e570785da0232bff29f75285ec562220504b2da",
    "Apache-2.0 (without appendix)": "ea2c4965214d06d114add32f6df60ad2e10cbbf64c264f9aad0a590b274767de",
    "Artistic-1.0-Perl": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "BSD-3-Clause (University of California)": "e7cef7bf7fa468dad67b0345cdedf22643539a39a84e2e3b3b200a694a0eeda4",
    "CC-BY-SA-4.0": "f4c5ab78a7bff3def20db716ba8d3f3989eeb020c0cd83d1ba6f5c6dc13d70bb",
    "CC0-1.0": "3543dcc60a0402f26a4bfa9890d41c38c4cf6d3ca2012ae9953b6c9770a79449",
    "EPL-2.0": "47acf30645cf3f37c71a082c2ad8a65a7d52eb60b04a20d4fd360877b9b75240",
    "GFDL-1.2": "07179cfcd9a4a8c813d9d848fafbb889944994ba7e14682cccfdfb0258ab358b",
    "GFDL-1.3": "b80512237f0c36267b1d3cc7c4561b7b488d75e4ec311c0c3846662fa876b3c7",
    "GPL-1.0": "07e35989b8c661d8800dfc45970de9dcd52e89926237a84d13f70bc25b2aef06",
    "GPL-2.0": "0ce2ec434621e8b524eb73b37b809db0c85d81170422c600d5e992895bdb62a4",
    "GPL-3.0": "bde7dce1462614d86bf512aefc2f65abb0bd1a13e740e5a9bd37f40e76c62500",
    "LGPL-2.0": "4e4c201e61b07a193d1b2f635eee11a25cf8e86f9013649686a32c34ba49203e",
    "LGPL-2.1": "ff1cc550dc018c7f5876b89f0ec29a2135a96d39920d20e68e45087dbfb8bfce",
    "LGPL-3.0": "256195cdc3866b92e131c85ab83be64a70cdb25bbef30d9ba20f9e203a0898c0",
    "MPL-1.1": "186489fb387b90436e4cd81466b39e9a16761884816412695a1e4ba709f61573",
    "MPL-2.0": "b58a5e7569edec43100cb87489425cf6cc7f001aad18aad7de2f6327e043bad1",
    "OFL-1.1": "96dd62591f03714740da8e47f6a6666cf4643fd85e0292d64d34a6f748513722",
    "Unicode-3.0": "41c0010abe46dc83093909ac8727e1ebd332623a1ede4376bdcd0323807744f5",
}


def canonical_line(line: Column) -> Column:
    """Lower case, blanks for all but letters and digits, equal spellings; '' for dropped lines."""
    plain = F.concat(F.btrim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for spelling, standard in SPELLINGS:
        plain = F.replace(plain, F.lit(spelling), F.lit(standard))
    return F.rtrim(plain)


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text that are not empty, a title or a copyright line."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line)
    return F.filter(lines, lambda x: (x != "") & ~x.isin(*TITLES) & ~x.rlike(COPYRIGHT))


def known_digests(docs: DataFrame, texts: dict[str, str], digests: dict[str, str] | None = None) -> DataFrame:
    """canonical_sha256, license of known texts and digests; the table is as short as the mappings."""
    known = docs.sparkSession.createDataFrame([(v, k) for k, v in texts.items()], "text string, license string")
    lines = canonical_lines(F.col("text"))
    found = known.select(F.sha2(F.concat_ws(" ", lines), 256).alias("canonical_sha256"), "license")
    if digests:
        found = found.union(docs.sparkSession.createDataFrame([(v, k) for k, v in digests.items()], found.schema))
    return found.dropDuplicates(["canonical_sha256"])


def scan_licenses(docs: DataFrame, texts: dict[str, str] = TEXTS, notices: dict[str, str] = NOTICES, digests_known: dict[str, str] = DIGESTS) -> DataFrame:
    """doc_id, canonical_sha256, license_id, n_notices and notice_ids of each document.

    license_id: the known licence that the entire text is, else null.
    notice_ids: the licences of lines that are known notices, distinct, sorted
    and joined by commas ('' for none). Null and empty texts have the digest of
    the empty string, which is no licence. Repeated rows stay; an empty table
    gives no rows.
    """
    rows = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    # notices are a literal map, as long as the mapping: a lookup without a shuffle
    digests = {}
    for r in known_digests(docs, {f"{i}": k for i, k in enumerate(notices)}).collect():
        digests[r.canonical_sha256] = list(notices.values())[int(r.license)]
    longest = max((len(k) for k in notices), default=0) + 40
    lookup = F.create_map(*[F.lit(x) for pair in digests.items() for x in pair]) if digests else F.create_map().cast("map<string,string>")
    short = F.filter("lines", lambda x: F.length(x) <= longest)
    found = F.array_compact(F.transform(short, lambda x: F.try_element_at(lookup, F.sha2(x, 256))))
    scanned = rows.select("doc_id", F.sha2(F.concat_ws(" ", "lines"), 256).alias("canonical_sha256"), found.alias("found"))
    known = known_digests(docs, texts, digests_known).withColumnRenamed("license", "license_id")
    return scanned.join(F.broadcast(known), "canonical_sha256", "left").select(
        "doc_id",
        "canonical_sha256",
        "license_id",
        F.size("found").cast("long").alias("n_notices"),
        F.concat_ws(",", F.array_sort(F.array_distinct("found"))).alias("notice_ids"),
    )


def scan_sql(table: str, texts: dict[str, str] = TEXTS, notices: dict[str, str] = NOTICES, digests_known: dict[str, str] = DIGESTS) -> str:
    """DuckDB SQL for the rows of :func:`scan_licenses`."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    line = "trim(regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ') || ' '"
    for spelling, standard in SPELLINGS:
        line = f"replace({line}, {quote(spelling)}, {quote(standard)})"
    lines = f"[y FOR y IN [rtrim({line}, ' ') FOR x IN string_split(coalesce(text, ''), chr(10))] IF y <> '' AND y NOT IN ({', '.join(map(quote, TITLES))}) AND NOT regexp_matches(y, {quote(COPYRIGHT)})]"
    values = lambda d, known: ", ".join(f"({quote(k)}, {quote(v)})" for k, v in (((v, k) for k, v in d.items()) if known else d.items()))
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {lines} AS lines FROM {table}),
t AS (SELECT sha256(array_to_string({lines}, ' ')) AS h, license FROM (VALUES {values(texts, True)}) v(text, license) UNION ALL VALUES {values(digests_known, True)}),
n AS (SELECT sha256(array_to_string({lines}, ' ')) AS h, license FROM (VALUES {values(notices, False)}) v(text, license)),
f AS (SELECT rid, count(*) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS notice_ids
      FROM (SELECT rid, unnest(lines) AS line FROM d) JOIN n ON sha256(line) = n.h GROUP BY rid)
SELECT d.doc_id, sha256(array_to_string(d.lines, ' ')) AS canonical_sha256, t.license AS license_id,
       coalesce(f.n_notices, 0)::BIGINT AS n_notices, coalesce(f.notice_ids, '') AS notice_ids
FROM d LEFT JOIN t ON sha256(array_to_string(d.lines, ' ')) = t.h LEFT JOIN f USING (rid)
"""
