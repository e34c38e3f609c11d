"""Licence scans: canonical digests of entire texts, looked up among the digests of known licences.

Only DataFrame functions run: a text is put in lower case, lines that are copyright notices go, runs of anything but
letters and digits become one space, and equivalent spellings become one of them. Two texts of one licence that differ in
these alone have one digest. The digests of short licences are made from their texts by the same expressions; those of
long ones are listed.

A notice is a line of at most 200 characters that begins, after signs, with "copyright" (or "portions copyright"), the
copyright sign or "(c)" and a digit, or that says "all rights reserved"; lines end with line feeds or carriage returns. A line
in which a word of running text, such as "notice" or "holders", follows "copyright" is none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as the same word (word, what it becomes).
SPELLINGS = {
    "acknowledgment": "acknowledgement", "acknowledgments": "acknowledgements", "analog": "analogue", "analyze": "analyse", "artefact": "artifact",
    "artefacts": "artifacts", "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center", "colour": "color", "emphasised": "emphasized",
    "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http", "initialise": "initialize",
    "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licences": "licenses", "licenced": "licensed", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize",
    "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization",
    "whilst": "while", "wilful": "willful",
}
#: The same for words that a hyphen or space may part (after punctuation is gone).
PARTED = (("sub license", "sublicense"), ("sub licensed", "sublicensed"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"))

#: Words that follow "copyright" in running text, not in a notice.
RUNNING = (
    "act", "and", "claim", "in", "interest", "interests", "holder", "holders", "is", "law", "laws", "license", "licence", "notice", "notices", "on", "or", "owner", "owners",
    "permission", "protection", "s", "statement", "to", "treaty",
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_BSL = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT_0 = _MIT.split("\n\n")[0].replace(", subject to the following conditions:", ".") + "\n\n" + _MIT.split("\n\n")[2]
#: Texts of known licences (identifier, title, text); each is known with its title and without.
KNOWN = (
    ("MIT", "MIT License", _MIT),
    ("MIT-0", "MIT No Attribution", _MIT_0),
    ("ISC", "ISC License", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("0BSD", "Zero-Clause BSD", f"{_ISC_GRANT}.\n\n{_ISC_END}"),
    ("BSD-2-Clause", "BSD 2-Clause License", f"{_BSD_START}{_BSD_END}"),
    ("BSD-3-Clause", "BSD 3-Clause License", f"{_BSD_START}{_BSD_THIRD}{_BSD_END}"),
    ("Zlib", "zlib License", _ZLIB),
    ("Unlicense", "The Unlicense", _UNLICENSE),
    ("BSL-1.0", "", _BSL),
    ("Apache-2.0 notice", "", _APACHE_NOTICE),
)
#: Canonical SHA-256 of the whole texts of long licences, as their authors publish them.
DIGESTS = {
    "Apache-2.0": "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b",
    "Artistic-1.0-Perl": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",
    "GFDL-1.3": "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",
    "GPL-1.0": "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "9085ee283b8c84517846c5acafee37391c28bb825b7ecec4aaa90768f2f283b0",
    "LGPL-2.0": "289c8b47fa0ec7e5f22cd33d32feaa06f015b0f2fdb9ad916979b1011ca8c015",
    "LGPL-2.1": "5ddd6039d3b090c51328879800301dd19b1ad99e14d00f3c6f221ab45a32db57",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}


def canonical_sql(text: str, split: str, lambda_: str) -> str:
    """The canonical form as SQL; engines differ in how they split and name a lambda's argument."""
    case = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPELLINGS.items()) + " ELSE w END"
    notice = r"^[^\p{L}\p{N}©]*(((portions|parts) )?copyright([^\p{L}]|$)|©|\(c\) *[0-9]|all rights reserved[^\p{L}\p{N}]*$)"
    running = rf"^[^\p{{L}}\p{{N}}©]*copyright[ ,]+({'|'.join(RUNNING)})([^\p{{L}}]|$)"
    lines = f"{{lines}}(lower(coalesce({text}, '')), '[\\r\\n]+')"
    own = lambda_.format(lines, f"NOT (length(w) <= 200 AND {{matches}}(w, '{notice}') AND NOT {{matches}}(w, '{running}'))", kind="filter")
    replace_all = f"regexp_replace(array_join({own}, ' '), '[^\\p{{L}}\\p{{N}}]+', ' '{{g}})"
    words = split.format(f"trim({replace_all})")
    joined = f"concat(' ', array_join({lambda_.format(words, case, kind='transform')}, ' '), ' ')"
    for a, b in PARTED:
        joined = f"replace({joined}, ' {a} ', ' {b} ')"
    return f"trim({joined})"


def canonical(text: str) -> Column:
    """A text column's canonical form; null counts as empty."""
    sql = canonical_sql(f"`{text}`", "split({0}, ' ')", "{kind}({0}, w -> {1})")
    sql = sql.replace("{lines}", "split").replace("{matches}", "regexp_like").replace("{g}", "")
    return F.expr(sql.replace("\\", "\\\\"))


def oracle() -> str:
    """The query's result in DuckDB's SQL."""
    engine = {"{lines}": "string_split_regex", "{matches}": "regexp_matches", "{g}": ", 'g'", "array_join": "array_to_string"}
    form = lambda x: reduce(lambda q, e: q.replace(*e), engine.items(), canonical_sql(x, "string_split({0}, ' ')", "list_{kind}({0}, lambda w: {1})"))
    quote = lambda x: x.replace("'", "''")
    known = ", ".join(f"('{quote(a)}', '{quote(t)}')" for a, t in known_texts())
    listed = ", ".join(f"('{d}', '{a}')" for a, d in DIGESTS.items())
    return f"""
        WITH known AS (SELECT digest, min(licence) AS licence FROM (
          SELECT sha256({form('body')}) AS digest, licence FROM (VALUES {known}) k(licence, body) UNION ALL SELECT * FROM (VALUES {listed}) l) GROUP BY 1),
        docs AS (SELECT doc_id, sha256({form('text')}) AS digest FROM documents)
        SELECT doc_id, docs.digest AS digest, licence FROM docs LEFT JOIN known ON docs.digest = known.digest"""


def known_texts() -> list[tuple[str, str]]:
    """(identifier, text) of every known form."""
    return [(i, t) for i, title, body in KNOWN for t in dict.fromkeys((body, f"{title}\n\n{body}"))]


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(digest, licence)`` of known texts; of texts with one digest the first identifier counts."""
    known = spark.createDataFrame(known_texts() if texts is None else texts, "licence string, body string")
    known = known.select(F.sha2(canonical("body"), 256).alias("digest"), "licence")
    if texts is None:
        known = known.unionByName(spark.createDataFrame(list(DIGESTS.items()), "licence string, digest string"))
    return known.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(id, digest, licence)``: every row's canonical SHA-256, and which known licence its entire text is, or null.

    Null and empty texts, and those of signs alone, have the digest of the empty text and no licence. Rows with equal or null
    ids each get their row. An empty table gives none. The known digests are a fixed list, so they are broadcast.
    """
    docs = df.select(F.col(id_col).alias("id"), F.sha2(canonical(text_col), 256).alias("digest"))
    known = known_digests(df.sparkSession, texts)
    return docs.join(F.broadcast(known), "digest", "left").select("id", "digest", "licence")
