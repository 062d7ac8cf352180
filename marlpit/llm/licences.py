"""Licence scans by canonical digest.

A text is put into canonical form (lower case; copyright and all-rights lines dropped; punctuation and white space made
single spaces; equivalent spellings replaced) and its digest is joined with those of known licences, so that only
an entire text that says the same as a licence matches. A text without a match is looked up once more in a looser form,
which also drops copyright lines without a year or sign and the numbers and letters of lists; ``canonical_digest`` is
of the first form, as in the SQL.

The catalogue is ``KNOWN`` and the full texts in ``licence_texts``; ``scan`` takes any other table too.

Defined results: a null text has a null digest and no licence; a text without letters and digits has the digest of the
empty string and no licence; a null id is carried; repeated rows are looked up each for itself; the known licences have
distinct digests, so there are no ties; a very long text is hashed whole, in its row; other columns are dropped; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import reduce
from importlib.resources import files
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings that count as equal, as (spelling, canonical spelling).
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
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
    "maximise": "maximize",
    "merchantability": "merchantability",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "owner": "holder",
    "owners": "holders",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_HEAD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

# Known licences by SPDX identifier, as (titles that may stand before the text, the text).
KNOWN: dict[str, tuple[tuple[str, ...], str]] = {
    "MIT": (("MIT License", "The MIT License", "The MIT License (MIT)"), _MIT),
    "BSD-2-Clause": (("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"), _BSD_HEAD + _BSD_TAIL),
    "BSD-3-Clause": (("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"), _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    "ISC": (("ISC License", "The ISC License"), _ISC_HEAD + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL),
    "0BSD": (("BSD Zero Clause License", "Zero-Clause BSD"), _ISC_HEAD + ".\n" + _ISC_TAIL),
    "Zlib": (
        ("zlib License", "The zlib/libpng License"),
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
    "BSL-1.0": (
        ("Boost Software License - Version 1.0 - August 17th, 2003",),
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "Unlicense": (
        ("The Unlicense", "Unlicense"),
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <http://unlicense.org/>""",
    ),
    "Apache-2.0-notice": (
        (),
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    "Apache-2.0-line": ((), "Licensed under the Apache License, Version 2.0."),
}

_COPYRIGHT = r"(?m)^[^a-z0-9\n]*(portions )?(copyright[^\n]*(\(c\)|©|[0-9]{4})|\(c\)|©|all rights reserved)[^\n]*$"
_OTHERS = r"[^\p{L}\p{N}]+"
# The looser form: any line that starts with "copyright", unless a licence's own wording goes on there in a new line; a
# line that starts with "(c)" only with a year, as that may be an item of a list.
_NOTICE = (
    r"(?m)^[^a-z0-9\n]*(portions )?(copyright\b(?![ \t]*$)"
    r"(?![^a-z0-9\n]+(and|are|disclaimers?|doctrines|holders?|if|in|interests?|is|laws?|licen[cs]es?|notices?|of|on|or|owners?|ownership|permissions?|resulting|rights?|statements?|treaty|to|the (above|library|program|software|work))\b)"
    r"|copyright[^\n]*(©|(19|20)[0-9]{2})|copyright[^a-z0-9\n]*\(c\)|\(c\)[^\n]*(19|20)[0-9]{2}|©|all rights reserved)[^\n]*$"
)
_MARKER = r"(?<![^ \t\r\n(])\(?([0-9]{1,2}|[a-z]|[ivx]{2,4})[.)](?=[ \t\r\n]|$)"
# Where the licences of the Free Software Foundation differ between printings only.
_ADDRESS = re.compile(r"51\s+Franklin\s+St(?:reet)?,\s+Fifth\s+Floor,\s+Boston,\s+MA\s+02110-1301,?\s+USA")
_ADDRESSES = ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA")
_END = "END OF TERMS AND CONDITIONS"


def canonical(text: str) -> str:
    """The canonical form, as ``canonical_column`` has it."""
    return _plain(re.sub(_COPYRIGHT, "", text.lower()))


def loose(text: str) -> str:
    """The looser form, as ``loose_column`` has it."""
    return _plain(re.sub(_MARKER, " ", re.sub(_NOTICE, "", text.lower())))


def _plain(text: str) -> str:
    return " ".join(EQUIVALENT.get(w, w) for w in re.findall(r"[^\W_]+", text))


def canonical_column(text: Column) -> Column:
    return _plain_column(F.regexp_replace(F.lower(text), _COPYRIGHT, ""))


def loose_column(text: Column) -> Column:
    return _plain_column(F.regexp_replace(F.regexp_replace(F.lower(text), _NOTICE, ""), _MARKER, " "))


def _plain_column(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(text, _OTHERS, " "))
    pairs = F.create_map(*[F.lit(x) for pair in EQUIVALENT.items() for x in pair])
    return F.array_join(F.transform(F.split(spaced, " "), lambda w: F.coalesce(F.try_element_at(pairs, w), w)), " ")


def known_digests() -> dict[str, str]:
    """Digest of each canonical licence text, with and without each title, and the licence's identifier."""
    found = {}
    for name, (titles, text) in KNOWN.items():
        for title in ("", *titles):
            found[hashlib.sha256(canonical(f"{title}\n{text}").encode()).hexdigest()] = name
    return found


def full_texts() -> dict[str, tuple[tuple[str, ...], str]]:
    """The licences of ``licence_texts`` in the form of ``KNOWN``."""
    folder = files(__package__) / "licence_texts"
    return {p.name.removesuffix(".txt"): ((), p.read_text(encoding="utf-8")) for p in sorted(folder.iterdir(), key=lambda p: p.name) if p.name.endswith(".txt")}


def _printings(titles: tuple[str, ...], text: str) -> set[str]:
    """The text with and without each title, its appendix, and the addresses that it was printed with."""
    found = {f"{title}\n{text}" for title in ("", *titles)}
    if _END in text:
        found |= {x[: x.index(_END)] + end for x in found for end in ("", _END)}
    return found | {_ADDRESS.sub(a, x) for x in found for a in _ADDRESSES if _ADDRESS.search(x)}


def _lookup(known: dict[str, tuple[tuple[str, ...], str]]) -> list[tuple[str, str]]:
    """Digests of both forms of all printings, and their licences; of licences with one digest the first counts."""
    found: dict[str, str] = {}
    for name, (titles, text) in known.items():
        for x in sorted(_printings(titles, text)):
            for form in (canonical(x), loose(x)):
                if form:
                    found.setdefault(hashlib.sha256(form.encode()).hexdigest(), name)
    return sorted(found.items())


def _needed(known: dict[str, tuple[tuple[str, ...], str]]) -> list[str] | None:
    """Words of which every known text holds one in its looser form, and that have no equivalent spelling; None where there are none.

    A text without any of them, in lower case, cannot have a known looser form.
    """
    spelt = {*EQUIVALENT, *EQUIVALENT.values()}
    left = [{w for w in loose(x).split() if len(w) > 4 and w not in spelt} for titles, text in known.values() for x in _printings(titles, text) if loose(x)]
    found: list[str] = []
    while left:
        counts = Counter(w for words in left for w in words)
        if not all(left):
            return None
        found.append(min(counts, key=lambda w: (-counts[w], -len(w), w)))
        left = [words for words in left if found[-1] not in words]
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, tuple[tuple[str, ...], str]] | None = None) -> DataFrame:
    """doc_id, canonical_digest and licence (null when the text is no known licence) of every row.

    ``known`` is a table in the form of ``KNOWN``; left out, it is ``KNOWN`` and the full texts of this package. Its
    digests are broadcast: a few for each licence. The looser form is taken only of texts that the first did not find and
    that hold a word which known licences have.
    """
    schema = T.StructType([T.StructField("_digest", T.StringType()), T.StructField("_licence", T.StringType())])
    known = KNOWN | full_texts() if known is None else known
    table = F.broadcast(docs.sparkSession.createDataFrame(_lookup(known), schema))
    text = F.col(text_col).cast("string")
    digests = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), F.sha2(canonical_column(text), 256).alias("canonical_digest"))
    first = digests.join(table, F.col("canonical_digest") == F.col("_digest"), "left").select("doc_id", "_text", "canonical_digest", F.col("_licence").alias("licence"))
    needed = _needed(known)
    may = F.lit(True) if needed is None else reduce(or_, [F.contains(F.lower("_text"), F.lit(w)) for w in needed], F.lit(False))
    second = first.withColumn("_loose", F.when(F.col("licence").isNull() & may, F.sha2(loose_column(F.col("_text")), 256))).drop("_text")
    both = second.join(table, F.col("_loose") == F.col("_digest"), "left")
    return both.select("doc_id", "canonical_digest", F.coalesce("licence", "_licence").alias("licence"))


def scan_sql() -> str:
    """The digests in DuckDB's SQL over ``documents``, and the licences that they tell; the looser form's pattern looks ahead,
    which this SQL cannot."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    pairs = "map {" + ", ".join(f"{quote(a)}: {quote(b)}" for a, b in EQUIVALENT.items()) + "}"
    known = ", ".join(f"({quote(d)}, {quote(n)})" for d, n in _lookup(KNOWN | full_texts()))
    return f"""
WITH known(canonical_digest, licence) AS (VALUES {known}),
spaced AS (
  SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), {quote(_COPYRIGHT)}, '', 'g'), {quote(_OTHERS)}, ' ', 'g')) AS t FROM documents),
digests AS (
  SELECT doc_id, sha256(array_to_string(list_transform(string_split(t, ' '), lambda w: coalesce(({pairs})[w], w)), ' ')) AS canonical_digest FROM spaced)
SELECT d.doc_id, d.canonical_digest, k.licence FROM digests d LEFT JOIN known k USING (canonical_digest)"""
