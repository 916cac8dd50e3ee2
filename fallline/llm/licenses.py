"""License scans: a canonical digest of each whole text, joined with the digests of known licences.

The canonical form has lower case, no copyright lines, one spelling of words that licences spell in
several ways, and single spaces for punctuation and white space; its sha-256 is the digest. A text that
is a licence, however it is laid out or whoever holds its copyright, has that licence's digest. Short
licences are kept as texts, long ones as digests in :mod:`license_digests`. Licence
notices that stand as a line of their own in a longer text are found in the same way, by the digest
of the line. Only lines with ``licen`` in them are looked at, which every known notice has.

Everything is a column expression: one row gives one row, and the one join is with a table of fixed
size, which is broadcast. A null text, or one without letters or digits, has no digest and no licence.
Repeated rows are judged alike.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .license_digests import DIGESTS

#: Spellings that are taken as one.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authoris", "authoriz"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"),
    ("customis", "customiz"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialis", "initializ"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("merchantibility", "merchantability"), ("non-commercial", "noncommercial"), ("offence", "offense"),
    ("organis", "organiz"), ("per cent", "percent"), ("programme", "program"), ("recognis", "recogniz"),
    ("sub-license", "sublicense"), ("sub license", "sublicense"), ("utilis", "utiliz"), ("whilst", "while"),
    ("wilful", "willful"), ("copyright owner", "copyright holder"), ("https://", "http://"),
)
#: A copyright line; a wrapped line of licence text may begin with the bare word.
COPYRIGHT_LINE = (
    r"(?m)^[ \t#*/;%-]*(?:copyright[ \t:]*(?:\(c\)|©|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*$"
)

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
    "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
    "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
    "USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software.\n" + _AS_IS
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END
)
_ZERO = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted.\n" + _ISC_END
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
    "liable for any damages arising from the use of this software.\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
    "alter it and redistribute it freely, subject to the following restrictions:\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
    "software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
    "software.\n"
    "3. This notice may not be removed or altered from any source distribution."
)
#: Public licence texts by their SPDX identifiers, with and without their titles.
LICENSES = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("0BSD", _ZERO),
    ("0BSD", "BSD Zero Clause License\n" + _ZERO),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_NAMES + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_START + _BSD_NAMES + _BSD_END),
)
#: One-line notices.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty where it has no letters or digits."""
    text = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    text = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, text)
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def _known(docs: DataFrame, texts: tuple[tuple[str, str], ...]) -> DataFrame:
    rows = docs.sparkSession.createDataFrame(list(texts), "license string, text string")
    return rows.select("license", digest(F.col("text")).alias("digest")).dropDuplicates(["digest"])


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    licenses: tuple[tuple[str, str], ...] = LICENSES,
    notices: tuple[tuple[str, str], ...] = NOTICES,
    digests: tuple[tuple[str, str], ...] = DIGESTS,
) -> DataFrame:
    """Digest of each whole text, the licence that it is, and the licences of its notice lines."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.lower(x).contains("licen"))
    found = _known(docs, notices).orderBy("digest").collect()  # as many rows as there are notices
    if found:
        names = F.create_map(*[F.lit(x) for r in found for x in (r.digest, r.license)])
        marks = F.filter(F.transform(lines, lambda x: names[digest(x)]), lambda x: x.isNotNull())
    else:
        marks = F.array().cast("array<string>")
    docs = docs.select(T.ids(doc_id), T.ids(text, "text"))
    docs = docs.select("doc_id", digest(F.col("text")).alias("digest"), F.coalesce(marks, F.array().cast("array<string>")).alias("marks"))
    known = _known(docs, licenses)
    if digests:
        bundled = docs.sparkSession.createDataFrame(list(digests), "license string, digest string")
        known = known.union(bundled).dropDuplicates(["digest"])
    joined = docs.join(F.broadcast(known), "digest", "left")
    return joined.select(
        "doc_id",
        "digest",
        "license",
        F.array_join(F.array_sort(F.array_distinct("marks")), ",").alias("notices"),
        F.size("marks").cast("bigint").alias("n_notices"),
    )
