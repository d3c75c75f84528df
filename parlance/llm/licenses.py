"""License scans by sentence rules: sentences become identifiers, and sequences of identifiers match ordered rules.

The words of a text (lower case, letters and digits only) are cut into units: a unit ends at a full stop, colon,
semicolon or question mark before white space, at a blank line, or at a line end. A run of units whose words are those
of a known sentence is that sentence, so that sentences wrapped over lines are found, but no sentence is found inside a
longer one. A rule lists identifiers in order; it matches where they follow each other with at most `gap` unknown units
between them. Where rules overlap, the one with more sentences wins, then the earlier one.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Known sentences by identifier, as published with the licenses. "{}" stands for up to twelve words (a
# name, a year, a version).
SENTENCES: dict[str, str] = {
    "mit-title": "The MIT License",
    "mit-title-2": "MIT License",
    "mit-title-3": "The MIT License (MIT)",
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-this": "This project is licensed under the MIT License",
    "mit-code": "This code is licensed under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-title": "ISC License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "apache-long": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-title": "Apache License Version 2.0",
    "apache-may-not": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-unless": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl-free": "This program is free software",
    "gpl-free-library": "This library is free software",
    "gpl-useful": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-useful-library": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "isc-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    "boost-title": "Boost Software License - Version 1.0",
    "boost-short": "Distributed under the Boost Software License, Version 1.0",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "epl-short": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "epl-short-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "epl-title": "Eclipse Public License - v 1.0",
    "epl-title-2": "Eclipse Public License - v 2.0",
    "cddl-short": "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "artistic-title": "The Artistic License 2.0",
    "bsd-short": "Licensed under the BSD License",
    "mpl-title": "Mozilla Public License Version 2.0",
    "mpl-short": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by-nd": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nc-nd": "Licensed under CC BY-NC-ND 4.0",
    "cc-zero": "Licensed under CC0 1.0",
    "cc-this-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-this-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-this-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "reserved": "All rights reserved",
}
# Ordered rules, each with the license it stands for.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-notice", "mit-as-is")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-this",)),
    ("MIT", ("mit-code",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-title-2",)),
    ("MIT", ("mit-title-3",)),
    ("ISC", ("isc-grant", "isc-as-is", "isc-liability")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-title",)),
    ("Apache-2.0", ("apache-long", "apache-may-not", "apache-copy", "apache-unless", "apache-see")),
    ("Apache-2.0", ("apache-long", "apache-may-not")),
    ("Apache-2.0", ("apache-long",)),
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("apache-title",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSL-1.0", ("boost-title",)),
    ("BSL-1.0", ("boost-short",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("EPL-1.0", ("epl-short",)),
    ("EPL-1.0", ("epl-title",)),
    ("EPL-2.0", ("epl-short-2",)),
    ("EPL-2.0", ("epl-title-2",)),
    ("CDDL", ("cddl-short",)),
    ("Artistic-2.0", ("artistic-title",)),
    ("MPL-2.0", ("mpl-title",)),
    ("BSD", ("bsd-short",)),
    ("MPL-2.0", ("mpl-short",)),
    ("Unlicense", ("unlicense",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd",)),
    ("CC0-1.0", ("cc-zero",)),
    ("CC-BY-4.0", ("cc-this-by",)),
    ("CC-BY-SA-4.0", ("cc-this-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-this-by-nc",)),
]
# The GNU licenses say the same with another name, version and word for the work.
_GNU = (("GPL", "GNU General Public License", ("1", "2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("LGPL", "GNU Library General Public License", ("2",)), ("AGPL", "GNU Affero General Public License", ("1", "3")))
_DATES = {"GPL2": "June 1991", "GPL3": "29 June 2007", "LGPL2.1": "February 1999", "LGPL3": "29 June 2007", "AGPL3": "19 November 2007", "LGPL2": "June 1991", "GPL1": "February 1989", "AGPL1": "March 2002"}
for _family, _title, _versions in _GNU:
    _see, _bare = f"{_title}-see", f"{_title}-bare"
    SENTENCES[_see], SENTENCES[_bare] = f"See the {_title} for more details", _title
    for _v in _versions:
        _name = f"{_family}-{_v if '.' in _v else _v + '.0'}"
        for _k, _written in enumerate(dict.fromkeys((_v, _v if "." in _v else _v + ".0"))):
            _grant = f"you can redistribute it and/or modify it under the terms of the {_title} as published by the Free Software Foundation"
            _own = {
                "later": f"{_grant}, either version {_written} of the License, or (at your option) any later version",
                "only": f"{_grant}, version {_written} of the License",
                "work": f"This work is licensed under the {_title}, version {_written}",
                "short": f"Licensed under the {_title}, version {_written}",
                "title": f"{_title} Version {_written}, {_DATES[_family + _v]}",
            }
            for _what, _text in _own.items():
                _id = f"{_title}-{_v}-{_k}-{_what}"
                SENTENCES[_id] = _text
                _free = _name + ("-or-later" if _what == "later" else "")
                if _what in ("later", "only"):
                    for _end in ("", "-library"):
                        RULES.append((_free, (f"gpl-free{_end}", _id, f"gpl-useful{_end}", "gpl-implied", _see)))
                        RULES.append((_free, (f"gpl-free{_end}", _id)))
                RULES.append((_free, (_id,)))
    RULES.append((_family, (_bare,)))
# A tag names a license outright.
for _name in list(dict.fromkeys(name for name, _ in RULES)):
    SENTENCES[f"spdx-{_name}"] = f"SPDX-License-Identifier: {_name}"
    RULES.append((_name, (f"spdx-{_name}",)))
#: Unknown units that may stand between two sentences of a rule (list numbers, URLs, a line of asterisks).
GAP = 3
#: Words that "{}" may stand for.
HOLE = 12

_WORDS = re.compile(r"[^\W_]+")
# A unit ends behind a mark that white space follows, or at a line end.
_UNIT = re.compile(r"[^\n]+?(?:[.:;?!](?=\s)|(?=\n)|\Z)")
# A text without any of these holds no known sentence (a test checks that each sentence holds one).
HINTS = ("licens", "permission", "redistribut", "free software", "rights reserved", "without warranty", "without any warranty", "implied warranty", "software is provided", "liable for any claim", "unencumbered", "promote products", "applicable law", "notice", "as published by the free software foundation", "this software", "this program")

_ONE_WORD = tuple(h for h in HINTS if " " not in h)
_PHRASES = tuple(h for h in HINTS if " " in h)
#: A word of each phrase that other texts seldom have; few texts need their words put in a row.
_RARE = ("free", "reserved", "warranty", "software", "liable", "promote", "applicable", "foundation", "program")


def may_match(text: str) -> bool:
    """False only if the text holds no known sentence, whatever signs and line ends stand between its words."""
    low = text.lower()
    if any(h in low for h in _ONE_WORD):
        return True
    if not any(h in low for h in _RARE):
        return False
    row = " ".join(_WORDS.findall(low))
    return any(h in row for h in _PHRASES)


def normal(text: str) -> tuple[str, ...]:
    """The words of a sentence as they are compared."""
    return tuple(_WORDS.findall(text.lower()))


_PLAIN = {normal(s): k for k, s in SENTENCES.items() if "{}" not in s}
_HOLED = [(normal(s.split("{}")[0]), normal(s.split("{}")[1]), k) for k, s in SENTENCES.items() if "{}" in s]
#: Openings of three words or fewer, and the number of words of the longest sentence that begins so.
_OPENINGS: dict[str, int] = {}
for _s in _PLAIN:
    _OPENINGS[_s[0]] = max(_OPENINGS.get(_s[0], 0), len(_s))
for _a, _b, _ in _HOLED:
    _OPENINGS[_a[0]] = max(_OPENINGS.get(_a[0], 0), len(_a) + len(_b) + HOLE)


def sentence_id(words: tuple[str, ...]) -> str | None:
    if k := _PLAIN.get(words):
        return k
    for a, b, k in _HOLED:
        n = len(words) - len(a) - len(b)
        if 1 <= n <= HOLE and words[: len(a)] == a and words[len(words) - len(b) :] == b:
            return k
    return None


def sentences(text: str) -> list[tuple[int, int, int, int, str]]:
    """Known sentences as (start, end, first unit, unit behind, identifier), in order and without overlaps."""
    units = [(m.start(), m.end(), normal(m[0])) for m in _UNIT.finditer(text)]
    units = [u for u in units if u[2]]
    out, at = [], 0
    while at < len(units):
        most = _OPENINGS.get(units[at][2][0], 0)
        best, words, end = None, (), at
        while end < len(units) and len(words) + len(units[end][2]) <= most:
            words += units[end][2]
            end += 1
            if k := sentence_id(words):
                best = (units[at][0], units[end - 1][1], at, end, k)
        if best:
            out.append(best)
            at = best[3]
        else:
            at += 1
    return out


def matches(found: list[tuple[int, int, int, int, str]]) -> list[tuple[str, int, int, int]]:
    """(license, start, end, sentences) of the rules that match a text's sentences, by start; positions count code points."""
    hits = []
    for i in range(len(found)):
        for rank, (name, ids) in enumerate(RULES):
            if found[i][4] != ids[0]:
                continue
            last, j = found[i], i
            for want in ids[1:]:
                j += 1
                while j < len(found) and found[j][4] != want and found[j][2] - last[3] <= GAP:
                    j += 1
                if j >= len(found) or found[j][4] != want or found[j][2] - last[3] > GAP:
                    break
                last = found[j]
            else:
                hits.append((-len(ids), rank, i, j, name))
    taken: set[int] = set()
    out = []
    for size, _, i, j, name in sorted(hits):
        if taken.isdisjoint(range(i, j + 1)):
            taken.update(range(i, j + 1))
            out.append((name, found[i][0], found[j][1], -size))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, sentence_ids (in order) and licenses (name, start, stop, sentences).

    Null and empty texts have none. Rows are independent (no shuffle); repeated rows each get their own row; columns
    other than doc_id and text are not read.
    """

    def run(batches):
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["text"]]
            found = [sentences(t) if t and may_match(t) else [] for t in texts]
            ids = [[x[4] for x in xs] for xs in found]
            hits = [[{"name": n, "start": a, "stop": b, "sentences": k} for n, a, b, k in matches(xs)] for xs in found]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "sentence_ids": ids, "licenses": hits})

    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInPandas(run, "doc_id string, sentence_ids array<string>, licenses array<struct<name:string,start:long,stop:long,sentences:long>>").withColumn("doc_id", F.col("doc_id").cast("long"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_matches, licenses (distinct names in code-point order), spans (name:start:end by start)."""
    text = F.array_join(F.transform("licenses", lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return scan_documents(docs).select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.size("licenses").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda s: s["name"]))), ",").alias("licenses"),
        text.alias("spans"),
    )
