"""Licence scan: sentences mapped to known identifiers, identifier sequences matched against ordered rules. DataFrame functions only.

A text is cut into sentences (at ., !, ?, ; with white space after them, but not within 'v. 2.0', and at blank lines; a number or letter
of a list alone is none), each is normalised (lower case, runs of
anything but a-z and 0-9 as one space) and looked up among the known licence sentences, whole or by its first or last line (a heading may
stand before it, or code follow). Otherwise each line of it, and lines in a row that make a known sentence, are looked up, each with its own
span. The identifiers of a document's sentences make a sequence, a sign each; the rules, longest first, are matched
against it from left to right without overlaps. Only texts with a word that every known sentence set needs are cut; nothing is shuffled.

Defined results: null text is the empty text and has no licence. Null or repeated doc_id are documents of their own. scan() keeps extra
columns. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import let, match_spans, unused

# Sentences of licences and licence notices, by identifier.
SENTENCES = {
    "mit-name": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "The MIT License", "MIT License", "SPDX-License-Identifier: MIT"],
    "mit-grant": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:"
    ],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": [
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'
    ],
    "mit-liability": [
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
    ],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-warranty": [
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
        "PARTICULAR PURPOSE ARE DISCLAIMED"
    ],
    "bsd-liability": [
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES"
    ],
    "bsd-loss": ["LOSS OF USE, DATA, OR PROFITS"],
    "bsd-cause": [
        "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
        "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
    ],
    "bsd2-name": ["SPDX-License-Identifier: BSD-2-Clause"],
    "bsd3-name": ["SPDX-License-Identifier: BSD-3-Clause"],
    "isc-name": ["SPDX-License-Identifier: ISC"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "apache-name": ["Licensed under the Apache License, Version 2.0", "Apache License, Version 2.0", "This project is licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "apache-named": ['Licensed under the Apache License, Version 2.0 (the "License")'],
    "apache-comply": ["you may not use this file except in compliance with the License"],
    "apache-unless": [
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'
    ],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License"],
    "gpl3-name": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl2-name": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2-free": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "This program is free software"],
    "gpl2-later": ["either version 2 of the License, or (at your option) any later version"],
    "gpl2-later-name": ["SPDX-License-Identifier: GPL-2.0-or-later"],
    "gpl3-later-name": ["SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl-library": ["This library is free software"],
    "lgpl-free": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "lgpl21-later": ["either version 2.1 of the License, or (at your option) any later version"],
    "lgpl21-name": ["SPDX-License-Identifier: LGPL-2.1-or-later", "Licensed under the GNU Lesser General Public License, version 2.1 or later"],
    "lgpl3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "lgpl3-name": ["SPDX-License-Identifier: LGPL-3.0-or-later"],
    "agpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl-name": ["SPDX-License-Identifier: AGPL-3.0-or-later", "Licensed under the GNU Affero General Public License, version 3 or later"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "gpl-fitness": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl-details": ["See the GNU General Public License for more details"],
    "mpl-terms": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "mpl-name": ["SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "SPDX-License-Identifier: CC0-1.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}

# Further forms of sentences, by identifier, in the usual texts of licences; the SQL doesn't know them.
VARIANTS = {
    "mit-grant": [SENTENCES["mit-grant"][0].removesuffix(", subject to the following conditions:")],  # MIT-0
}

# Rules in order; at a place the first that matches is taken.
RULES = [
    ("MIT", ["mit-name", "mit-grant", "mit-condition", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty", "mit-liability"]),
    ("MIT-0", ["mit-grant", "mit-warranty", "mit-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty", "bsd-liability", "bsd-loss", "bsd-cause"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability", "bsd-loss", "bsd-cause"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-named", "apache-comply"]),
    ("Apache-2.0", ["apache-unless", "apache-see"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-fitness", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl2-free", "gpl2-later"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl2-later"]),
    ("LGPL-2.1-or-later", ["lgpl-library", "lgpl-free", "lgpl21-later"]),
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl21-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("AGPL-3.0-or-later", ["agpl-free"]),
    ("ISC", ["isc-grant"]),
    ("MIT", ["mit-name"]),
    ("Apache-2.0", ["apache-named"]),
    ("Apache-2.0", ["apache-name"]),
    ("GPL-3.0-only", ["gpl3-name"]),
    ("GPL-2.0-only", ["gpl2-name"]),
    ("GPL-2.0-or-later", ["gpl2-later-name"]),
    ("GPL-3.0-or-later", ["gpl3-later-name"]),
    ("LGPL-2.1-or-later", ["lgpl21-name"]),
    ("LGPL-3.0-or-later", ["lgpl3-name"]),
    ("AGPL-3.0-or-later", ["agpl-name"]),
    ("BSD-2-Clause", ["bsd2-name"]),
    ("BSD-3-Clause", ["bsd3-name"]),
    ("ISC", ["isc-name"]),
    ("MPL-2.0", ["mpl-terms"]),
    ("MPL-2.0", ["mpl-name"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
]

BOUNDARY = r"""[.!?;]+["')\]]*[ \t\n\x0B\f\r]+|\n[ \t\n\x0B\f\r]*\n[ \t\n\x0B\f\r]*"""
VERSION = r"(?<!\b[vV](?=\.[^A-Za-z0-9]{1,20}[0-9]))"  # not the stop of 'v. 2.0'
MARKER = r"(?:[0-9]{1,3}|[a-z]|[ivx]{1,4})"  # the number or letter of a condition
END = "\x01"  # put behind a unit, to get the text after its last known line
NEEDED = r"(?i)licen[sc]e|permission|redistribut|copyright|warrant|law|public domain|free software"
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
OTHER = "-"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def signs() -> dict[str, str]:
    """The sign of each identifier."""
    return dict(zip(SENTENCES, SIGNS, strict=False))


def known() -> dict[str, str]:
    """The sign of each normalised known sentence."""
    return {normalised(s): sign for name, sign in signs().items() for s in SENTENCES[name]}


def variants() -> dict[str, str]:
    """The sign of each normalised further form."""
    return {normalised(s): signs()[name] for name, forms in VARIANTS.items() for s in forms}


def rules() -> list[tuple[str, str]]:
    """The sequence of signs and the licence of each rule."""
    return [("".join(signs()[i] for i in ids), name) for name, ids in RULES]


def lines() -> str:
    """A pattern of known sentences that begin and end with a line, or after a colon that opens a list; a list marker may stand before."""
    words = sorted(known() | variants(), key=len, reverse=True)
    sentences = "|".join(w.replace(" ", "[^A-Za-z0-9]++") for w in words)
    return rf"(?imd)(?:^|(?<=conditions:|met:))[^A-Za-z0-9\n]*+(?:{MARKER}[^A-Za-z0-9\n]++)?(?:{sentences})(?![A-Za-z0-9])[^A-Za-z0-9\n]*(?:$|(?<=:)(?=\s))"


def _normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def scan(docs: DataFrame, added: str = "found") -> DataFrame:
    """docs with found: array of licence, start and end (code points) in order; added: its name, which docs must not have."""
    if unused(docs.columns, added) != [added]:
        raise ValueError(f"docs has a column of this name already: {added}")
    text = F.concat(F.coalesce(F.col("text"), F.lit("")), F.lit("\n\n"))  # so that the last sentence ends
    table, licences = _map(known() | variants()), _map(dict(rules()))

    def sign(words: Column) -> Column:
        return F.coalesce(F.element_at(table, words), F.element_at(table, F.regexp_replace(words, f"^{MARKER} ", "")), F.lit(OTHER))

    def item(start: Column, end: Column, sign: Column, words: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), sign.alias("sign"), words.alias("words"))

    def by_lines(s: Column, whole: Column) -> Column:
        """The known lines of a unit and what lies between them; the unit if that is one at its beginning or end, or none."""
        start = s["start"] - F.length(s["gap"])

        def pair(h: Column) -> Column:
            at, words = start + h["start"], _normalised(h["hit"])
            return F.array(item(at - F.length(h["gap"]), at, F.lit(OTHER), _normalised(h["gap"])), item(at, start + h["end"], sign(words), words))

        hits = match_spans(F.concat(s["gap"], F.lit("\n" + END)), lines() + "|" + END, gaps=True)
        one = lambda h: (F.size(h) == 2) & (whole["sign"] != OTHER)
        return F.when(s["gap"].rlike(lines()), let(hits, lambda h: F.when(one(h), F.array(whole)).otherwise(F.flatten(F.transform(h, pair))))).otherwise(F.array(whole))

    def unit(s: Column) -> Column:
        forms = F.array(s["gap"], F.substring_index(s["gap"], "\n", -1), F.substring_index(s["gap"], "\n", 1))
        start = s["start"] - F.length(s["gap"])

        def looked_up(n: Column) -> Column:
            whole = item(start, s["start"], F.coalesce(*[F.element_at(table, F.element_at(n, i)) for i in (1, 2, 3)], F.lit(OTHER)), F.element_at(n, 1))
            return F.when(F.element_at(table, F.element_at(n, 1)).isNotNull(), F.array(whole)).otherwise(let(whole, lambda w: by_lines(s, w)))

        return let(F.transform(forms, _normalised), looked_up)

    units = F.flatten(F.transform(match_spans(text, VERSION + BOUNDARY, gaps=True), unit))
    units = F.filter(units, lambda u: ~u["words"].rlike(f"^{MARKER}?$"))

    def matched(u: Column) -> Column:
        sequence = F.array_join(F.transform(u, lambda x: x["sign"]), "")
        hits = match_spans(sequence, "|".join(signs_ for signs_, _ in rules()))
        return F.transform(hits, lambda h: F.struct(F.element_at(licences, h["hit"]).alias("licence"), F.element_at(u, h["start"] + 1)["start"].alias("start"), F.element_at(u, h["end"])["end"].alias("end")))

    found = F.when(text.rlike(NEEDED), let(units, matched))
    return docs.withColumn(added, F.coalesce(found, F.array().cast("array<struct<licence:string,start:int,end:int>>")))
