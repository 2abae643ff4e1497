import re
import textwrap

import pytest

from tidemark.llm import licenses, queries

B = re.compile(licenses.BOUNDARY)


def brute(text):
    text = (text or "") + "\n\n"
    if not re.search(licenses.NEEDED, text):
        return []
    known, units, at = licenses.known(), [], 0
    for m in B.finditer(text):
        gap = text[at : m.start()]
        forms = [licenses.normalised(x) for x in (gap, gap.split("\n")[-1], gap.split("\n")[0])]
        if forms[0]:
            units.append((at, m.start(), next((known[f] for f in forms if f in known), "-")))
        at = m.end()
    sequence, rules, found, i = "".join(u[2] for u in units), licenses.rules(), [], 0
    while i < len(sequence):
        hit = next(((s, name) for s, name in rules if sequence.startswith(s, i)), None)
        if hit:
            found.append((hit[1], units[i][0], units[i + len(hit[0]) - 1][1]))
        i += len(hit[0]) if hit else 1
    return found


def full(*names, prefix="", width=72):
    lines = [line for n in names for line in [*textwrap.wrap(licenses.SENTENCES[n][0] + ("" if licenses.SENTENCES[n][0][-1] == ":" else "."), width), ""]]
    return "\n".join((prefix + x).rstrip() if x else "" for x in lines)


MIT = ("mit-grant", "mit-condition", "mit-warranty", "mit-liability")
BSD = ("bsd-grant", "bsd-source", "bsd-binary")
CASES = [
    (None, []),
    ("", []),
    ("no licence here, only the word license. And more.", []),
    ("Prose before.\nReleased under the MIT License.\nProse after.", ["MIT"]),
    ("A heading\n" + full("mit-name", *MIT), ["MIT"]),
    (full(*MIT, prefix=" * "), ["MIT"]),
    (full(*BSD, "bsd-endorse"), ["BSD-3-Clause"]),
    (full(*BSD) + "é𝄞.\n" + full("apache-named", "apache-comply"), ["BSD-2-Clause", "Apache-2.0"]),
    (full("bsd-source", "bsd-grant", "bsd-binary"), []),  # the order counts
    (full("gpl-free", "gpl-hope"), ["GPL-3.0-or-later"]),
    ("# SPDX-License-Identifier: Apache-2.0\n\nimport x", ["Apache-2.0"]),
    ("Licensed under CC BY-NC 4.0. " * 300, ["CC-BY-NC-4.0"] * 300),
    ("x " * 100_000 + ".\nThis work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
]


def test_cases_equal_brute_force(spark):
    rows = licenses.scan(spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(CASES)], "doc_id long, text string, start string")).collect()
    for r in rows:
        got = [(x.licence, x.start, x.end) for x in r.found]
        assert got == brute(r.text) and [g[0] for g in got] == CASES[r.doc_id][1], r.doc_id
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.doc_id: brute(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_licenses(spark, sf).collect()
    assert {r.doc_id: r.spans for r in rows} == {d: ",".join(f"{n}:{a}:{b}" for n, a, b in f) for d, f in want.items()}
    assert sum(r.n_matches for r in rows) > 20


def test_tables_are_consistent():
    assert len(licenses.known()) == sum(map(len, licenses.SENTENCES.values()))
    assert {i for _, ids in licenses.RULES for i in ids} <= set(licenses.SENTENCES) and len(licenses.SENTENCES) <= len(licenses.SIGNS)


USUAL = {
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n",
    "MIT": "MIT License\n\nCopyright (c) 2024 The Authors\n\n" + full(*MIT),
    "MIT-0": "MIT No Attribution\n\nCopyright 2024 The Authors\n\n" + full("mit-grant", "mit-warranty", "mit-liability").replace(", subject to\nthe following conditions:", "."),
    "BSD-2-Clause": "Copyright (c) 2024, The Authors\nAll rights reserved.\n\n" + full(*BSD).replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in") + "\nTHIS SOFTWARE IS PROVIDED.",
    "Apache-2.0": 'Copyright 2024 The Authors\n\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n'
    'Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.\n',
    "GPL-3.0-or-later": "Copyright (C) 2024 The Authors\n\n" + full("gpl-free") + full("gpl-hope").rstrip(".\n") + "; " + full("gpl-fitness").replace("\n", " ") + full("gpl-details"),
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n",
    "ISC": "Copyright (c) 2024 The Authors\n\n" + full("isc-grant"),
    "GPL-3.0-only": "Licensed under the GNU General Public License, version 3.\n",
    "GPL-2.0-only": "Licensed under the GNU General Public License, version 2.\n",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0\nInternational License.\n",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0\nInternational License.\n",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0\nInternational License.\n",
    "CC0-1.0": full("cc0"),
    "Unlicense": full("unlicense"),
}
USUAL |= {
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n",
    "LGPL-3.0-or-later": "# SPDX-License-Identifier: LGPL-3.0-or-later\n\n" + full("lgpl3-free"),
    "AGPL-3.0-or-later": full("agpl-free") + "\nSPDX-License-Identifier: AGPL-3.0-or-later\n",
}
USUAL["BSD-3-Clause"] = USUAL["BSD-2-Clause"].replace("THIS SOFTWARE", "3. " + full("bsd-endorse") + "\nTHIS SOFTWARE")


def names(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: [(x.licence, r.text[x.start : x.end]) for x in r.found] for r in rows}


def test_usual_texts_of_all_licences(spark):
    assert set(USUAL) == {name for name, _ in licenses.RULES}
    wanted = list(USUAL)
    got = names(spark, USUAL.values())
    for i, name in enumerate(wanted):
        assert got[i] and {n for n, _ in got[i]} == {name}, (name, got[i])
    assert got[wanted.index("MPL-2.0")][0][1].endswith("v. 2.0")
    other = [USUAL["MPL-2.0"].replace("v. 2.0", "v. 1.1"), USUAL["BSD-2-Clause"].replace("2. Redist", "2. Also no. Redist")]
    assert names(spark, other) == {0: [], 1: []}


def test_lines_within_a_block_are_looked_up(spark):
    spdx = "# SPDX-License-Identifier: MIT"
    block = "/*\n * Copyright (c) 2024 The Authors\n *\n" + "\n".join((" * " + x).rstrip() for x in full(*MIT).split("\n")) + "\n */\nint x"
    tight = full(*BSD, "bsd-endorse").replace(":\n\n", ":\n1. ").replace("\n\nRedistributions in", "\n2. Redistributions in").replace("\n\nNeither", "\n(3) Neither")
    texts = [
        f"# Copyright 2024 The Authors\n{spdx}\nimport os",
        "The title\nMIT License\nCopyright 2024 The Authors",
        "word\n" * 5000 + spdx + "\nx = 1" * 5000,
        f"a = 1\n{spdx}\nb = 2\n# SPDX-License-Identifier: Apache-2.0\nc = 3",
        block,
        "Copyright 2024\n" + tight,
        "not the MIT License\nSPDX-License-Identifier: MIT OR X\nx",
        "a\n" + full("bsd-grant").strip() + "\nother words\n\n" + full("bsd-source", "bsd-binary"),
    ]
    got = names(spark, texts)
    assert [[n for n, _ in got[i]] for i in range(len(texts))] == [["MIT"], ["MIT"], ["MIT"], ["MIT", "Apache-2.0"], ["MIT"], ["BSD-3-Clause"], [], []]
    assert [got[i][0][1] for i in range(4)] == [spdx, "MIT License", spdx, spdx]


def test_disclaimers_belong_to_their_licence(spark):
    parts = [licenses.SENTENCES[n][0] for n in ("bsd-warranty", "bsd-liability", "bsd-loss", "bsd-cause")]
    disclaimer = "\n".join(textwrap.wrap(f"{parts[0]}. {parts[1]}; {parts[2]}; {parts[3]}.", 76))
    two, three = full(*BSD), full(*BSD, "bsd-endorse")
    got = names(spark, [two + "\n" + disclaimer, three + "\n" + disclaimer, disclaimer, "// SPDX-License-Identifier: BSD-3-Clause\n\nint x;"])
    assert [[n for n, _ in got[i]] for i in range(4)] == [["BSD-2-Clause"], ["BSD-3-Clause"], [], ["BSD-3-Clause"]]
    assert got[0][0][1].endswith("SUCH DAMAGE") and got[1][0][1].endswith("SUCH DAMAGE")


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "MIT License\n", "mine")], "doc_id long, text string, found string")
    with pytest.raises(ValueError):
        licenses.scan(docs)
    row = licenses.scan(docs, added="licences.found").first()
    assert row.found == "mine" and row["licences.found"][0].licence == "MIT"
