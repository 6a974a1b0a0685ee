from sluice.llm import licenses


def test_every_template_wins_its_own_text():
    scanner = licenses.Scanner()
    for name, texts in licenses.TEMPLATES.items():
        for k, t in enumerate(texts):
            first = scanner(t)[0]
            assert (first["license"], first["exact"]) == (name, True), (t, k)


def test_wording_differences(make_docs):
    rows = [(1, "Erin the.\nLicensed under CC BY-NC 4.0.\nMore text"), (2, "x This work is licensed under the GNU General Public License version 3 now"),
            (3, "all permission is gone and licensed to nobody"), (4, "Released under the MIT License.\n\n\n\nLicensed under the Apache License, Version 2.0."),
            (5, None), (6, ""), (7, "no cue " * 5000 + "\nAll rights reserved.\n" + "w " * 50_000), (8, "Released under the MIT License."), (8, "Released under the MIT License.")]
    got = [r for r in licenses.scan(make_docs(rows)).collect()]
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert {i: by[i]["licenses"] for i in by} == {1: ["CC-BY-NC-4.0"], 2: ["GPL-3.0"], 3: [], 4: ["Apache-2.0", "MIT"], 5: [], 6: [], 7: ["All-Rights-Reserved"], 8: ["MIT"]}
    assert by[1]["notices"][0]["at"] == 10 and by[1]["notices"][0]["saved"] > 0
    gone = licenses.Scanner()("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                              "with the terms. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")[0]
    assert gone["license"] == "Apache-2.0" and gone["missing"] == ["license"] and gone["extra"] == ["terms"]


def test_against_all_templates_compared_plainly(spark):
    """Every line equal to a short notice is found, and nothing in texts without a template's words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: set(r["licenses"]) for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        lines = {w for w in map(str.strip, r["text"].split("\n"))}
        plain = {name for name, texts in licenses.TEMPLATES.items() for t in texts if t in lines}
        assert plain <= got[r["doc_id"]]
        words = set(licenses.words_of(r["text"]))
        for name in got[r["doc_id"]]:
            assert any(len(set(licenses.words_of(t)) & words) >= 0.8 * len(set(licenses.words_of(t))) for t in licenses.TEMPLATES[name])


def test_empty(make_docs):
    assert licenses.scan(make_docs([])).count() == 0


def test_notice_inside_a_very_long_line(make_docs):
    import random

    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(3000)]
    line = [draw.choice(words) for _ in range(20_000)]
    notices = {"MIT": "Released under the MIT License.", "CC-BY-4.0": "Licensed under CC BY 4.0.", "ISC": licenses.TEMPLATES["ISC"][0]}
    for k, (name, notice) in enumerate(notices.items()):
        text = " ".join([*line[:9_000], notice, *line[9_000:]])
        found = licenses.scan(make_docs([(k, text)])).collect()[0]
        assert found["licenses"] == [name] and len(found["notices"]) == 1 and found["notices"][0]["exact"]
        assert found["notices"][0]["at"] == text.index(notice)


def test_notices_wrapped_in_lines():
    """Every notice, wrapped at 40 to 80 columns and as a comment, with text around it."""
    import textwrap

    scanner = licenses.Scanner()
    around = ("one two three four five " * 40).strip()
    for name, texts in licenses.TEMPLATES.items():
        for k, t in enumerate(texts):
            for columns, mark in ((40, ""), (70, " * "), (80, "# ")):
                text = "\n".join(mark + line for line in textwrap.wrap(around, columns) + textwrap.wrap(t, columns, break_on_hyphens=False, break_long_words=False) + textwrap.wrap(around, columns))
                found = [n for _, block in licenses.candidate_blocks(text) for n in scanner(block)]
                assert [(n["license"], n["template"], n["exact"]) for n in found] == [(name, k, True)], (t, columns)


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""


def test_canonical_files(make_docs):
    rows = [(1, MIT), (2, APACHE)]
    got = {r["doc_id"]: r for r in licenses.scan(make_docs(rows)).collect()}
    for i, name, templates in ((1, "MIT", {2, 3}), (2, "Apache-2.0", {1, 2})):
        assert got[i]["licenses"] == [name] and {n["template"] for n in got[i]["notices"]} == templates
        assert all(n["exact"] for n in got[i]["notices"])


def test_other_notices_beside_sister_licences():
    gpl, cc = "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under a Creative Commons Attribution 4.0 License."
    found = licenses.Scanner()(gpl + "\n" + cc)
    assert [(n["license"], n["missing"], n["extra"]) for n in found] == [("GPL-3.0", [], []), ("CC-BY-4.0", ["international"], [])]
    many = [f"{t} Filler words here." for texts in licenses.TEMPLATES.values() for t in texts] * 3
    assert len(licenses.Scanner()(" ".join(many))) == len(many)


HEADER = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the {name} as published
    by the Free Software Foundation, either version {version} of the License, or
    (at your option) any later version."""
BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = BSD_2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_sister_licences_are_told_apart(make_docs):
    gnu = [("GNU General Public License", "2", "GPL-2.0"), ("GNU General Public License", "3", "GPL-3.0"), ("GNU Lesser General Public License", "2.1", "LGPL-2.1"),
           ("GNU Lesser General Public License", "3", "LGPL-3.0"), ("GNU Affero General Public License", "3", "AGPL-3.0"), ("GNU Library General Public License", "2", "LGPL-2.0"),
           ("GNU Lesser General Public License", "3.0", "LGPL-3.0")]
    rows = [(k, HEADER.format(name=n, version=v), [w]) for k, (n, v, w) in enumerate(gnu)]
    rows += [(k + 10, " ".join(t.split()), w) for k, t, w in rows]
    rows += [(30, BSD_2, ["BSD-2-Clause"]), (31, BSD_3, ["BSD-3-Clause"]), (32, BSD_2 + BSD_3, ["BSD-2-Clause", "BSD-3-Clause"]), (33, BSD_3 + BSD_2, ["BSD-2-Clause", "BSD-3-Clause"]),
             (34, "Licensed under CC BY 3.0.", []), (35, "Licensed under the License.", []), (36, "Licensed under the Apache License, Version 1.1.", []),
             (37, "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 License.", ["CC-BY-ND-4.0"]), (38, HEADER.format(name="GNU Affero General Public License", version="1"), [])]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(make_docs([(k, t) for k, t, _ in rows])).collect()}
    assert got == {k: w for k, _, w in rows}
