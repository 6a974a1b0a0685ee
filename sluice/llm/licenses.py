"""License scans by conditional compression.

A candidate block is taken in overlapping windows of bounded length. A window is compressed alone and with
each template that can be there as a raw zstandard dictionary. The more of a template's wording a window holds, the
smaller the second result. Templates are ranked by that reduction and confirmed by their exact wording differences
with the window; after each confirmed notice, what is left is ranked again.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public license notices and texts, by their SPDX names.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.0": (
        "This work is licensed under the GNU Library General Public License, version 2.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    # the clause that opens both BSD licences; scan() gives it to BSD-3-Clause where that one's own clause follows
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "All-Rights-Reserved": ("All rights reserved.",),
}
#: Words of which every notice above has one, also when they are wrapped.
CUE = r"(?i)licen[sc]|permission|redistribut|warrant|public[\W_]+domain|all[\W_]+rights[\W_]+reserved|copyright"
#: Compression level; share of a template's words that may differ.
LEVEL, DIFFER = 3, 0.2
#: Words of a window, in lengths of the longest notice; differences that no match may have.
WINDOW, FAR = 4, 1 << 20
#: Words that tell licences apart, beside version numbers: a match neither lacks nor adds one.
NAMES = frozenset("mit apache mozilla bsd cc0 affero lesser gnu-library 2-clause 3-clause 4-clause sharealike noncommercial noderivatives noderivs "
                  "cc-by by-sa by-nc by-nd by-nc-sa by-nc-nd".split())
#: (licence, template) of a clause that a larger licence shares, and the larger one's own (licence, template) after it.
SHARED = {("BSD-2-Clause", 1): ("BSD-3-Clause", 1)}

_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
_VERSION = re.compile(r"v?([0-9]+(?:\.[0-9]+)*?)(?:\.0)*")


def words_of(text: str) -> list[str]:
    """Words of a notice: letters and digits in lower case, with inner dots and hyphens."""
    return _WORD.findall(text.lower())


def reach_of(templates: dict[str, tuple[str, ...]]) -> int:
    """Words of the longest notice, with all the differences that it may have."""
    return ceil(max((len(words_of(t)) for texts in templates.values() for t in texts), default=1) * (1 + DIFFER))


def candidate_blocks(text: str, reach: int | None = None) -> list[tuple[int, str]]:
    """(character offset, block): ``reach`` words (the longest notice) on both sides of every cue, whatever the
    lines; what overlaps or touches is one block."""
    reach = reach_of(TEMPLATES) if reach is None else reach
    where = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in where]
    runs: list[list[int]] = []
    for m in re.finditer(CUE, text):
        low, high = max(bisect_right(starts, m.start()) - 1 - reach, 0), min(bisect_left(starts, m.end()) + reach, len(where))
        if runs and low <= runs[-1][1]:
            runs[-1][1] = high
        else:
            runs.append([low, high])
    return [(where[low][0], text[where[low][0] : where[high - 1][1]]) for low, high in runs]


def located(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words of a text and their places (first character, end)."""
    where = [m.span() for m in _WORD.finditer(text)]
    return [text[a:b].lower() for a, b in where], where


def forms(words: list[str]) -> list[str]:
    """Words as they are compared: versions without v and trailing zeros (2.0 is 2), and 'library' of 'GNU Library' and 'by'
    of 'CC BY' apart from the common words."""
    out = []
    for before, w in zip(["", *words], words, strict=False):
        if w in ("library", "by") and before == {"library": "gnu", "by": "cc"}[w]:
            w = f"{before}-{w}"
        elif m := _VERSION.fullmatch(w):
            w = m[1]
        out.append(w)
    return out


def telling(words: list[str]) -> list[bool]:
    """Which words (as compared) say which licence it is: names, and numbers after the word version."""
    return [w in NAMES or w.startswith("attribution") or (before in ("version", "v") and w[:1].isdigit()) for before, w in zip(["", *words], words, strict=False)]


class Scanner:
    """Templates as compressors with a raw dictionary each."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, level: int = LEVEL):
        import zstandard as zstd

        options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = zstd.ZstdCompressor(level=level, **options)
        self.templates = []
        for name, texts in templates.items():
            for k, t in enumerate(texts):
                raw = zstd.ZstdCompressionDict(t.encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
                self.templates.append((name, k, words_of(t), zstd.ZstdCompressor(level=level, dict_data=raw, **options)))
        self.counts = [Counter(forms(t[2])) for t in self.templates]
        self.reach = reach_of(templates)
        self.known: dict[str, list[dict]] = {}

    def reductions(self, block: str, which: Iterable[int] | None = None) -> tuple[int, dict[int, int]]:
        """Size of the block compressed alone, and bytes saved by each template (of those in ``which``)."""
        data = block.encode()
        alone = len(self.plain.compress(data))
        return alone, {i: alone - len(self.templates[i][3].compress(data)) for i in (range(len(self.templates)) if which is None else which)}

    def __call__(self, block: str) -> list[dict]:
        """Confirmed notices of a block with their first character in it (``at``); those of the fewest
        differences first, of equally many the best reduction; the first is the winner. A notice inside the words
        of a better one does not count again. Blocks seen before are remembered (up to 2,000)."""
        if block in self.known:
            return self.known[block]
        words, where = located(block)
        # a notice is at most ``reach`` words long, so windows that share as many hold each one whole
        size = WINDOW * self.reach
        found = [n for a in range(0, max(len(words) - self.reach, 1), size - self.reach) for n in self.window(block, words[a : a + size], where[a : a + size])]
        found.sort(key=lambda n: (-n["score"], -n["saved"], n["at"]))
        kept: list[dict] = []
        for n in found:
            if not any(n["at"] < x["end"] and x["at"] < n["end"] for x in kept):
                kept.append(n)
        kept.sort(key=lambda x: (len(x["missing"]) + len(x["extra"]), -x["saved"], x["at"]))
        kept = [{k: v for k, v in n.items() if k not in ("score", "end")} for n in kept]
        if len(self.known) >= 2_000:
            self.known.clear()
        self.known[block] = kept
        return kept

    def window(self, block: str, words: list[str], where: list[tuple[int, int]]) -> list[dict]:
        """Notices of a part of a block: the template of the best reduction first (or one of a better wording at
        its place), then again on what is left without its words."""
        left: list[str | None] = list(words)
        matches = {i: m for i in self.possible(words) if (m := differences(self.templates[i][2], left))}
        found = []
        while matches:
            rest = " ".join(block[a:b] for a, b in pieces(left, where))
            alone, saved = self.reductions(rest, matches)
            (low, high), *_ = matches[min(matches, key=lambda i: (-saved[i], i))]
            i = max((i for i, m in matches.items() if m[0][0] < high and low < m[0][1]), key=lambda i: (self.score(i, matches[i]), saved[i], -i))
            (low, high), missing, extra = matches[i]
            found.append({"at": where[low][0], "end": where[high - 1][1], "license": self.templates[i][0], "template": self.templates[i][1], "size_alone": alone, "saved": saved[i],
                          "missing": missing, "extra": extra, "exact": not missing and not extra, "score": self.score(i, matches[i])})
            left[low:high] = [None] * (high - low)
            again = [i for i, m in matches.items() if m[0][0] < high and low < m[0][1]]
            for i in again:
                if (m := differences(self.templates[i][2], left)) is None:
                    del matches[i]
                else:
                    matches[i] = m
        return found

    def possible(self, words: list[str]) -> list[int]:
        """Templates that can be confirmed: all but ``DIFFER`` of their words are there, counted as often as they
        occur."""
        have = Counter(forms(words))
        return [i for i, (*_, wanted, _) in enumerate(self.templates) if sum(min(n, have[w]) for w, n in self.counts[i].items()) >= (1 - DIFFER) * len(wanted) - 1e-9]

    def score(self, i: int, match: tuple) -> int:
        """Template words found, less the differences."""
        _, missing, extra = match
        return len(self.templates[i][2]) - 2 * len(missing) - len(extra)


def pieces(left: list[str | None], where: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places of the runs of words that are not taken."""
    out: list[tuple[int, int]] = []
    run = False
    for w, (a, b) in zip(left, where, strict=True):
        if w is not None:
            out[-1:] = [(out[-1][0], b)] if run else [*out[-1:], (a, b)]
        run = w is not None
    return out


def differences(wanted: list[str], words: list[str | None]) -> tuple[tuple[int, int], list[str], list[str]] | None:
    """Where a template fits best among the words (first and last equal word): the place, its words that are missing
    there, and words in between that the template lacks. None if at every place more than ``DIFFER`` of its words
    differ, or one that tells licences apart. Words that are None are taken, and no place holds one.

    Exact: the least number of differences over all places and alignments, row by row of the template.
    """
    names, have = forms(wanted), forms([w or "" for w in words])
    number = {w: k for k, w in enumerate(dict.fromkeys(names))}
    at = np.array([-1 if w is None else number.get(f, -1) for w, f in zip(words, have, strict=True)], dtype=np.int64)
    cost = np.concatenate([[0], np.cumsum([FAR if w is None or t else 1 for w, t in zip(words, telling(have), strict=True)])]).astype(np.int64)
    # any number of a template is its version
    lack = [FAR if t or w[:1].isdigit() else 1 for w, t in zip(names, telling(names), strict=True)]
    table = np.zeros((len(wanted) + 1, len(words) + 1), dtype=np.int64)
    for i, w in enumerate(names, 1):
        row = table[i - 1] + lack[i - 1]
        equal = np.flatnonzero(at == number[w])
        row[equal + 1] = np.minimum(row[equal + 1], table[i - 1][equal])
        table[i] = np.minimum.accumulate(row - cost) + cost
    j = int(table[-1].argmin())
    if table[-1][j] > DIFFER * len(wanted):
        return None
    i, matched, missing, extra = len(wanted), [], [], []
    while i:
        if j and at[j - 1] == number[names[i - 1]] and table[i, j] == table[i - 1, j - 1]:
            i, j = i - 1, j - 1
            matched.append(j)
        elif table[i, j] == table[i - 1, j] + lack[i - 1]:
            i -= 1
            missing.append(wanted[i])
        else:
            j -= 1
            extra.append(words[j])
    return (matched[-1], matched[0] + 1), missing[::-1], extra[::-1]


def whole_licences(found: list[dict]) -> list[dict]:
    """Notices of a text, a shared clause under the larger licence where that one's own clause comes before the next
    shared one."""
    larger = {}
    own = None
    for i in sorted(range(len(found)), key=lambda i: -found[i]["at"]):
        key = (found[i]["license"], found[i]["template"])
        if key in SHARED.values():
            own = key
        elif key in SHARED:
            if own == SHARED[key]:
                larger[i] = own[0]
            own = None
    return [{**n, "license": larger.get(i, n["license"])} for i, n in enumerate(found)]


NOTICES = ("array<struct<at:long,license:string,template:int,size_alone:long,saved:long,missing:array<string>,extra:array<string>,exact:boolean>>")


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """License notices of every document: doc_id, licenses (names, sorted), n_blocks (candidate blocks) and notices
    (offset of its first character, license, template number, compressed size alone of what was left of the window,
    bytes saved by the template, template words missing, other words in between, and whether the wording is exact).
    A clause that two licences share is numbered as the smaller one's template under either name.

    One row per input row; null and empty texts and texts without a cue have empty arrays. Whole texts are
    searched; a text without a cue word never leaves the JVM. Repeated rows are scanned each.
    """
    known = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known)
        strings = pa.list_(pa.string())
        notice = pa.list_(pa.struct([("at", pa.int64()), ("license", pa.string()), ("template", pa.int32()), ("size_alone", pa.int64()), ("saved", pa.int64()), ("missing", strings), ("extra", strings), ("exact", pa.bool_())]))
        for batch in batches:
            names, counts, notices = [], [], []
            for body in batch.column(1).to_pylist():
                blocks = candidate_blocks(body, scanner.reach) if body else []
                found = whole_licences([{**n, "at": at + n["at"]} for at, block in blocks for n in scanner(block)])
                names.append(sorted({n["license"] for n in found}))
                counts.append(len(blocks))
                notices.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, strings), pa.array(counts, pa.int64()), pa.array(notices, notice)], names=["doc_id", "licenses", "n_blocks", "notices"])

    cued = F.when(F.col(text).rlike(CUE), F.col(text))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), cued.alias("text"))
    return rows.mapInArrow(run, f"doc_id long, licenses array<string>, n_blocks long, notices {NOTICES}")
