"""License scans by conditional compression.

Sentences near licence words are candidate blocks, looked at in windows of a
bounded number of words. A window is compressed alone and with each template as a
raw-content dictionary; the more a template shortens it, the likelier its wording
is in the window. Templates that shorten it enough are then aligned word by word,
and a place is confirmed only if the template's words stand there with few
differences and none in numbers or names that tell licenses apart. With so many
differences allowed, one of so many parts and one more of the template must stand
unchanged, so places are found by the parts and none is overlooked.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import texts_of

#: A template must shorten a window by this share of the template's own compressed size to be aligned.
LEAST_REDUCTION = 0.3
#: Differing words that a template may have, as a share of its words, rounded down: a short one has none.
DIFFERENCES = 0.12
#: Units (sentences or lines) between two candidate units that still belong to one block, and around them.
GAP, AROUND = 8, 2
#: A block is cut at so many units; the next begins with the last OVERLAP of them.
BLOCK_UNITS, OVERLAP = 60, 20
#: Words of a window, and of them that the next has too: more than any template with its differences.
WINDOW_WORDS, SHARED_WORDS = 1024, 192

TRIGGER = r"(?i)licen[sc]e|implied warranty|\bas-is\b|neither the name of|\bEUPL\b|copyright|permission is hereby granted|permission to use, copy|redistribution|public domain|creative commons|without warranty|warranties|\bGNU\b"

_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
    "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
    "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
    "or substantial portions of the Software."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free "
    "Software Foundation, either version {1} of the License, or (at your option) any later version."
)
# Wording of licenses and of their usual notices; fixed values.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", _GRANT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format("General Public License", 3)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format("General Public License", 2)),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", 3)),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format("Affero General Public License", 3)),
    ("BSD", _BSD),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("Apache-2.0", "License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages"),
]
# Words that tell licenses apart: one of them too many or too few is another license.
TELLING = set("mit apache gnu general lesser affero bsd isc mozilla cc cc0 by sa nc nd attribution sharealike noncommercial noderivatives unencumbered".split())

_WORD = re.compile(r"[A-Za-z]+|\d+(?:\.\d+)*")
# The mark of a list's item, which is no wording: at the beginning, or after the end of a sentence or part of one ("v. 2." is a version).
_MARK = re.compile(r"(?:\A|(?<![vV])[.:;,*/#]|\b(?:and|or))\s+\(?(\d{1,2}|[a-h])(?:\)|\.(?=\s))|\A\s*\(?(\d{1,2}|[a-h])(?:\)|\.(?=\s))")
_UNIT = re.compile(r"[^\n]*?(?:[.!?](?=\s)|\n|$)\s*", re.S)
_HIT = re.compile(TRIGGER)


def _words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words in lower case and their places; marks of list items are left out."""
    marks = {m.start(1) if m[1] else m.start(2) for m in _MARK.finditer(text)}
    found = [m for m in _WORD.finditer(text) if m.start() not in marks]
    return [m[0].lower() for m in found], [m.span() for m in found]


class Templates:
    """Templates with their words and compressors."""

    def __init__(self, templates: list[tuple[str, str]] | None = None):
        self.names, self.words, self.coders = [], [], []
        for name, text in templates or TEMPLATES:
            words, _ = _words(text)
            raw = " ".join(words).encode()
            self.names.append(name)
            self.words.append(words)
            self.coders.append(self._coder(zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)))
        self.plain = self._coder(None)
        # Differences that a template may have; its parts, of which one at least stands unchanged, and where they begin in it.
        self.allowed = [int(DIFFERENCES * len(w)) for w in self.words]
        self.parts = []
        for own, n in zip(self.words, self.allowed):
            cuts = [len(own) * i // (n + 1) for i in range(n + 2)]
            self.parts.append([(a, " " + " ".join(own[a:b]) + " ") for a, b in zip(cuts, cuts[1:])])
        empty = len(self.plain.compress(b""))
        self.sizes = [len(self.plain.compress(" ".join(w).encode())) - empty for w in self.words]

    @staticmethod
    def _coder(dictionary):
        return zstandard.ZstdCompressor(level=9, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False)

    def reductions(self, words: list[str]) -> list[float]:
        """How much each template shortens the compressed block, as a share of the template's own compressed size."""
        raw = " ".join(words).encode()
        alone = len(self.plain.compress(raw))
        return [(alone - len(c.compress(raw))) / n for c, n in zip(self.coders, self.sizes)]

    def _at(self, k: int, words: list[str], start: int) -> tuple[int, int, list[str]] | None:
        """Where template k stands near ``start``, and its differences ('-' missing, '+' added), if they are few enough."""
        own, n = self.words[k], len(self.words[k])
        if start >= 0 and words[start : start + n] == own:
            a, b, diff = start, start + n, []
        else:
            spare = self.allowed[k]
            low = max(0, start - spare)
            near = words[low : start + n + spare]
            matched = [m for m in difflib.SequenceMatcher(None, own, near, autojunk=False).get_matching_blocks() if m.size and abs(low + m.b - m.a - start) <= spare]
            if not matched:
                return None
            a, b = low + matched[0].b, low + matched[-1].b + matched[-1].size
            diff = []
            for op, i, j, x, y in difflib.SequenceMatcher(None, own, words[a:b], autojunk=False).get_opcodes():
                if op != "equal":
                    diff += ["-" + w for w in own[i:j]] + ["+" + w for w in words[a + x : a + y]]
            if len(diff) > spare or any(w[1:] in TELLING or w[1].isdigit() for w in diff):
                return None
        # A telling word right after the template makes it another license ("CC BY" in "CC BY-NC").
        return None if b < len(words) and words[b] in TELLING else (a, b, diff)

    def _places(self, words: list[str], first: int, end: int) -> Iterator[tuple[int, int, str, float, list[str]]]:
        """All confirmed places of templates in the window of words from ``first`` to ``end``."""
        window = words[first:end]
        joined = " " + " ".join(window) + " "
        # The word that begins at each place of the joined window, less one for the space before it.
        starts = [0]
        for w in window[:-1]:
            starts.append(starts[-1] + len(w) + 1)
        for k, reduction in enumerate(self.reductions(window)):
            if reduction < LEAST_REDUCTION:
                continue
            tried = set()
            for offset, part in self.parts[k]:
                at = joined.find(part)
                while at >= 0:
                    start = first + bisect.bisect_left(starts, at) - offset
                    if start not in tried:
                        tried.add(start)
                        if found := self._at(k, words, start):
                            yield found[0], found[1], self.names[k], reduction, found[2]
                    at = joined.find(part, at + 1)

    def find(self, words: list[str]) -> list[tuple[int, int, str, float, list[str]]]:
        """(first word, end, license, reduction, differences) of the licenses in a block, from the left.

        The longest wording wins, as a notice may be part of a longer one; then the first, with the fewest differences.
        """
        found: list[tuple[int, int, str, float, list[str]]] = []
        first = 0
        while words:
            end = min(len(words), first + WINDOW_WORDS)
            found += self._places(words, first, end)
            if end == len(words):
                break
            first = end - SHARED_WORDS
        taken: list[tuple[int, int, str, float, list[str]]] = []
        for x in sorted(found, key=lambda x: (x[0] - x[1], x[0], len(x[4]), -x[3], x[2])):
            i = bisect.bisect_left(taken, x[0], key=lambda y: y[0])
            if (i == 0 or taken[i - 1][1] <= x[0]) and (i == len(taken) or x[1] <= taken[i][0]):
                taken.insert(i, x)
        return taken


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of a text to look at: sentences or lines with licence words, and what lies around and between such."""
    units = [m.span() for m in _UNIT.finditer(text) if m.end() > m.start()]
    hits = [i for i, (a, b) in enumerate(units) if _HIT.search(text, a, b)]
    yield from (units[i] for i in hits)
    at = 0
    while at < len(hits):
        end = at
        while end + 1 < len(hits) and hits[end + 1] - hits[end] <= GAP + 1:
            end += 1
        first, last = max(0, hits[at] - AROUND), min(len(units) - 1, hits[end] + AROUND)
        while first <= last:
            stop = min(last, first + BLOCK_UNITS - 1)
            yield units[first][0], units[stop][1]
            first = last + 1 if stop == last else stop + 1 - OVERLAP
        at = end + 1


def licenses_of(text: str, templates: Templates) -> list[tuple[str, int, int, float, list[str]]]:
    """(license, start, end, reduction, differences) of a text, by place; code points, end exclusive.

    Where findings overlap, the longest stays, then the first.
    """
    found = []
    for a, b in _blocks(text):
        words, spans = _words(text[a:b])
        for first, end, name, reduction, diff in templates.find(words):
            found.append((name, a + spans[first][0], a + spans[end - 1][1], reduction, diff))
    out: list[tuple[str, int, int, float, list[str]]] = []
    covered = 0
    for x in sorted(found, key=lambda x: (x[1], x[1] - x[2])):
        if x[1] >= covered:
            out.append(x)
        elif x[2] - x[1] > out[-1][2] - out[-1][1]:
            out[-1] = x
        covered = out[-1][2]
    return out


_LOADED: list[Templates] = []


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _LOADED:
        _LOADED.append(Templates())
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [], [])
        for flagged, text in zip(batch.column(2).to_pylist(), texts_of(batch.column(1))):
            found = licenses_of(text, _LOADED[0]) if flagged else []
            values = (
                len(found),
                ",".join(sorted({x[0] for x in found})),
                ",".join(f"{n}:{a}:{b}" for n, a, b, _, _ in found),
                max([x[3] for x in found], default=0.0),
                ";".join(" ".join(x[4]) for x in found),
            )
            for column, v in zip(rows, values):
                column.append(v)
        types = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(r, t) for r, t in zip(rows, types)]],
            ["doc_id", "n_licenses", "licenses", "spans", "reduction", "differences"],
        )


def license_report(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_licenses, licenses, spans, reduction, differences.

    licenses: distinct names, sorted; spans: name:start:end by place; reduction:
    the most that a confirmed template shortens its window, as a share of the
    template's compressed size; differences: of each span, words the template has
    more ('-') or the text ('+'). Where findings overlap the longest stays, of
    equal ones the first. Null and empty texts have none; a text of any length is
    scanned whole, long lines in windows; rows that repeat are each reported; a
    null id stays null. Other columns are ignored, whatever their names; an empty
    table gives an empty result.
    """
    source = docs.select(docs[id].cast("long").alias("doc_id"), docs[text].alias("text"))
    # Texts without licence words need not leave the JVM.
    flagged = F.coalesce(F.col("text").rlike(TRIGGER), F.lit(False))
    source = source.select("doc_id", F.when(flagged, F.col("text")).alias("text"), flagged.alias("flagged"))
    schema = "doc_id long, n_licenses long, licenses string, spans string, reduction double, differences string"
    return source.mapInArrow(_scan, schema)
