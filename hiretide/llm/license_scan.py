"""License scans by conditional compression.

Paragraphs (runs of lines up to one without a word) that hold a licence cue are
read as words, so line breaks and comment marks do not count.  Candidates are
the stretches of a template's length that can hold most of its words.  Each is
compressed alone and with the template as a raw zstandard dictionary; they are
ranked by the bytes the template saves.  From the greatest saving down, template
and surroundings are aligned word by word, which gives the block's exact bounds;
the block is compressed with every template, and the first in order of size
whose wording confirms it names the licence, with the words that are missing
from and put into it.  What a confirmed block covers is no part of a later one.

What is left of a sentence with a cue is reported with the template that saves
most of it.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hiretide.llm.common import column_bytes, map_rows, plain_words, worker_state

# Licence names and the wording of their notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without the written permission of the copyright holder."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
CUES = (b"license", b"licence", b"licensed", b"copyright", b"spdx", b"rights reserved", b"public domain", b"redistribut", b"permission", b"creative commons", b"cc by", b"cc-by", b"warrant")

#: Shortest share of a block that the best template must save, and of the template's words that the block must hold.
SAVES = 0.2
HOLDS = 0.8
_LINE = re.compile(rb"[^\n\r]+")
_SENTENCE = re.compile(rb"(?<=[.!?:])\s+")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A line without a word, which ends a paragraph, and a line break with the comment marks after it.
_GAP = re.compile(rb"\n[^0-9a-z\x80-\xff]*\n")
_WRAP = re.compile(rb"[ \t*/]*\n[^0-9a-z\x80-\xff]*")


def has_cue(lowered: bytes) -> bool:
    return any(c in lowered for c in CUES)


def blocks_of(text: bytes | None) -> list[tuple[int, int]]:
    """Byte ranges of the sentences with a cue; a line ends a sentence, however long it is."""
    if not text:
        return []
    lowered = text.lower()
    if not has_cue(lowered):
        return []
    out = []
    for line in _LINE.finditer(lowered):
        if has_cue(line.group()):
            a = line.start()
            cuts = [a, *(a + x for m in _SENTENCE.finditer(line.group().rstrip()) for x in m.span()), a + len(line.group().rstrip())]
            out += [(i, j) for i, j in zip(cuts[::2], cuts[1::2]) if has_cue(lowered[i:j])]
    return out


def room(words: list[bytes]) -> int:
    """Words that may be put into a template."""
    return max(2, len(words) // 4)


def least(words: list[bytes]) -> int:
    """Words of a template that a confirmed notice holds."""
    return max(1, int(np.ceil(HOLDS * len(words) - 1e-9)))


def differing(found: dict) -> int:
    """Words that a block lacks and that it has beside the template's."""
    return len(found["missing"].split()) + len(found["extra"].split())


def paragraphs_of(lowered: bytes) -> list[tuple[int, int]]:
    """Byte ranges between lines without a word, of those with a cue; line breaks are ``\\n``."""
    cuts = [0, *(x for m in _GAP.finditer(lowered) for x in m.span()), len(lowered)]
    return [(a, b) for a, b in zip(cuts[::2], cuts[1::2]) if has_cue(b" ".join(_WORD.findall(lowered, a, b))) or has_cue(lowered[a:b])]


class Scanner:
    """Compressors with each template as dictionary."""

    def __init__(self, templates: list[tuple[str, str]]) -> None:
        import zstandard as z

        self.templates = templates
        self.plain = z.ZstdCompressor(level=19, write_content_size=False)
        self.with_template = [
            z.ZstdCompressor(level=19, write_content_size=False, dict_data=z.ZstdCompressionDict(t.lower().encode(), dict_type=z.DICT_TYPE_RAWCONTENT))
            for _, t in templates
        ]
        self.words = [plain_words(t.encode()) for _, t in templates]
        self.sets = [set(w) for w in self.words]

    def find(self, text: bytes | None) -> list[dict]:
        """Every confirmed notice and, where a cue is left, the line's best template, in the order of the text."""
        if not text or not has_cue(b" ".join(plain_words(text))) and not has_cue(text.lower()):
            return []
        lowered = text.lower().replace(b"\r\n", b" \n").replace(b"\r", b"\n")
        found = [n for a, b in paragraphs_of(lowered) for n in self._notices(lowered, a, b)]
        out = [{**n, "block": text[n["first"]:n["end"]].decode("utf-8", "replace")} for n in found]
        ends = [n["end"] for n in found]
        for a, b in blocks_of(text):
            cut = False
            for n in found[bisect_left(ends, a + 1):]:
                if n["first"] >= b:
                    break
                cut = True
                out += self._rest(text, a, min(n["first"], b))
                a = max(a, min(n["end"], b))
            out += self._rest(text, a, b) if cut else [self._block(text, a, b)]
        return sorted(out, key=lambda n: n["first"])

    def _block(self, text: bytes, a: int, b: int) -> dict:
        return {"first": a, "end": b, "block": text[a:b].decode("utf-8", "replace"), **self.scan(text[a:b])}

    def _rest(self, text: bytes, a: int, b: int) -> list[dict]:
        return [self._block(text, a, b)] if a < b and has_cue(text[a:b].lower()) else []

    def _candidates(self, own: list[bytes]) -> list[tuple[int, int]]:
        """(template, start) of all windows with as many of a template's words as a confirmed notice has at least."""
        where: dict[bytes, list[int]] = {}
        for i, w in enumerate(own):
            where.setdefault(w, []).append(i)
        out = []
        for template, words in enumerate(self.words):
            held = np.zeros(len(own) + 1, np.int64)
            for w in self.sets[template]:
                held[[i + 1 for i in where.get(w, ())]] = 1
            total = np.cumsum(held)
            # a notice has room for words put into the template
            ends = np.minimum(np.arange(len(own)) + len(words) + room(words), len(own))
            starts = np.flatnonzero((total[ends] - total[:-1] >= least(words)) & (held[1:] > 0))
            out += [(template, i) for i in starts.tolist()]
        return out

    def _notices(self, lowered: bytes, a: int, b: int) -> list[dict]:
        """The confirmed blocks of a paragraph, none of which overlap."""
        places = [m.span() for m in _WORD.finditer(lowered, a, b)]
        own = [lowered[x:y] for x, y in places]

        def shown(i: int, j: int) -> bytes:
            return _WRAP.sub(b" ", lowered[places[i][0]:places[j - 1][1]])

        saved: dict[tuple, int] = {}  # a repeated line is compressed once
        ranked = []
        for template, i in self._candidates(own):
            block = shown(i, min(i + len(self.words[template]), len(own)))
            if (key := (template, block)) not in saved:
                saved[key] = len(self.plain.compress(block)) - len(self.with_template[template].compress(block))
            ranked.append((-saved[key], i, template))
        taken, out = np.zeros(len(own), bool), []
        aligned: dict[tuple, dict] = {}
        judged: dict[bytes, dict] = {}
        for _, i, template in sorted(ranked):
            if taken[i]:
                continue
            words = self.words[template]
            first, last = max(0, i - room(words)), min(len(own), i + len(words) + room(words))
            before, after = np.flatnonzero(taken[first:i]), np.flatnonzero(taken[i:last])
            first, last = first + int(before[-1]) + 1 if len(before) else first, i + int(after[0]) if len(after) else last
            if last - first < least(words):
                continue
            if (key := (template, *own[first:last])) not in aligned:
                aligned[key] = self._confirm(template, own[first:last])
            near = aligned[key]
            if near["held"] < HOLDS:
                continue
            # with what stands where the template has other words at its ends, which may be another template's
            x, y = (first + n for n in near["inside"])
            x, y = max(first, x - near["lost"][0]), min(last, y + near["lost"][1])
            if (block := shown(x, y)) not in judged:
                judged[block] = self.scan(block)
            found = judged[block]
            if found["confirmed"]:
                x, y = (x + n for n in found["inside"])
                taken[x:y] = True
                out.append(found | {"first": places[x][0], "end": places[y - 1][1]})
        return sorted(out, key=lambda n: n["first"])

    def scan(self, block: bytes) -> dict:
        """The template that saves most and whose wording confirms it, and how the wordings differ.

        Of templates that save the same number of bytes the one with the fewest different words counts.
        """
        shown = block.lower()
        alone = len(self.plain.compress(shown))
        sizes = [len(c.compress(shown)) for c in self.with_template]
        own = plain_words(block)
        # the ranking; equal sizes go to the template whose length is nearer, then the earlier one
        ranked = sorted(range(len(sizes)), key=lambda i: (sizes[i], abs(len(self.words[i]) - len(own)), i))
        tried = [i for i in ranked if alone - sizes[i] >= SAVES * alone] or ranked[:1]
        first = winner = None
        for template in tried:
            if winner and sizes[template] > winner["conditional"]:
                break
            found = self._confirm(template, own)
            found |= {"alone": alone, "conditional": sizes[template], "saves": (alone - sizes[template]) / alone}
            found["confirmed"] = found["saves"] >= SAVES and found["held"] >= HOLDS
            if found["confirmed"] and (winner is None or differing(found) < differing(winner)):
                winner = found
            first = first or found
        return winner or first

    def _confirm(self, template: int, own: list[bytes]) -> dict:
        """How the block's wording differs from the template's."""
        words = self.words[template]
        steps = difflib.SequenceMatcher(None, words, own, autojunk=False).get_opcodes()
        same = [s for s in steps if s[0] == "equal"]
        missing = [w for kind, a, b, _, _ in steps if kind != "equal" for w in words[a:b]]
        inside = (same[0][3], same[-1][4]) if same else (0, 0)
        lost = (same[0][1], len(words) - same[-1][2]) if same else (len(words), 0)
        extra = [w for kind, _, _, c, d in steps if kind != "equal" for w in own[max(c, inside[0]):min(d, inside[1])]]
        return {
            "license": self.templates[template][0], "template": template, "held": sum(s[2] - s[1] for s in same) / len(words),
            "missing": b" ".join(missing).decode("utf-8", "replace"), "extra": b" ".join(extra).decode("utf-8", "replace"),
            "exact": not missing and not extra, "inside": inside, "lost": lost,
        }


_FOUND = "struct<first: int, end: int, block: string, license: string, template: int, alone: int, conditional: int, saves: double, held: double, missing: string, extra: string, confirmed: boolean, exact: boolean>"


def scan_licenses(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Every row without its text, with ``blocks``: each confirmed notice and each other block with a cue, its template and how it differs.

    first and end are byte positions in the text; missing are the template's words that the block lacks, extra
    what stands between those it has.  Templates may be whole licence texts: each of their paragraphs is a template.
    Null and empty texts and texts without a cue have no block; repeated blocks are reported each.  Of templates
    that save as much the one with the fewest different words counts, then the nearer length, then as listed.  An input column named ``blocks`` is replaced.
    """
    templates = [(name, part) for name, whole in templates or TEMPLATES for part in _PARAGRAPH.split(whole) if plain_words(part.encode())]

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        state = worker_state()
        if state.get("licenses", (None,))[0] != templates:
            state["licenses"] = (templates, Scanner(templates))
        scanner = state["licenses"][1]
        out = []
        for t in column_bytes(batch, text):
            out.append([{k: v for k, v in n.items() if k not in ("inside", "lost")} for n in scanner.find(t)])
        return {"blocks": out}

    return map_rows(docs, run, f"blocks array<{_FOUND}>", [text])
