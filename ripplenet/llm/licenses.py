"""License notices by conditional compression.

A piece of text is compressed alone and with each template as a raw zstandard dictionary. What a template saves there, as
a share of what it saves on its own text, tells whether much of it occurs, however much prose stands around it. The place
of each such template is then found by alignment of words, and the exact differences in wording confirm it, so that a name
in passing is no notice and a changed version number is seen. The best place is reported and blanked, and what remains of
the piece is searched again, so every notice of a piece is found, copies too.

Blocks are the surroundings of cue words of license language, across line ends, and run together where they overlap; every
cue of every whole text is looked at; a template without such a word is looked for by its longest one. Long blocks are searched in pieces that overlap by more than any template. Texts are
never shuffled. SPDX identifiers are read as they are, of licenses without a template too. The templates are one-sentence
notices, file headers and the short license bodies; the full legal texts of the GPL, LGPL, MPL, Apache and Creative Commons
licenses are not among them.

Nulls and edge cases: a null or empty text has no blocks. Rows are handled one by one; a null ``doc_id`` and repeated rows
pass through. If templates tie, the longer one wins, then the first by name. An empty table gives an empty result. Other
columns of the input are not looked at.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplenet.llm.common import whole_text
from ripplenet.llm.decontamination import align

# The notices as their publishers word them.
TEMPLATES: dict[str, str] = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS"
)
_GNU = (
    "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the "
    "Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution."
)
# Further wordings of the same licenses: file headers and bodies.
WORDINGS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
     "endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
     "International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
     "International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("AGPL-3.0", _GNU.format("program", "Affero General Public License", 3)),
    ("GPL-2.0", _GNU.format("program", "General Public License", 2)),
    ("GPL-3.0", _GNU.format("program", "General Public License", 3)),
    ("LGPL-2.1", _GNU.format("library", "Lesser General Public License", "2.1")),
    ("LGPL-3.0", _GNU.format("library", "Lesser General Public License", 3)),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
     "this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + " OR "
     "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
     "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
     "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
     "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
     "purpose, commercial or non-commercial, and by any means."),
)
_CUE = r"licen[sc]|copyright|redistribut|public domain|creative commons|\bCC[ -]BY|\bwaived all\b"
CUE = re.compile(_CUE.replace(" ", r"\s+").replace("[\\s+-]", r"[\s-]"), re.IGNORECASE)
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)")
_SPDX_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9.-]*")
# Parts of words that tell sibling licenses apart; a notice must have just those of its template.
TELLING = frozenset("affero lesser library noncommercial nc sharealike sa noderivatives noderivs nd".split())
# Characters looked at around a cue, and in one piece of a block; pieces overlap by half.
AROUND, PIECE = 600, 4000
# Least share of its own saving that a template must save, and least share of its words' score by alignment.
LEAST_REDUCTION, LEAST_SCORE = 0.2, 0.5
# A notice may lack, and its place may add, this share of the template's words; numbers and ``TELLING`` words must be the same.
MAX_DIFFERENCE = 0.25
# Parts of hyphenated words are words, as a wrapped line may break them.
_WORD = re.compile(r"[\w.+]*\w")
_ROW = "start int, end int, license string, reduction double, missing string, added string, confirmed boolean"
Templates = tuple[tuple[str, str], ...]


@lru_cache(maxsize=4)
def compressors(templates: Templates) -> tuple[zstandard.ZstdCompressor, list[tuple[zstandard.ZstdCompressor, int]]]:
    """A plain compressor, and for each template one that has it as dictionary, with the bytes it saves on its own text."""
    slim = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
    make = lambda **more: zstandard.ZstdCompressor(
        compression_params=zstandard.ZstdCompressionParameters.from_level(3, **slim), **more
    )
    raw = lambda text: zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    alone, out = make(), []
    for _, text in templates:
        one = make(dict_data=raw(text))
        out.append((one, max(1, len(alone.compress(text.encode())) - len(one.compress(text.encode())))))
    return alone, out


@lru_cache(maxsize=4)
def template_words(templates: Templates) -> list[list[str]]:
    return [[w.lower() for w in _WORD.findall(text)] for _, text in templates]


def cue_of(templates: Templates) -> str:
    """The pattern of cues: those of license language, and the longest word of each template that has none of them."""
    own = [max(_WORD.findall(text), key=len, default="") for _, text in templates if not CUE.search(text)]
    return "|".join([CUE.pattern, *sorted(re.escape(w) for w in set(own) if w)])


def tells_apart(words: Sequence[str]) -> bool:
    """Whether a number or a part of a word that names another license is among the words."""
    return any(any(c.isdigit() for c in w) or not TELLING.isdisjoint(re.split(r"[^a-z]+", w)) for w in words)


def blocks(text: str, cue: re.Pattern = CUE) -> Iterator[tuple[int, int]]:
    """Start and end of each run of overlapping surroundings of cues."""
    start, end = 0, -1
    for m in cue.finditer(text):
        if m.start() - AROUND > end:
            if end >= 0:
                yield start, end
            start = max(0, m.start() - AROUND)
        end = min(len(text), m.end() + AROUND)
    if end >= 0:
        yield start, end


def ranked(piece: str, templates: Templates) -> list[tuple[float, int]]:
    """Numbers of the templates that save enough on the piece, by falling share of what they save on their own text.

    Line ends and comment marks are taken out of the piece first, since they break up a wrapped notice.
    """
    alone, with_template = compressors(templates)
    data = re.sub(r"\s*\n[\s#*/;%-]*", " ", piece).encode()
    size = len(alone.compress(data))
    shares = [((size - len(c.compress(data))) / own, i) for i, (c, own) in enumerate(with_template)]
    return sorted((x for x in shares if x[0] >= LEAST_REDUCTION), key=lambda x: (-x[0], x[1]))


def differences(block: str, template: str) -> tuple[int, int, list[str], list[str]]:
    """Where the template's wording begins and ends in the block, and the words missing from it and added inside it."""
    have = [(m.group().lower(), *m.span()) for m in _WORD.finditer(block)]
    want = [w.lower() for w in _WORD.findall(template)]
    matcher = difflib.SequenceMatcher(None, want, [w for w, _, _ in have], autojunk=False)
    same = [m for m in matcher.get_matching_blocks() if m.size]
    if not same:
        return 0, 0, want, []
    first, last = same[0].b, same[-1].b + same[-1].size
    kept = {m.b + k for m in same for k in range(m.size)}
    found = {m.a + k for m in same for k in range(m.size)}
    missing = [w for i, w in enumerate(want) if i not in found]
    added = [have[i][0] for i in range(first, last) if i not in kept]
    # A replaced word at an end lies outside the matched part; it is among the missing ones all the same.
    return have[first][1], have[last - 1][2], missing, added


def _beside(piece: str, start: int, end: int) -> list[str]:
    """Parts joined to the place by a hyphen or standing in front of it."""
    before = re.search(r"([A-Za-z]+)[ -]?$", piece[max(0, start - 40) : start])
    after = re.match(r"-([A-Za-z]+)", piece[end : end + 40])
    return [m.group(1).lower() for m in (before, after) if m and m.group(1).lower() in TELLING]


def same_words(notice: str) -> re.Pattern:
    words = r"[^\w.+]+[.+]*".join(map(re.escape, _WORD.findall(notice)))
    return re.compile(rf"(?<![\w.+-]){words}(?![.+-]*\w)", re.IGNORECASE)


def judged(piece: str, templates: Templates) -> tuple | None:
    """The place in the piece that is closest to a template in wording; confirmed ones come first."""
    have = [(m.group().lower(), *m.span()) for m in _WORD.finditer(piece)]
    words = [w for w, _, _ in have]
    best = None
    for reduction, i in ranked(piece, templates):
        want = template_words(templates)[i]
        score, first, last = align(want, words)
        if score < LEAST_SCORE:
            continue
        low, high = have[first][1], have[last][2]
        start, end, missing, added = differences(piece[low:high], templates[i][1])
        n = len(missing) + len(added)
        # A telling word right beside the place belongs to the notice as well.
        beside = _beside(piece, low + start, low + end)
        confirmed = n <= MAX_DIFFERENCE * len(want) and not tells_apart([*missing, *added, *beside])
        key = (not confirmed, n / len(want), -len(want), templates[i][0])
        if best is None or key < best[0]:
            best = key, (low + start, low + end, templates[i][0], reduction, " ".join(missing), " ".join(added), confirmed)
    return best[1] if best else None


@lru_cache(maxsize=4)
def cue_pattern(templates: Templates) -> re.Pattern:
    return re.compile(cue_of(templates), re.IGNORECASE)


def spdx_name(word: str, names: Mapping[str, str]) -> str | None:
    """A license by its SPDX identifier: one of ``names``, or any other word that has the form of an identifier."""
    plain = re.sub(r"-(only|or-later)$", "", word, flags=re.IGNORECASE)
    known = names.get(plain.lower())
    return known or (plain if re.search(r"[-0-9]", plain) and not re.search("exception", plain, re.IGNORECASE) else None)


def notices(text: str, templates: Templates) -> list[tuple]:
    """Each notice of a text, in order: start, end, license, reduction, missing and added words, verdict."""
    out = []
    names = {name.lower(): name for name, _ in templates}
    for m in SPDX.finditer(text):
        for one in _SPDX_NAME.finditer(m.group(1)):
            name = spdx_name(one.group(), names)
            if name:
                out.append((m.start(), m.start(1) + one.end(), name, 1.0, "", "", True))
    for start, end in blocks(text, cue_pattern(templates)):
        at = start
        while at < end:
            stop = min(end, at + PIECE)
            piece, done = text[at:stop], at + PIECE // 2
            while (found := judged(piece, templates)) is not None:
                places = [found[:2]]
                if not found[4] and not found[5]:  # copies word for word need no search of their own
                    places = sorted({*places, *(m.span() for m in same_words(piece[slice(*found[:2])]).finditer(piece))})
                for low, high in places:
                    piece = piece[:low] + "\n" * (high - low) + piece[high:]
                    # What begins in the second half is left to the next piece, which holds it whole.
                    if stop == end or low < PIECE // 2:
                        out.append((at + low, at + high, *found[2:]))
                        done = max(done, at + high)
            at = done if stop < end else end
    return sorted(out, key=lambda r: r[:3])


def scan_licenses(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, wordings: Sequence[tuple[str, str]] = WORDINGS
) -> DataFrame:
    """One row for each place that a template fits: its bounds, license, reduction, wording differences, verdict.

    ``reduction`` is what the template saves in the piece as a share of what it saves on its own text.
    """
    fixed = tuple(sorted([*templates.items(), *(w for w in wordings if w[0] in templates)]))
    rows = docs.select("doc_id", whole_text().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.bool_()]
        names = ["doc_id", "start", "end", "license", "reduction", "missing", "added", "confirmed"]
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for row in notices(text, fixed):
                    at.append(i)
                    out.append(row)
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            ids = batch.column("doc_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return rows.where(F.col("text").rlike(f"(?i){cue_of(fixed)}")).mapInArrow(scan, f"doc_id {kind}, {_ROW}")
