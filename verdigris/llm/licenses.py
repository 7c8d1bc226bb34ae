"""License scan by patience alignment.

A notice is found where a text aligns with a license template: words that occur once in both are anchors, the longest
increasing subsequence of anchors is kept, and the gaps between them are aligned in the same way; a gap without unique
common words is aligned by its longest common subsequence. Coverage is the share of the template's words that match.

The words that name a license must all match, each phrase of NAMING in one piece: coverage alone would take one license
for another that differs in its name.

Only the neighbourhoods of key words are aligned. A template's key is a naming word that is rare, or else its rarest
words, so many that no match of the required coverage can do without all of them: leaving the rest of a text out loses
no notice.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .stage import identified
from .textnum import text_buffer, text_slices, words

COVERAGE = 0.8

#: (name, may the text be used commercially without sharing alike, template)
TEMPLATES = [
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Licensed under the MIT License."),
    (
        "MIT",
        "permissive",
        (
            "Permission is hereby granted, free of charge, to any "
            "person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, "
            "merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software "
            "is furnished to do so"
        ),
    ),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "permissive",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL",
        "copyleft",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    (
        "BSD",
        "permissive",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    ("CC-BY-NC-4.0", "restricted", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "copyleft", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "restricted", "Copyright. All rights reserved. No part of this work may be reproduced without permission."),
    ("Proprietary", "restricted", "All rights reserved."),
]

#: Phrases that a match can't lack, by license or by template; they hold for the templates that contain all of them.
NAMING = {
    "MIT": ["mit"],
    "Licensed under the Apache License, Version 2.0.": ["apache", "2 0"],
    "GPL-3.0": ["gnu general", "version 3"],
    "MPL-2.0": ["mozilla", "2 0"],
}


def _more(name: str, kind: str, text: str, *phrases: str) -> None:
    if (name, kind, text) not in TEMPLATES:
        TEMPLATES.append((name, kind, text))
    NAMING[text] = list(phrases)


for _name, _kind, _title, *_phrases in [
    ("ISC", "permissive", "ISC License", "isc"),
    ("BSD", "permissive", "BSD License", "bsd"),
    ("Zlib", "permissive", "zlib License", "zlib"),
    ("BSL-1.0", "permissive", "Boost Software License", "boost"),
    ("Apache", "permissive", "Apache License", "apache"),
    ("MPL", "copyleft", "Mozilla Public License", "mozilla"),
    ("EPL", "copyleft", "Eclipse Public License", "eclipse"),
]:
    for _done in ("Released", "Licensed"):
        _more(_name, _kind, f"{_done} under the {_title}.", *_phrases)
for _title, _short, _versions in [("General", "GPL", ("2", "3")), ("Lesser General", "LGPL", ("2.1", "3")), ("Affero General", "AGPL", ("3",))]:
    _phrase = f"gnu {_title}".lower()
    _more(_short, "copyleft", f"Licensed under the GNU {_title} Public License.", _phrase)
    _more(_short, "copyleft", TEMPLATES[6][2].replace("General", _title), _phrase)
    for _version in _versions:
        _more(f"{_short}-{_version}" + ".0" * ("." not in _version), "copyleft", f"This work is licensed under the GNU {_title} Public License, version {_version}.", _phrase, "version " + _version.replace(".", " "))
for _parts, _kind, _long in [
    ("BY", "permissive", "Attribution"),
    ("BY-SA", "copyleft", "Attribution-ShareAlike"),
    ("BY-ND", "restricted", "Attribution-NoDerivatives"),
    ("BY-NC", "restricted", "Attribution-NonCommercial"),
    ("BY-NC-SA", "restricted", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "restricted", "Attribution-NonCommercial-NoDerivatives"),
]:
    for _version in ("4.0", "3.0", "2.5", "2.0", "1.0"):
        for _form, _text in [(f"CC {_parts} {_version}", "Licensed under {}."), (f"{_long} {_version}", "This work is licensed under a Creative Commons {} International License.")]:
            _more(f"CC-{_parts}-{_version}", _kind, _text.format(_form), _form.lower().replace("-", " ").replace(".", " "))

_DISCLAIMED = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE."""
_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""

#: Whole texts; of overlapping notices the longest match counts, so a text is taken for the fullest template.
TEMPLATES += [
    ("BSD-2-Clause", "permissive", f"{_TWO} {_DISCLAIMED}"),
    (
        "BSD-3-Clause",
        "permissive",
        f"""{_TWO} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission. {_DISCLAIMED}""",
    ),
    (
        "ISC",
        "permissive",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        "permissive",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
may not be removed or altered from any source distribution.""",
    ),
    (
        "Unlicense",
        "permissive",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software
dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the
public at large and to the detriment of our heirs and successors.""",
    ),
    (
        "BSL-1.0",
        "permissive",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software,
and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.""",
    ),
    (
        "CC0-1.0",
        "permissive",
        """To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work
to the public domain worldwide. You can copy, modify, distribute and perform the work, even for commercial purposes, all
without asking permission.""",
    ),
    (
        "Apache-2.0",
        "permissive",
        """Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide,
non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly
display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.""",
    ),
    (
        "GPL-3.0",
        "copyleft",
        """You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you
conspicuously and appropriately publish on each copy an appropriate copyright notice; keep intact all notices stating that this
License and any non-permissive terms added in accord with section 7 apply to the code; keep intact all notices of the absence of
any warranty; and give all recipients a copy of this License along with the Program.""",
    ),
]

_COMMON = set("a all an and any are as at be by can do following for form from in is it list may met must no not of on or that the this to under use with without you your work part terms 0 2 3 4 version v copy conditions above either mit general".split())


def hashes(text: str) -> list[int]:
    h, _, _, _ = words(*text_buffer(pa.array([text])))
    return h.tolist()


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of pairs, given by first part, that rises in the second."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tails, j)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def _common(a: list, b: list, a0: int, b0: int) -> list[tuple[int, int]]:
    """Longest common subsequence of two short gaps."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((a0 + i, b0 + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list, a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Matched positions of a and b, rising in both."""
    inside = set(b)
    if not inside.intersection(a):
        return []
    na, nb = Counter(a), Counter(b)
    where = {x: j for j, x in enumerate(b) if nb[x] == 1}
    anchors = _increasing([(i, where[x]) for i, x in enumerate(a) if na[x] == 1 and x in where])
    if not anchors:
        # Words that the other side lacks can't match; the rest is no longer than the template's repeats allow.
        left, right = [i for i, x in enumerate(a) if x in inside], set(a)
        keep = [j for j, x in enumerate(b) if x in right]
        found = _common([a[i] for i in left], [b[j] for j in keep], 0, 0)
        return [(a0 + left[i], b0 + keep[j]) for i, j in found]
    out, i, j = [], 0, 0
    for x, y in [*anchors, (len(a), len(b))]:
        if x > i and y > j:
            out += align(a[i:x], b[j:y], a0 + i, b0 + j)
        if x < len(a):
            out.append((a0 + x, b0 + y))
        i, j = x + 1, y + 1
    return out


def _needed(n: int, coverage: float) -> int:
    """How many of n words make the coverage; rounding of the product doesn't count."""
    return math.ceil(round(coverage * n, 9))


def _naming(name: str, text: str, raw: list[int]) -> list[list[int]]:
    """The places in a template of each phrase that a match can't lack."""
    places = []
    for phrase in NAMING.get(text, NAMING.get(name, [])):
        part = hashes(phrase)
        at = next((i for i in range(len(raw) - len(part) + 1) if raw[i : i + len(part)] == part), None)
        if at is None:
            return []
        places.append(list(range(at, at + len(part))))
    return places


def _named(pairs: list[tuple[int, int]], naming: list[list[int]]) -> bool:
    """Do all naming phrases match, each as neighbouring words of the text?"""
    if not naming:
        return True
    where = {j: i for i, j in pairs}
    return all(where.get(phrase[0], -1) >= 0 and all(where.get(j) == where[phrase[0]] + k for k, j in enumerate(phrase)) for phrase in naming)


class Scanner:
    def __init__(self, templates: list[tuple[str, str, str]], coverage: float):
        self.coverage = coverage
        self.templates = []
        self.by_key: dict[int, list[int]] = {}
        for name, kind, text in templates:
            raw, low = hashes(text), text.lower()
            plain = {hashes(w)[0]: w for w in {*"".join(c if c.isalnum() else " " for c in low).split()}}
            count = Counter(raw)
            order = sorted(count, key=lambda h: (plain.get(h, "") in _COMMON, -len(plain.get(h, "")), h))
            need, naming = _needed(len(raw), coverage), _naming(name, text, raw)
            names = {raw[j] for phrase in naming for j in phrase}
            rare = [h for h in order if h in names and plain.get(h, "") not in _COMMON]
            keys, mass = set(rare[:1]), 0
            # Together the key words are more than what a match may lack.
            for h in order if not rare else []:
                if mass > len(raw) - need:
                    break
                keys.add(h)
                mass += count[h]
            for h in keys:
                self.by_key.setdefault(h, []).append(len(self.templates))
            self.templates.append((name, kind, raw, need, naming))
        self.keys = np.sort(np.array(list(self.by_key), np.uint64))

    def row(self, h: np.ndarray, hits: np.ndarray) -> list[tuple[str, str, int, int, int, float]]:
        """Notices in one text: (license, kind, first word, end word, matched words, coverage)."""
        near: dict[int, list[int]] = {}
        for p in hits.tolist():
            for t in self.by_key[int(h[p])]:
                near.setdefault(t, []).append(p)
        found = []
        for t, places in near.items():
            name, kind, raw, need, naming = self.templates[t]
            reach = len(raw) + len(raw) // 2 + 5
            windows: list[list[int]] = []
            for p in places:
                lo, hi = max(p - reach, 0), min(p + reach + 1, len(h))
                if windows and lo <= windows[-1][1]:
                    windows[-1][1] = hi
                else:
                    windows.append([lo, hi])
            vocabulary, names = set(raw), {raw[j] for phrase in naming for j in phrase}
            for lo, hi in windows:
                text = h[lo:hi].tolist()
                inside = vocabulary.intersection(text)
                if len(inside) < len(vocabulary) - (len(raw) - need) or not names <= inside:
                    continue
                found += [(name, kind, lo + s, lo + e, n, n / len(raw)) for s, e, n in self._notices(text, raw, need, naming)]
        # Of overlapping notices the one with most matched words stays.
        found.sort(key=lambda x: (-x[4], -x[5], x[2], x[0]))
        kept: list[tuple[str, str, int, int, int, float]] = []
        for x in found:
            if all(x[3] <= y[2] or x[2] >= y[3] for y in kept):
                kept.append(x)
        return sorted(kept, key=lambda x: x[2])

    def _notices(self, text: list, raw: list, need: int, naming: list[list[int]]) -> list[tuple[int, int, int]]:
        """Every stretch of a window that aligns: the window is cut where one template's length of words ends."""
        out, inside, size = [], set(raw), len(raw)
        places = [i for i, x in enumerate(text) if x in inside]
        k = 0
        while k < len(places):
            start = places[k]
            stop = start + size + size // 2 + 5
            part = text[start:stop]
            # Most windows fall to this count, which no alignment can exceed.
            shared = sum((Counter(part) & Counter(raw)).values())
            if shared >= need:
                pairs = align(part, raw)
                if len(pairs) >= need and _named(pairs, naming):
                    first, last = start + pairs[0][0], start + pairs[-1][0] + 1
                    # A better start may follow: the next words of the template, as long as they stay in reach.
                    nxt = k + 1
                    while nxt < len(places) and places[nxt] <= first:
                        nxt += 1
                    if first > start:
                        k = nxt - 1 if places[nxt - 1] == first else nxt
                        start = first
                        pairs = align(text[start : start + size + size // 2 + 5], raw)
                        if len(pairs) < need or not _named(pairs, naming):
                            k += 1
                            continue
                        last = start + pairs[-1][0] + 1
                    best = (first, last, len(pairs))
                    for other in range(k + 1, min(k + 1 + size, len(places))):
                        again = align(text[places[other] : places[other] + size + size // 2 + 5], raw)
                        if len(again) < need or len(again) < best[2] or not _named(again, naming):
                            break
                        tight = (places[other] + again[0][0], places[other] + again[-1][0] + 1, len(again))
                        if tight[1] - tight[0] < best[1] - best[0]:
                            best = tight
                    out.append(best)
                    while k < len(places) and places[k] < best[1]:
                        k += 1
                    continue
            k += 1
        return out


def _scan(templates: list[tuple[str, str, str]], coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        low = np.zeros(1 << 16, bool)
        low[(scanner.keys >> np.uint64(48)).astype(np.int64)] = True
        for batch in batches:
            ids = batch.column("doc_id")
            rows: list[tuple] = []
            for lo, hi, buf, off in text_slices(batch.column("text")):
                h, _, _, at = words(buf, off)
                hits = np.flatnonzero(low[(h >> np.uint64(48)).astype(np.int64)])
                if hits.size and len(scanner.keys):
                    place = np.minimum(np.searchsorted(scanner.keys, h[hits]), len(scanner.keys) - 1)
                    hits = hits[scanner.keys[place] == h[hits]]
                owner = np.searchsorted(at, hits, "right") - 1
                for r in np.unique(owner):
                    inside = h[at[r] : at[r + 1]]
                    for x in scanner.row(inside, hits[owner == r] - at[r]):
                        rows.append((ids[lo + int(r)].as_py(), *x))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "license", "terms", "start_word", "end_word", "matched_words", "coverage"])

    return run


def license_notices(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, terms, start_word, end_word, matched_words, coverage): every notice of every document.

    A notice's matched words lie within one and a half template lengths. Overlapping notices count once, as the one
    with most matched words; ties go to the higher coverage, then the earlier and first-named. Words are folded.

    Null and empty texts have no notice; rows with a null doc_id are left out; repeated rows are reported each. An
    empty table, or no template, gives no rows.
    """
    return identified(docs).mapInArrow(_scan([t for t in templates if hashes(t[2])], coverage), "doc_id long, license string, terms string, start_word long, end_word long, matched_words long, coverage double")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_notices(spark.read.parquet(f"{sf_dir}/documents.parquet"))
