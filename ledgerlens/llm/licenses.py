"""License scans: an index of winnowed template fingerprints, then banded alignment."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words
from .common import texts

GRAM = 3
WINDOW = 2
COVERAGE = 0.8

#: Notices and grants as their licenses state them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
    "whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
    "permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
    "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
    "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
    "governing permissions and limitations under the License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
    "General Public License as published by the Free Software Foundation.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def _gnu(what: str, name: str, version: str) -> str:
    return (
        f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} License as "
        f"published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
    )


#: Near relatives of the above, which would otherwise be taken for them.
TEMPLATES |= {
    "gpl-2.0": _gnu("program", "General Public", "2"),
    "agpl-3.0": _gnu("program", "Affero General Public", "3"),
    "lgpl-2.0": _gnu("library", "Library General Public", "2"),
    "lgpl-2.1": _gnu("library", "Lesser General Public", "2.1"),
    "lgpl-3.0": _gnu("library", "Lesser General Public", "3"),
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
    "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
    "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
    "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
    "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is "
    "not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
    "original software. 3. This notice may not be removed or altered from any source distribution.",
    "epl-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 "
    "which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
    "which is available at https://www.eclipse.org/legal/epl-2.0/",
}
for _name, _version, _key in (
    ("General Public", "2", "gpl-2.0"),
    ("Affero General Public", "3", "agpl-3.0"),
    ("Lesser General Public", "2.1", "lgpl-2.1"),
    ("Lesser General Public", "3", "lgpl-3.0"),
):
    TEMPLATES[f"{_key}-notice"] = f"This work is licensed under the GNU {_name} License, version {_version}."
for _short, _long in (
    ("SA", "ShareAlike"),
    ("ND", "NoDerivatives"),
    ("NC", "NonCommercial"),
    ("NC-SA", "NonCommercial-ShareAlike"),
    ("NC-ND", "NonCommercial-NoDerivatives"),
):
    TEMPLATES[f"cc-by-{_short.lower()}-notice"] = f"Licensed under CC BY-{_short} 4.0."
    TEMPLATES[f"cc-by-{_short.lower()}"] = f"This work is licensed under a Creative Commons Attribution-{_long} 4.0 International License."

#: First lines of whole license texts, and identifiers of SPDX lines.
TITLES = {
    "gpl-2.0-text": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl-3.0-text": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl-2.1-text": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl-3.0-text": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl-3.0-text": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "apache-2.0-text": "Apache License Version 2.0, January 2004",
    "mpl-2.0-text": "Mozilla Public License Version 2.0",
    "epl-2.0-text": "Eclipse Public License - v 2.0",
}
SPDX = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CC0-1.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)
TEMPLATES |= TITLES | {f"spdx-{key.lower()}": f"SPDX-License-Identifier: {key}" for key in SPDX}

#: A word that a version follows, and the version; an SPDX identifier is one as a whole.
VERSION = re.compile(r"\b(version|v|license|by|sa|nd|nc|attribution|sharealike|noderivatives|noncommercial)[^a-z0-9]{1,3}(v?[0-9]+(?:\.[0-9]+)*)|\b(spdx-license-identifier): (\S+)")


def versions(template: str) -> list[re.Pattern]:
    """What a stretch must hold word for word to be taken for a template: its versions, behind the words they stand behind."""
    out = []
    for lead, number, spdx, key in VERSION.findall(template.lower()):
        words_of = [lead or spdx, number or key]
        spelled = r"[^a-z0-9]{1,3}".join(re.escape(w).replace(r"\-", r"[^a-z0-9]") for w in words_of)
        out.append(re.compile(rf"(?<![a-z0-9]){spelled}(?![a-z0-9]|[.-][a-z0-9])" if spdx else rf"(?<![a-z0-9]){spelled}(?![a-z0-9]|\.[0-9])"))
    return out


#: Words are runs of ASCII letters and digits and of bytes beyond ASCII, in lower case.
_GAPS = np.ones(256, bool)
_GAPS[128:] = False
_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def _hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, firsts = words.bounds(raw, offsets, _GAPS)
    return words.word_hashes(raw, starts, ends), starts, ends, firsts


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash of every run of ``window`` hashes (all of them, if there are fewer)."""
    if len(grams) <= window:
        return np.array([np.argmin(grams)] if len(grams) else [], np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(runs)) + window - 1 - np.argmin(runs[:, ::-1], axis=1))


class Index:
    """Fingerprints of all templates in ascending order, each with its template and place."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        column = pa.array([templates[n] for n in self.names], pa.large_string())
        self.words, keys, owner, place = [], [], [], []
        self.versions = [versions(templates[n]) for n in self.names]
        for first, raw, offsets in words.slices(column):
            hashed, _, _, firsts = _hashes(raw, offsets)
            grams, begins = words.shingles(hashed, firsts, GRAM)
            for k in range(len(offsets) - 1):
                self.words.append(hashed[firsts[k] : firsts[k + 1]])
                own = grams[begins[k] : begins[k + 1]]
                picked = winnow(own)
                keys += own[picked].tolist()
                owner += [first + k] * len(picked)
                place += picked.tolist()
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.keys = np.array(keys, np.uint64)[order]
        self.owner, self.place = np.array(owner, np.int64)[order], np.array(place, np.int64)[order]

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(place in the text, template, place in it)`` of every posting that a run of the text meets."""
        lo, hi = np.searchsorted(self.keys, grams, "left"), np.searchsorted(self.keys, grams, "right")
        at = np.flatnonzero(hi > lo)
        many = (hi - lo)[at]
        post = np.repeat(lo[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.repeat(at, many), self.owner[post], self.place[post]


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Best alignment of the whole template to a stretch of the text, word ``i`` of the template meeting words
    ``i + shift - band`` to ``i + shift + band``: ``(matched words, first matched word, last matched word)``.

    A match gains 2; a word left out on either side, inside the stretch, costs 1. Of equal alignments the earliest end wins.
    """
    width = 2 * band + 1
    low = -(1 << 30)
    # state: best score and matched words of alignments whose last matched pair is (i, j); the next pair may be any later
    # one within the band, at the cost of the words between
    score = np.full((len(template), width), low, np.int64)
    matched = np.zeros((len(template), width), np.int64)
    first = np.full((len(template), width), -1, np.int64)
    reach_score, reach_matched, reach_first = np.full(width, low), np.zeros(width, np.int64), np.full(width, -1)
    best = (low, 0, -1, -1)
    for i in range(len(template)):
        j = i + shift - band + np.arange(width)
        inside = (j >= 0) & (j < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[j[inside]] == template[i]
        # reach[d]: best of all pairs (i', j') with i' < i and j' < j, with the cost of what lies between
        go = reach_score > -i  # else it is better to begin here, leaving out i template words
        base = np.where(go, reach_score, -i)
        score[i] = np.where(same, base + 2, low)
        matched[i] = np.where(go, reach_matched, 0) + 1
        first[i] = np.where(go, reach_first, j)
        for d in np.flatnonzero(same):
            total = score[i, d] - (len(template) - 1 - i)
            if total > best[0]:
                best = (total, matched[i, d], first[i, d], j[d])
        # pass on to i + 1: the pair (i, j - 1) directly; from reach, leave out template word i (diagonal moves by one) or a text word
        next_score, next_matched, next_first = np.full(width, low), np.zeros(width, np.int64), np.full(width, -1)
        # offset d at row i + 1 is text word j + 1; pairs at row i with text word <= j sit at offsets <= d
        run = (low, 0, -1)
        for d in range(width):
            options = [(score[i, d], matched[i, d], first[i, d])]
            if d + 1 < width:
                options.append((reach_score[d + 1] - 1, reach_matched[d + 1], reach_first[d + 1]))  # same text word, one more template word
            if run[0] > low:
                options.append((run[0] - 1, run[1], run[2]))  # one more text word
            run = max(options, key=lambda o: o[0])
            next_score[d], next_matched[d], next_first[d] = run
        reach_score, reach_matched, reach_first = next_score, next_matched, next_first
    return (int(best[1]), int(best[2]), int(best[3])) if best[0] > low else (0, -1, -1)


@lru_cache(maxsize=2)
def _index(templates: tuple) -> Index:
    return Index(dict(templates))


def scan(index: Index, raw: np.ndarray, offsets: np.ndarray, coverage: float) -> Iterator[tuple]:
    """``(text, template, matched, share, start byte, end byte)`` of each stretch of a text that matches a template."""
    hashed, starts, ends, firsts = _hashes(raw, offsets)
    grams, begins = words.shingles(hashed, firsts, GRAM)
    at, template, place = index.hits(grams)
    if not len(at):
        return
    text = np.searchsorted(begins, at, "right") - 1
    diagonal = at - begins[text] - place
    order = np.lexsort((at, diagonal, template, text))
    text, template, diagonal = text[order], template[order], diagonal[order]
    band = np.array([max(2, len(w) // 8) for w in index.words])
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (template[1:] != template[:-1]) | (np.diff(diagonal) > band[template[1:]])
    groups = np.flatnonzero(new)
    found, aligned = [], {}
    for a, b in zip(groups, np.append(groups[1:], len(text))):
        k, t = int(text[a]), int(template[a])
        wanted = index.words[t]
        middle = int(diagonal[a] + diagonal[b - 1]) // 2
        width = int(band[t] + (diagonal[b - 1] - diagonal[a] + 1) // 2)
        # the words that the band can reach; equal stretches are aligned once
        begin = firsts[k] + max(0, middle - width)
        near = hashed[begin : max(begin, min(firsts[k + 1], firsts[k] + middle + len(wanted) + width))]
        key = (t, width, firsts[k] + middle - begin, near.tobytes())
        if key not in aligned:
            aligned[key] = align(wanted, near, int(firsts[k] + middle - begin), width)
        matched, first, last = aligned[key]
        stretch = last - first + 1
        first, last = first + begin - firsts[k], last + begin - firsts[k]
        if matched >= coverage * max(len(wanted), stretch) and _same_versions(index.versions[t], raw, offsets, k, starts[firsts[k] + first], ends[firsts[k] + last]):
            score = 4 * matched - len(wanted) - stretch
            found.append((k, t, matched, matched / len(wanted), int(starts[firsts[k] + first]), int(ends[firsts[k] + last]), score))
    yield from _apart(found)


def _same_versions(wanted: list[re.Pattern], raw: np.ndarray, offsets: np.ndarray, text: int, start: int, end: int) -> bool:
    if not wanted:
        return True
    # the end of the text: a few bytes more show whether a version goes on
    said = raw[start : min(end + 8, offsets[text + 1])].tobytes().decode("utf-8", "replace").lower()
    return all(p.search(said) for p in wanted)


def _apart(found: list[tuple]) -> Iterator[tuple]:
    """Of matches that share half of the shorter stretch only the one that aligns best. Kept ones are looked up by their start: those that
    can reach a match begin at most the longest kept stretch before it, and few of them lie there, as they share little."""
    found.sort(key=lambda m: (m[0], -m[6], -m[3], m[1], m[4]))
    at = 0
    while at < len(found):
        text, begins, kept, longest = found[at][0], [], [], 0
        while at < len(found) and found[at][0] == text:
            match = found[at]
            start, end = match[4:6]
            near = kept[bisect_left(begins, start - longest) : bisect_left(begins, end)]
            if not any(2 * (min(o[5], end) - max(o[4], start)) >= min(o[5] - o[4], end - start) for o in near):
                place = bisect_left(begins, start)
                begins.insert(place, start)
                kept.insert(place, match)
                longest = max(longest, end - start)
            at += 1
        yield from (m[:6] for m in sorted(kept, key=lambda m: (m[4], m[1])))


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, license, matched_words, coverage, span_start, span_end`` for each stretch of a document whose alignment to
    a template matches at least ``coverage`` of the template's words and of the stretch's; spans are in code points, the end
    excluded.

    Every run of three words of the whole text is looked up among the templates' winnowed fingerprints; hits of one template on
    diagonals closer than the band form one candidate, and only candidates are aligned. Templates are a parameter of bounded
    size, kept in each task. A template's versions (and SPDX identifiers)
    must stand in the stretch word for word. Null and empty texts have no rows, repeated rows have their matches each, of matches that share half of the
    shorter stretch only the one with most matched words against words skipped on either side is reported (of equals the one with
    the larger share, then the first by name), and an empty table gives no rows.
    """
    chosen = tuple(sorted((TEMPLATES if templates is None else templates).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(chosen)
        for batch in batches:
            for first, raw, offsets in words.slices(batch.column("text")):
                rows = []
                for k, t, matched, share, a, b in scan(index, raw, offsets, coverage):
                    head = raw[offsets[k] : a].tobytes().decode("utf-8")
                    body = raw[a:b].tobytes().decode("utf-8")
                    rows.append((batch.column("doc_id")[first + k].as_py(), index.names[t], matched, share, len(head), len(head) + len(body)))
                if rows:
                    columns = list(zip(*rows))
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    names = ["doc_id", "license", "matched_words", "coverage", "span_start", "span_end"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    schema = "doc_id long, license string, matched_words long, coverage double, span_start long, span_end long"
    return texts(docs).mapInArrow(run, schema)
