"""License notices in texts: winnowed fingerprints, then banded alignment.

A template's words are cut into grams; of each window of neighbouring grams the least hash is
its fingerprint. An inverted index of all templates' fingerprints, whose size the templates
bound, goes to every task. A text's own fingerprints name the templates that may be in it and
where. Around those places the template is aligned with the text in a band of diagonals, and
the share of its words that match in order is the coverage that is reported, with the span.
What lies beside an alignment is aligned again, so a notice that is repeated is found each time.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_engine.llm.common import small_batches

GRAM = 3
#: Fingerprints are the least of so many neighbouring grams: a run of GRAM + WINNOW - 1 words
#: that a text shares with a template always gives one.
WINNOW = 2
COVERAGE = 0.7
#: Words by which a text may run ahead or behind within a notice.
BAND = 12
_GAP = 0.25

# The notices that licenses ask to be put into files, by identifier.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse or promote products derived from this software without specific prior "
        "written permission.",
        "Licensed under the BSD 3-Clause License.",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If "
        "a copy of the MPL was not distributed with this file, You can obtain one at",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License, Version 2.0.",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event "
        "will the authors be held liable for any damages arising from the use of this software.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
        "International License.",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or "
        "neighboring rights to this work.",
        "Licensed under CC0 1.0 Universal.",
        "Creative Commons Zero v1.0 Universal",
    ),
}
_CREATIVE = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_PORTS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}
for _version, _port in _PORTS.items():
    for _code, _name in _CREATIVE.items():
        TEMPLATES[f"CC-{_code}-{_version}"] = (
            f"This work is licensed under a Creative Commons {_name} {_version} {_port} License.",
            f"Licensed under CC {_code} {_version}.",
            f"Creative Commons {_name} {_version} {_port}",
            f"CC {_code} {_version}",
        )

_WORD = re.compile(r"[^\W_]+")
#: What may not follow a tag's identifier: the rest of another one, such as MIT-0.
_GOES_ON = re.compile(r"[-.](?!(?:only|or-later)\b)\w")

SCHEMA = (
    "key {key}, license string, variant int, coverage double, matched long, "
    "start long, stop long, first_word long, last_word long"
)


def grams(ids: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM words."""
    n = len(ids) - GRAM + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """Places of the least hash in each window of WINNOW grams; fewer grams are one window."""
    if len(hashes) <= WINNOW:
        return np.array([int(hashes.argmin())]) if len(hashes) else np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, WINNOW)
    return np.unique(windows.argmin(axis=1) + np.arange(len(windows)))


def _scored(
    template: np.ndarray, text: np.ndarray, low: int, high: int
) -> tuple[np.ndarray, np.ndarray]:
    """Scores and steps of all alignments within the diagonals text - template = low..high."""
    width = high - low + 1
    places = np.arange(width)
    score = np.zeros((len(template) + 1, width))
    step = np.zeros((len(template) + 1, width), np.int8)
    for i, word in enumerate(template):
        at = i + low + places
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[at[inside]] == word
        across = score[i] + np.where(same, 1.0, -2 * _GAP)
        # Skipping a word of the template moves to the next lower diagonal.
        skip = np.append(score[i][1:] - _GAP, -np.inf)
        best = np.maximum(np.maximum(across, skip), 0)
        run = np.maximum.accumulate(best + _GAP * places) - _GAP * places
        score[i + 1] = run
        step[i + 1] = np.select(
            [run > best, (best == across) & same, best == skip, best == across], [3, 1, 2, 4], 0
        )
    return score, step


def _spots(step: np.ndarray, low: int, i: int, j: int) -> list[tuple[int, int]]:
    """(template, text) places of the words that match on the way to a cell, last first."""
    spots: list[tuple[int, int]] = []
    while i > 0 and step[i, j]:
        kind = step[i, j]
        if kind == 3:
            j -= 1
        elif kind == 2:
            i, j = i - 1, j + 1
        else:
            if kind == 1:
                spots.append((i - 1, i - 1 + low + j))
            i -= 1
    return spots


def aligned(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, ...]:
    """Best alignment within the diagonals text - template = low..high.

    A match counts 1, a skipped word of either side costs a little. Returns matched words,
    first and last matched word of the text, first and last one of the template (-1: none).
    """
    score, step = _scored(template, text, low, high)
    spots = _spots(step, low, *np.unravel_index(int(score.argmax()), score.shape))
    if not spots:
        return 0, -1, -1, -1, -1
    (last_t, last), (first_t, first) = spots[0], spots[-1]
    return len(spots), int(first), int(last), int(first_t), int(last_t)


def all_aligned(
    template: np.ndarray, text: np.ndarray, low: int, high: int, places: np.ndarray, least: float
) -> list[tuple[int, int, int]]:
    """(matched, first, last) of alignments that share no word, best first, in the diagonals.

    Each has `least` matches or more. What lies between those found is aligned again, as long
    as it holds one of `places`, where grams of the template begin.
    """
    found, todo = [], [(max(0, low), min(len(text), high + len(template)))]
    while todo:
        a, b = todo.pop()
        if b - a < least or np.searchsorted(places, a) == np.searchsorted(places, b - GRAM + 1):
            continue
        bottom, top = max(low, a - len(template)) - a, min(high, b) - a
        score, step = _scored(template, text[a:b], bottom, top)
        cells = np.flatnonzero(step == 1)
        cells = cells[np.argsort(-score.ravel()[cells], kind="stable")]
        rows, columns = np.unravel_index(cells, score.shape)
        used, own = np.zeros(b - a, bool), []
        for i, j in zip(rows.tolist(), columns.tolist(), strict=True):
            if used[i - 1 + bottom + j]:
                continue
            spots = _spots(step, bottom, i, j)
            first, last = spots[-1][1], spots[0][1]
            if used[first : last + 1].any():
                continue
            if len(spots) < least:
                break
            used[first : last + 1] = True
            own.append((len(spots), a + int(first), a + int(last)))
        if own:
            found += own
            ends = sorted((first, last) for _, first, last in own)
            starts = [a] + [last + 1 for _, last in ends]
            todo += zip(starts, [first for first, _ in ends] + [b], strict=True)
    return found


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        self.words: dict[str, int] = {}
        self.templates, self.names, self.tags = [], [], set()
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for name, variants in templates.items():
            # An SPDX tag names the identifier itself; it is the last variant.
            tag = f"SPDX-License-Identifier: {name}"
            self.tags.add(len(self.templates) + len(variants))
            for variant, text in enumerate((*variants, tag)):
                words = _WORD.findall(text.lower())
                ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in words])
                hashes = grams(ids)
                for place in winnowed(hashes).tolist():
                    self.index[int(hashes[place])].append((len(self.templates), place))
                self.templates.append(ids)
                self.names.append((name, variant))
        self.known = np.array(sorted(self.index), np.uint64)

    def scan(self, text: str, coverage: float = COVERAGE) -> list[tuple]:
        """(license, variant, coverage, matched, start, stop, first word, last word), in order."""
        lower = text.lower()
        words = _WORD.findall(lower)
        ids = np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words))
        # A gram of a template has known words only.
        if len(ids) < GRAM or not np.convolve(ids > 0, np.ones(GRAM), "valid").max() >= GRAM:
            return []
        hashes = grams(ids)
        places = winnowed(hashes)
        places = places[np.isin(hashes[places], self.known)]
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for place in places.tolist():
            for template, own in self.index[int(hashes[place])]:
                hits[template].append((place - own, place))
        found = []
        for template, spots in hits.items():
            ids_t = self.templates[template]
            spots.sort()
            begins = np.unique([place for _, place in spots])
            least = len(ids_t) if template in self.tags else coverage * len(ids_t)
            groups: list[list[int]] = []
            for diagonal, _ in spots:
                if groups and diagonal - groups[-1][1] <= BAND:
                    groups[-1][1] = diagonal
                else:
                    groups.append([diagonal, diagonal])
            for low, high in groups:
                band = low - BAND, high + BAND
                for best in all_aligned(ids_t, ids, *band, begins, least):
                    found.append((template, *best))
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(lower)]
        if len(lower) != len(text):
            # Letters that become several in lower case: back to the places in the text.
            origin = [i for i, c in enumerate(text) for _ in c.lower()]
            spans = [(origin[a], origin[b - 1] + 1) for a, b in spans]
        found = [f for f in found if f[0] not in self.tags or self.is_tag(text, spans, f)]
        # Of overlapping notices the one with more matched words is reported, of equal ones the
        # one that is covered best: CC BY-NC is also most of CC BY-NC-SA.
        taken: list[tuple] = []
        used = np.zeros(len(ids), bool)
        found.sort(key=lambda f: (-f[1], len(self.templates[f[0]]), f[2], f[0]))
        for template, matched, first, last in found:
            if not used[first : last + 1].any():
                used[first : last + 1] = True
                name, variant = self.names[template]
                share = matched / len(self.templates[template])
                start, stop = spans[first][0], spans[last][1]
                taken.append((name, variant, share, matched, start, stop, first, last))
        return sorted(taken, key=lambda t: t[6])


    def is_tag(self, text: str, spans: list[tuple[int, int]], hit: tuple) -> bool:
        """Whether a tag stands there word for word, and its identifier ends there."""
        template, _, first, last = hit
        whole = last - first + 1 == len(self.templates[template])
        return whole and not _GOES_ON.match(text, spans[last][1])


def notices(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    templates: dict[str, tuple[str, ...]] = TEMPLATES, coverage: float = COVERAGE,
) -> DataFrame:
    """One row per notice in a text: key, license, variant, coverage, matched words, start and
    stop (characters of the text), first_word and last_word.

    An SPDX tag (`SPDX-License-Identifier: MIT`) of a license in `templates` is a notice, too,
    as the variant after its own; of an expression of several the first is reported. It has to
    stand word for word.

    Null and empty texts, and texts without a notice, have no rows; equal rows are reported
    each. Other columns are not read. An empty table gives no rows. Whole texts are scanned,
    one at a time, without a shuffle.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = SCHEMA.format(key=rows.schema["key"].dataType.simpleString())
    names = [column.split(" ")[0] for column in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            at, found = [], []
            for i, body in enumerate(batch.column("text").to_pylist()):
                if body:
                    for notice in scanner.scan(body, coverage):
                        at.append(i)
                        found.append(notice)
            columns = list(zip(*found, strict=True)) if found else [()] * 8
            kinds = [pa.string(), pa.int32(), pa.float64()] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(at, pa.int64()))]
                + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names,
            )

    return rows.mapInArrow(scan, schema)
