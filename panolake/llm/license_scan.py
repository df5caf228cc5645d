"""License scans by patience alignment of texts with license templates.

Words that occur once in both a stretch of text and a template anchor it; the longest increasing
subsequence of the anchors is kept, and the gaps between them are aligned in the same way, with common
words at their ends first. Coverage is the share of the template's words that find a partner. A text is
cut into stretches around the template's least common words, and these into windows where copies stand close,
so that several notices in one text are each found and the rest of a long text costs one pass.

Defined results: null and empty texts give no rows; repeated rows give repeated rows; a notice of under
``least`` coverage is not reported; two templates that cover one place are both reported.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panolake.llm.common import table, text_of

LEAST = 0.8
#: Notices by which public licenses are given.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_WORD = re.compile(r"[a-z0-9]+")
ROWS = "doc_id long, license string, coverage double, first_word int, last_word int, matched int"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of ``pairs``, sorted by the first, in which the second rises (patience piles)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[at], piles[at] = b, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template) of equal words, rising in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        once = {w: i for i, w in enumerate(template[c:d], c) if in_template[w] == 1 and in_text.get(w) == 1}
        anchors = rising([(i, once[w]) for i, w in enumerate(text[a:b], a) if w in once])
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            if anchors:
                todo.append((i + 1, k, j + 1, m))
        found += anchors
    return sorted(found)


def apart(hits: set[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """Of (first, last, matched) the densest that do not overlap; stretches and windows may find one notice twice."""
    taken: list[tuple[int, int, int]] = []
    for h in sorted(hits, key=lambda h: (-h[2] / max(size, h[1] - h[0] + 1), h)):
        k = bisect_left(taken, h)
        if (not k or taken[k - 1][1] < h[0]) and (k == len(taken) or h[1] < taken[k][0]):
            taken.insert(k, h)
    return taken


class Templates:
    """Templates as words, with the words that tell whether and where a text may hold one."""

    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.words = {name: words_of(text) for name, text in templates.items()}
        self.counts = {name: Counter(words) for name, words in self.words.items()}
        self.vocabulary = frozenset(w for words in self.words.values() for w in words)

    def found(self, text: str) -> Iterator[tuple[str, float, int, int, int]]:
        words = words_of(text)
        present = self.vocabulary.intersection(words)
        counts: Counter[str] | None = None
        for name, template in self.words.items():
            need = self.least * len(template)
            if sum(n for w, n in self.counts[name].items() if w in present) < need:
                continue
            counts = counts or Counter(w for w in words if w in present)
            stretches, chosen = self._stretches(words, counts, name)
            hits = {h for a, b in stretches for h in self._copies(words, a, b, name, chosen)}
            for first, last, n in apart(hits, len(template)):
                yield name, n / len(template), first, last, n

    def _copies(self, words: list[str], a: int, b: int, name: str, chosen: set[str]) -> list[tuple[int, int, int]]:
        """(first, last, matched) of every copy in a stretch.

        Words of several copies occur more than once in the whole of it and anchor nothing. So windows are
        laid where a chosen word would have its place in the template, the densest of those that cover it are
        taken while they do not overlap, and what is left is searched again. One copy alone may instead be
        that of the whole stretch, if denser.
        """
        template, found, todo = self.words[name], [], [(a, b)]
        need, size = self.least * len(template), len(template)
        slack, every = int(size / self.least) - size + 1, max(1, size // 8)
        places: dict[str, list[int]] = {}
        for j, w in enumerate(template):
            if w in chosen:
                places.setdefault(w, []).append(j)

        def hit(lo: int, hi: int) -> tuple[int, int, int] | None:
            pairs = align(words[lo:hi], template) if hi - lo >= need else []
            return (lo + pairs[0][0], lo + pairs[-1][0], len(pairs)) if len(pairs) >= need else None

        while todo:
            lo, hi = todo.pop()
            if hi - lo < need:
                continue
            votes: dict[int, Counter[int]] = {}
            for i in range(lo, hi):
                for j in places.get(words[i], ()):
                    votes.setdefault((i - j) // every, Counter())[i - j] += 1
            starts = [c.most_common(1)[0][0] for c in votes.values()]
            windows = {(max(lo, s - more), min(hi, s + size + more)) for s in starts for more in (0, slack)}
            hits = {h for w in windows if (h := hit(*w))}
            taken = apart(hits, size)
            found += taken
            if taken:
                edges = [lo - 1, *(x for h in taken for x in h[:2]), hi]
                todo += [(x + 1, y) for x, y in zip(edges[::2], edges[1::2], strict=True)]
            elif h := hit(lo, hi):
                found.append(h)
                todo += [(lo, h[0]), (h[1] + 1, hi)]
        if len(found) < 2 and (h := hit(a, b)):
            return apart({h, *found}, size)
        return sorted(found)

    def _stretches(self, words: list[str], counts: Counter[str], name: str) -> tuple[list[tuple[int, int]], set[str]]:
        """Stretches around the chosen words that are least common in the text, so many that a notice holds one of them."""
        template, own = self.words[name], self.counts[name]
        spare, chosen = len(template) - self.least * len(template), set()
        for w in sorted(own, key=lambda w: (counts.get(w, 0), w)):
            chosen.add(w)
            spare -= own[w]
            if spare < 0:
                break
        reach = 2 * len(template)
        out: list[list[int]] = []
        for i in (i for i, w in enumerate(words) if w in chosen):
            if out and i - out[-1][2] <= len(template):
                out[-1][1:] = [min(len(words), i + reach), i]
            else:
                out.append([max(0, i - reach), min(len(words), i + reach), i])
        return [(a, b) for a, b, _ in out], chosen


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per notice: license, coverage, first and last matched word of the text, matched words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, least)
        for batch in batches:
            rows = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for hit in known.found(t.as_py())]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in ROWS.split(", ")])

    return text_of(docs).mapInArrow(each, ROWS)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notices in the whole texts of ``documents``."""
    return scan(table(spark, sf_dir, "documents"))
