"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Every template is cut into words; of the digests of its word triples the smallest of each window
is kept (winnowing), and the kept ones form an inverted index from digest to places in templates.
Of a short template all triples and pairs are kept, so that some are left where words were edited.
The index has the size of the templates, so every task holds it. A document's triples and pairs are
looked up in it: hits of one template on neighbouring diagonals are a candidate, and a banded alignment of
the template with that part of the text gives the matched words, their share of the template, and
the span they cover.

A null text counts as empty and has no match. A text of any length is looked at whole; a license
that occurs twice is reported twice; of matches that overlap only the one with the most matched
words stays, ties by template name. Repeated rows each get their matches; extra columns are never
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from promptframe.llm.registry import query, table, text_or_empty
from promptframe.llm.tokens import LETTER, NUMBER, char_classes, chunks, code_points, mixed, span_digests

# The wording of public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "BSD-disclaimer": """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.""",
    "BSD-terms": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version.""",
    "MIT": "Released under the MIT License.",
    "MIT-terms": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software.""",
    "MPL-2.0": """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


@dataclass(frozen=True)
class Settings:
    """Words of a fingerprint, windows of winnowing, words of the templates that are not winnowed (fewer
    than ``short``), the band (at most half of a template), and the least share of a template."""

    words: int = 3
    window: int = 3
    short: int = 15
    band: int = 12
    coverage: float = 0.7


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and digest (A-Z lowered) of all words (letters and digits) of the joined texts,
    the words before each text and the place of each text."""
    _, points, bounds = code_points(texts)
    points = np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)
    kind = char_classes()[points]
    inside = (kind == LETTER) | (kind == NUMBER)
    begin, end = inside.copy(), inside.copy()
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(points))]
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    begin[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begin, end, span_digests(points, begin, end), np.searchsorted(begin, bounds), bounds


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Digests of all ``k`` following words."""
    out = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + words[j:len(out) + j])
    return out


class Index:
    """Places of winnowed fingerprints in the templates, by digest."""

    def __init__(self, templates: dict[str, str], settings: Settings):
        self.names, self.settings = sorted(templates), settings
        self.words = [word_spans([templates[n]])[2] for n in self.names]
        rows, sizes = [], set()
        for t, words in enumerate(self.words):
            if len(words) < settings.short:
                for k in {min(n, len(words)) for n in (2, settings.words)} - {0}:
                    sizes.add(k)
                    rows += [(d, t, p) for p, d in enumerate(grams(words, k).tolist())]
                continue
            sizes.add(min(settings.words, len(words)))
            found = grams(words, min(settings.words, len(words)))
            last = max(1, len(found) - settings.window + 1)
            kept = {s + int(np.argmin(found[s:s + settings.window])) for s in range(last)} if len(found) else set()
            rows += [(int(found[p]), t, p) for p in sorted(kept)]
        rows.sort()
        self.sizes = sorted(sizes)
        self.digest = np.array([r[0] for r in rows], np.uint64)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, place in it, place in the text) of every fingerprint in the text."""
        for k in self.sizes:
            found = grams(words, k)
            low, high = np.searchsorted(self.digest, found), np.searchsorted(self.digest, found, "right")
            for p in np.flatnonzero(high > low).tolist():
                for r in range(low[p], high[p]):
                    yield int(self.template[r]), int(self.place[r]), p


def align(template: np.ndarray, text: np.ndarray, centre: int, band: int) -> tuple[int, int, int]:
    """Most words of the template that the text has in order within ``band`` of the diagonal where
    the template begins at ``centre``; the first and last text word of the shortest such span."""
    width = 2 * band + 1
    low = max(0, centre - band)
    near = text[low:max(0, centre + len(template) + band)].tolist()
    # cell d of row i ends before text word i + centre - band + d + 1; it holds the matched words
    # and the first of them, the later the better
    best, top = [(0, 0)] * (width + 1), (0, 0, 0, -1)
    for i, word in enumerate(template.tolist()):
        row, left = [], (0, 0)
        for d in range(width):
            j = i + centre - band + d - low
            left = max(best[d + 1], left)
            if 0 <= j < len(near) and near[j] == word:
                n, first = best[d]
                first = first if n else j
                left = max(left, (n + 1, first))
                top = max(top, (n + 1, first - j, first, j))
            row.append(left)
        best = [*row, (0, 0)]
    return top[0], top[2] + low, top[3] + low


def matches(index: Index, words: np.ndarray) -> list[tuple[int, int, float, int, int]]:
    """(template, matched words, coverage, first word, last word) without overlaps."""
    by_template: dict[int, list[tuple[int, int]]] = {}
    for t, p, q in index.hits(words):
        by_template.setdefault(t, []).append((q - p, q))
    found = []
    for t, hits in by_template.items():
        template = index.words[t]
        # a template that follows itself lies its own length off
        band = min(index.settings.band, len(template) // 2)
        hits.sort()
        group: list[tuple[int, int]] = []
        for hit in [*hits, None]:
            if hit and (not group or hit[0] - group[0][0] <= band):
                group.append(hit)
                continue
            centre = group[len(group) // 2][0]
            n, first, last = align(template, words, centre, band)
            if n and n / len(template) >= index.settings.coverage:
                found.append((t, n, n / len(template), first, last))
            group = [hit] if hit else []
    found.sort(key=lambda m: (-m[1], m[0], m[3]))
    kept: list[tuple[int, int, float, int, int]] = []
    taken = np.zeros(len(words), bool)
    for m in found:
        if not taken[m[3]:m[4] + 1].any():
            taken[m[3]:m[4] + 1] = True
            kept.append(m)
    return sorted(kept, key=lambda m: m[3])


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text",
         settings: Settings = Settings()) -> DataFrame:
    """One row per match: the id column, license, matched_words, coverage, start and end (code points)."""
    rows = docs.select(docs[id_col].alias(id_col), text_or_empty(text_col).alias("text"))
    long = T.LongType()
    schema = T.StructType([rows.schema[0], T.StructField("license", T.StringType()), T.StructField("matched_words", long),
                           T.StructField("coverage", T.DoubleType()), T.StructField("start", long),
                           T.StructField("end", long)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, settings)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for a, b in chunks(texts):
                begin, end, digest, before, bounds = word_spans(texts[a:b])
                # texts with no fingerprint of the whole chunk need no look of their own
                near = [np.flatnonzero(np.isin(grams(digest, k), index.digest)) for k in index.sizes]
                near = np.concatenate([np.zeros(0, np.int64), *near])
                some = np.unique(np.searchsorted(before, near, "right") - 1)
                for k in some.tolist():
                    s, e = before[k], before[k + 1]
                    for t, n, share, first, last in matches(index, digest[s:e]):
                        out.append((ids[a + k], index.names[t], n, share, int(begin[s + first] - bounds[k]),
                                    int(end[s + last] - bounds[k])))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (batch.column(0).type, pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                             names=schema.names)

    return rows.mapInArrow(run, schema)


@query()
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return scan(table(spark, sf_dir, "documents"))
