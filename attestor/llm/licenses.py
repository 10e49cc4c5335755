"""License scans with a trained paragraph classifier.

Sparse word n-grams (1 to 3 words) feed a softmax regression over licence families and an unknown class. It is trained
here, on paragraphs made from public licence notices and templates and on a bounded sample of corpus pieces as the
unknown class. A temperature fitted on paragraphs of templates that it was not trained on calibrates its probabilities.

Paragraphs end at blank lines; their line breaks are white space, so wrapped notices stay whole. In a paragraph, words of
licences that stand near each other make a cluster, which is asked as a whole and in windows. A predicted family counts
once one of its templates confirms it: within a stretch about as long as the template enough of its words must stand in
order; a template of few words must stand there as it is, as a sentence of its own or at the end of one.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .decontaminate import lcs_length

#: Family to notices and opening paragraphs of the licence, as they are published.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT", "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "This project is licensed under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.", "Released under the GNU GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "Licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "bsd": [
        "Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "mpl": ["Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by": [
        "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "public-domain": ["This work is dedicated to the public domain under CC0 1.0.", "Released into the public domain.", "SPDX-License-Identifier: CC0-1.0", "This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission.", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."],
}
FAMILIES = [*TEMPLATES, "unknown"]
#: Corpus paragraphs taken as the unknown class, at most.
SAMPLE_ROWS = 2_000
PROBABILITY, SIMILARITY = 0.5, 0.75
#: Words between two licence words of a cluster at most; words of the windows that it is asked in, besides the whole.
GAP, WINDOWS = 8, (12, 48)
#: Templates of fewer words must stand as they are.
SHORT = 6
#: Words of the corpus pieces that are sampled.
PIECE = 48
_TOKEN = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def tokens(paragraph: str) -> list[str]:
    return _TOKEN.findall(paragraph.lower())


def _grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


#: Words that licence paragraphs share with any prose are not features alone and don't make a paragraph worth scoring.
_COMMON = frozenset("the a an of to in and or is are be by for with this that you it as at on not under without from any other no all new use may part following work file form either 2 3 4 1 0 v".split())
#: A paragraph with none of these words has no feature that speaks for a licence.
ANCHORS = frozenset(w for group in TEMPLATES.values() for t in group for w in tokens(t)) - _COMMON


@dataclass(frozen=True)
class Model:
    index: dict[str, int]
    weight: np.ndarray
    temperature: float

    def probabilities(self, words: list[str]) -> np.ndarray:
        hit = [self.index[g] for g in _grams(words) if g in self.index]
        z = (self.weight[-1] + self.weight[hit].sum(axis=0) / max(1.0, len(hit)) ** 0.5) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()


def _made(rng: random.Random, negatives: list[list[str]], templates: dict[str, list[str]]) -> tuple[list[list[str]], list[int]]:
    """Labelled paragraphs: notices alone, with other notices' frames, cut or beside prose; and prose with stray words."""
    rows, labels = [], []
    prose = negatives or [["some", "other", "words"]]
    for k, family in enumerate(TEMPLATES):
        for text in templates[family]:
            words = tokens(text)
            for turn in range(12):
                row = list(words)
                if turn % 4 == 1:
                    row = ["copyright", str(rng.randint(1990, 2030)), *rng.choice(prose)[:3], *row]
                elif turn % 4 == 2 and len(row) > 8:
                    del row[rng.randrange(len(row))]
                elif turn % 4 == 3:
                    row = rng.choice(prose)[:2] + row + rng.choice(prose)[:2]
                rows.append(row)
                labels.append(k)
    loose = sorted(ANCHORS)
    for row in negatives:
        rows.append(row)
        labels.append(len(FAMILIES) - 1)
    for _ in range(600):  # single licence words in prose are no licence
        row = list(rng.choice(prose))[:30]
        for _ in range(rng.randint(1, 3)):
            row.insert(rng.randint(0, len(row)), rng.choice(loose))
        rows.append(row)
        labels.append(len(FAMILIES) - 1)
    return rows, labels


def _margins(w: np.ndarray, index: dict[str, int], rows: list[list[str]]) -> np.ndarray:
    z = np.repeat(w[-1:], len(rows), axis=0)
    for i, row in enumerate(rows):
        hit = [index[g] for g in _grams(row) if g in index]
        z[i] += w[hit].sum(axis=0) / max(1.0, len(hit)) ** 0.5
    return z


def _weights(rows: list[list[str]], labels: list[int], rounds: int, rate: float, decay: float) -> tuple[np.ndarray, dict[str, int]]:
    index: dict[str, int] = {}
    for row, label in zip(rows, labels):
        if label < len(FAMILIES) - 1:
            for g in sorted(_grams(row)):
                if not set(g.split()) <= _COMMON and set(g.split()) & ANCHORS:
                    index.setdefault(g, len(index))
    hits = [sorted(index[g] for g in _grams(row) if g in index) for row in rows]
    y = np.array(labels)
    ptr = np.repeat(np.arange(len(rows)), [len(h) for h in hits])
    col = np.array([c for h in hits for c in h], dtype=np.int64)
    val = np.repeat([1 / max(1.0, len(h)) ** 0.5 for h in hits], [len(h) for h in hits])
    w, m, v = np.zeros((len(index) + 1, len(FAMILIES))), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.repeat(w[-1:], len(rows), axis=0)
        np.add.at(z, ptr, w[col] * val[:, None])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = decay * w
        np.add.at(g, col, p[ptr] * val[:, None] / len(y))
        g[-1] += p.sum(axis=0) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w, index


def fit(negatives: list[list[str]], seed: int = 4, rounds: int = 200, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Weights from all templates; the temperature from a fit without every fourth template and every fifth negative,
    by its loss on those."""
    kept = {f: [t for k, t in enumerate(group) if k % 4 != 2] for f, group in TEMPLATES.items()}
    held = {f: [t for k, t in enumerate(group) if k % 4 == 2] for f, group in TEMPLATES.items()}
    w, index = _weights(*_made(random.Random(seed), [n for k, n in enumerate(negatives) if k % 5], kept), rounds, rate, decay)
    rows, labels = _made(random.Random(seed + 1), negatives[::5], held)
    z, y = _margins(w, index, rows), np.array(labels)

    def loss(temperature: float) -> float:
        s = z / temperature
        s = s - s.max(axis=1, keepdims=True)
        each = np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), y]
        known = y < len(FAMILIES) - 1
        return float(each[known].mean() + each[~known].mean())

    temperature = min(np.geomspace(0.5, 8, 41), key=loss)
    return Model(*_weights(*_made(random.Random(seed), negatives, TEMPLATES), rounds, rate, decay)[::-1], float(temperature))


_TEMPLATE_WORDS = {f: [tokens(t) for t in group] for f, group in TEMPLATES.items()}


def confirm(family: str, words: list[str], closed: list[bool]) -> tuple[float, int, int, int]:
    """(share of the closest template's words found in order, its number, first and last word of the stretch, the last
    not included): template comparison. closed: whether a sentence ends behind a word."""
    best = (0.0, -1, 0, 0)
    for k, template in enumerate(_TEMPLATE_WORDS[family]):
        n = len(template)
        if n < SHORT:
            for i in range(len(words) - n + 1):
                if words[i] == template[0] and words[i : i + n] == template and closed[i + n - 1] and (1.0, n) > (best[0], best[3] - best[2]):
                    best = (1.0, k, i, i + n)
            continue
        rare = {w for w in template if w in ANCHORS}
        width, at = n + max(2, n // 4), 0
        while at < len(words):
            part = words[at : at + width]
            if len(rare.intersection(part)) >= 0.5 * len(rare):
                share = lcs_length([w.encode() for w in template], [w.encode() for w in part]) / n
                if share > best[0] or share == best[0] and n > best[3] - best[2]:
                    best = (share, k, at, at + len(part))
            at += max(1, n // 8)
    share, k, x, y = best
    if k >= 0:  # without the words around it that add nothing
        template = [w.encode() for w in _TEMPLATE_WORDS[family][k]]
        part = [w.encode() for w in words[x:y]]
        got = lcs_length(template, part)
        while lcs_length(template, part[1:]) == got:
            part, x = part[1:], x + 1
        while lcs_length(template, part[:-1]) == got:
            part, y = part[:-1], y - 1
    return share, k, x, y


_BREAK = re.compile(r"\n[^\S\n]*\n")
_CLOSE = re.compile(r"""["'»”’)\]]*(?:[.;:!?)\]|]|\s*\n|\s*\Z)""")


def scan_text(text: str | None, model: Model) -> list[tuple[int, int, int, str, float, float, str]]:
    """(paragraph, start, end, family, probability, similarity, template) of each licence notice of one text, in order;
    notices don't overlap."""
    out: list[tuple[int, int, int, str, float, float, str]] = []
    if not text:
        return out
    low = text.lower()
    if len(low) != len(text):  # a letter that is longer in small: then the places are those of single letters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if ANCHORS.isdisjoint(_TOKEN.findall(low)):
        return out
    begin = 0
    for number, end in enumerate([*(m.end() for m in _BREAK.finditer(text)), len(text)]):
        found = list(_TOKEN.finditer(low, begin, end))
        begin = end
        words = [m.group() for m in found]
        spots = [i for i, w in enumerate(words) if w in ANCHORS]
        clusters: list[list[int]] = []
        for i in spots:
            if clusters and i - clusters[-1][1] <= GAP:
                clusters[-1][1] = i
            else:
                clusters.append([i, i])
        for first, last in clusters:
            first, last = max(0, first - 4), min(len(words), last + 5)
            if last - first < 2:
                continue
            closed = [_CLOSE.match(text, m.end()) is not None for m in found[first:last]]
            ways = [(first, last)] + [(i, min(last, i + size)) for size in WINDOWS if last - first > size for i in range(first, last - size // 2, size // 2)]
            ends = [first, *(first + i + 1 for i, c in enumerate(closed) if c), last]
            ways += [(a, b) for a, b in zip(ends, ends[1:]) if 2 <= b - a < last - first]  # its sentences
            hits: list[tuple[float, int, int, int, int, float]] = []
            for a, b in ways:
                p = model.probabilities(words[a:b])
                best = int(p.argmax())
                if FAMILIES[best] != "unknown" and p[best] >= PROBABILITY:
                    share, which, x, y = confirm(FAMILIES[best], words[a:b], closed[a - first : b - first])
                    if share >= SIMILARITY:
                        hits.append((share, y - x, a + x, best, which, float(p[best])))
            taken: list[tuple[int, int]] = []
            for share, n, at, best, which, p in sorted(hits, key=lambda h: (-h[1] * h[0], h[2], h[3], -h[5])):  # the longest first
                if all(at >= y or at + n <= x for x, y in taken):
                    taken.append((at, at + n))
                    stop = found[at + n - 1].end()
                    stop += len(re.match(r"[.)]*", text[stop : stop + 3]).group())
                    out.append((number, found[at].start(), stop, FAMILIES[best], p, share, TEMPLATES[FAMILIES[best]][which]))
    return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per licence notice: doc_id, paragraph, start, end (characters), family, probability, similarity, template.
    Null and empty texts have none, repeated rows give theirs each, an empty table gives no rows.

    One scan of all texts; the only other read is the sample of the unknown class: at most SAMPLE_ROWS pieces of PIECE
    words, cut from whole texts of documents that a hash of their id draws.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    share = min(1.0, SAMPLE_ROWS / max(1, base.count()))
    drawn = base.filter(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000)) < int(share * 1_000_000)).filter("text IS NOT NULL").select("text")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            for t in b.column(0).to_pylist():
                words = tokens(t)
                yield pa.RecordBatch.from_arrays([pa.array([" ".join(words[i : i + PIECE]) for i in range(0, len(words), PIECE)], pa.string())], ["piece"])

    found = drawn.mapInArrow(pieces, "piece string").orderBy(F.xxhash64("piece"), "piece").limit(SAMPLE_ROWS).collect()
    sample = [r["piece"].split(" ") for r in found]
    state = docs.sparkSession.sparkContext.broadcast(fit([w for w in sample if len(ANCHORS & set(w)) < 3]))
    names = ("doc_id", "paragraph", "start", "end", "family", "probability", "similarity", "template")
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            rows = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for hit in scan_text(t, state.value)]
            cols = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], list(names))

    return base.mapInArrow(run, "doc_id long, paragraph int, start int, end int, family string, probability double, similarity double, template string")
