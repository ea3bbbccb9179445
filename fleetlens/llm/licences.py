"""Licence scans by a trained paragraph classifier (operator 9).

A paragraph is a run of lines that are not blank, so a notice wrapped over lines is read as
one.  A sparse multinomial logistic regression on word pairs and triples reads every
paragraph in sliding parts (``PARTS`` words) and gives each part a probability per licence
family and for ``unknown``.  It is trained here on the notices below and variants of them
with words dropped and put around; its unknown class on notices of licences outside the
families, on sentences that speak about licences without giving one, and on a bounded
sample of the corpus.  A temperature fitted on held-out variants calibrates it.

Where a family is likelier than every other and than unknown, and reaches
``MIN_PROBABILITY``, the family's notices are compared with the words of the part and
around it: a stretch that holds enough of one (n-grams of one to three words; cosine of
counts on the notice's side) confirms the prediction, if the classifier still says so of the
stretch with ``CONTEXT`` words on both sides ("not licensed under", "Affero", "1.1").  Of
overlapping stretches the one that holds most of its notice counts.

A part without a known pair has the bias alone, which says unknown, so only parts that
begin at a known pair are scored: the others' answer is the same.  A stretch can hold enough
of a notice only if it holds one of the notice's seeds, its most telling word pairs, so the
comparison looks at the words around seeds.

Edge cases: null or empty text has no paragraphs and no licence; ties between families go to
the first in alphabetical order; repeated rows are scanned once each; an empty table gives
no rows (the model is then trained on notices alone).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import slices, text_rows

#: The short notices by which published texts name their licence, by family.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License",
        "Apache License 2.0",
        "Apache License Version 2.0, January 2004",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "BSD License",
        "BSD 2-Clause License",
        "BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES",
    ),
    "cc_by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Creative Commons Attribution 4.0 International",
        "Creative Commons Attribution-ShareAlike 4.0 International",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc_by_nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Creative Commons Attribution-NonCommercial 4.0 International",
        "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Released into the public domain under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
        "CC0 1.0 Universal",
        "Creative Commons Zero v1.0 Universal",
        "CC0 1.0 Universal Public Domain Dedication",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "GNU GENERAL PUBLIC LICENSE",
        "GNU General Public License v3.0",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "Licensed under the GPL v3.",
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
        "You should have received a copy of the GNU General Public License along with this program. If not, see",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1 or later.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "GNU LESSER GENERAL PUBLIC LICENSE",
        "GNU LIBRARY GENERAL PUBLIC LICENSE",
        "GNU Lesser General Public License v2.1",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "Licensed under the LGPL v3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "MIT License",
        "The MIT License (MIT)",
        "Licensed under the MIT license.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License",
        "Mozilla Public License 2.0",
        "Mozilla Public License Version 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
}
TEMPLATES |= {
    "agpl": (
        "GNU AFFERO GENERAL PUBLIC LICENSE",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "GNU Affero General Public License v3.0",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "Licensed under the AGPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see",
    ),
    "cc_by_nd": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Creative Commons Attribution-NoDerivatives 4.0 International",
        "Licensed under CC BY-ND 4.0.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ),
    "epl": (
        "Eclipse Public License 2.0",
        "Eclipse Public License - v 2.0",
        "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    ),
}
#: What other published licences are named by, and sentences about licences that give none.
OTHERS = (
    "SPDX-License-Identifier: ISC", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: Unlicense", "SPDX-License-Identifier: Apache-1.1",
    "SPDX-License-Identifier: Apache-1.0", "SPDX-License-Identifier: BSL-1.0", "SPDX-License-Identifier: CDDL-1.0", "SPDX-License-Identifier: OFL-1.1",
    "SPDX-License-Identifier: Artistic-2.0", "SPDX-License-Identifier: EUPL-1.2", "SPDX-License-Identifier: MS-PL", "SPDX-License-Identifier: WTFPL",
    "SPDX-License-Identifier: Python-2.0", "SPDX-License-Identifier: CPL-1.0", "SPDX-License-Identifier: OSL-3.0", "SPDX-License-Identifier: MulanPSL-2.0",
    "Apache License Version 1.1", "Apache Software License, Version 1.0", "Licensed under the Apache License, Version 1.1.", "Boost Software License 1.0", "Common Public License 1.0",
    "IBM Public License Version 1.0", "Sun Public License Version 1.0", "European Union Public Licence v. 1.2", "Open Software License 3.0",
    "Microsoft Public License", "Academic Free License v3.0", "The Artistic License 2.0", "Common Development and Distribution License 1.0",
    "SIL Open Font License Version 1.1", "Do What The Fuck You Want To Public License", "GNU Free Documentation License Version 1.3", "Netscape Public License Version 1.1",
    "Lucent Public License Version 1.02", "Python Software Foundation License Version 2", "Mozilla Public License Version 1.0", "Mozilla Public License Version 1.1",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "This software is provided as is, without any express or implied warranty. In no event will the authors be held liable",
    "This is free and unencumbered software released into the public domain.",
    "This is not licensed under the MIT License.", "This is not licensed under the Apache License, Version 2.0.", "Not released under the BSD License.",
    "This work is not licensed under the GNU General Public License.", "The code is no longer licensed under the Mozilla Public License 2.0.",
    "We do not use the MIT License.", "It is neither under the GNU Lesser General Public License nor in the public domain.",
    "This text is free to read.", "All rights reserved.", "The license plate was lost.", "See the terms of use and the privacy policy.",
    "Version 2.0 was released in source and binary form.", "The general public is permitted to use the work.", "Permission to enter was granted by law.",
    "You may not use this file.", "The program is distributed by the author.", "A copy of the letter should be included in all copies.",
)
UNKNOWN = "unknown"

#: Bounds of the corpus sample that the unknown class is trained on (documents, texts where ids repeat, paragraphs), and
#: of its words that are put around notices.
MAX_NEGATIVE_DOCUMENTS, MAX_NEGATIVE_TEXTS, MAX_NEGATIVE_PARAGRAPHS, MAX_FILLER_WORDS = 64, 256, 4_096, 5_000
MIN_PROBABILITY = 0.5
#: Words of the parts that the classifier reads at once (short ones for headings inside other text), and of context
#: around a stretch that confirms it.
PARTS, CONTEXT = (8, 32), 4
MIN_TEMPLATE_COSINE = 0.6

#: Words that tell little: pairs with fewer of them are chosen as seeds first.
COMMON = frozenset("a all an and any are as at be but by can file for free from has if in is it later met not of on one or possible see software that the this to under use version with without work you your".split())

_WORD = re.compile(r"[A-Za-z]+|[0-9]+")


def words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(tokens: list[str]) -> Counter:
    return Counter(" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1))


def variants(rng: np.random.Generator, notice: str, filler: list[str], count: int) -> list[str]:
    """Notices as documents carry them: with words around them, dropped or put in."""
    base, out = words(notice), []
    for _ in range(count):
        w = [x for x in base if rng.random() > 0.05] or base
        around = [filler[i] for i in rng.integers(0, len(filler), int(rng.integers(0, 9)))] if filler else []
        cut = int(rng.integers(0, len(around) + 1))
        out.append(" ".join(around[:cut] + w + around[cut:]))
    return out


class Template:
    """One notice: the counts of its n-grams, the width of its windows and its seeds."""

    def __init__(self, family: int, notice: str):
        tokens = words(notice)
        self.family, self.counts = family, dict(grams(tokens))
        self.norm = sum(n * n for n in self.counts.values())
        self.width = len(tokens) + len(tokens) // 4 + 4
        pairs = sorted({g for g in self.counts if g.count(" ") == 1}, key=lambda g: (sum(w in COMMON or w.isdigit() for w in g.split()), g))
        self.seeds: set[str] = set()
        for g in pairs:  # until what holds no seed is too little
            self.seeds.add(g)
            if self.without_seeds() < MIN_TEMPLATE_COSINE:
                break

    def without_seeds(self) -> float:
        """Largest share that a text without any seed can hold."""
        free = lambda g: not any(" ".join(p) in self.seeds for p in zip(g.split(), g.split()[1:]))
        return sum(n * n for g, n in self.counts.items() if free(g)) / self.norm

    def matches(self, tokens: list[str], seeds: list[int]) -> Iterator[tuple[float, int, int]]:
        """Share, start and end of the parts that hold enough of this notice, left to right and apart; ``seeds`` are its seeds' places, in order."""
        at = 0
        while at < len(seeds):
            low, last = max(0, seeds[at] - self.width), at
            while last + 1 < len(seeds) and seeds[last + 1] - seeds[last] <= 2 * self.width:
                last += 1
            yield from self._matches(tokens[low : seeds[last] + self.width], low)
            at = last + 1

    def _matches(self, tokens: list[str], offset: int) -> Iterator[tuple[float, int, int]]:
        ends = [[g for n in (1, 2, 3) if i + 1 >= n and (g := " ".join(tokens[i + 1 - n : i + 1])) in self.counts] for i in range(len(tokens))]
        start = 0
        while start < len(tokens):
            held: Counter = Counter()
            score, best, part = 0, 0, None
            i = first = start
            while i < len(tokens) and (part is None or (best < self.norm and i < part[1] + self.width)):
                if i - first >= self.width:  # the word that leaves takes the n-grams that begin with it
                    score -= self._leave(ends, held, first, i)
                    first += 1
                for g in ends[i]:
                    if i - g.count(" ") >= first:
                        held[g] += 1
                        score += self.counts[g] if held[g] <= self.counts[g] else 0
                i += 1
                if score > best and score >= MIN_TEMPLATE_COSINE * self.norm:
                    best, part = score, (first, i)
            if part is None:
                return
            low, high = part
            own = Counter(g for k in range(low, high) for g in ends[k] if k - g.count(" ") >= low)
            while not self._leave(ends, own, low, high):  # words before the first that counts
                low += 1
            if any(g in self.seeds for k in range(low, high) for g in ends[k] if k - g.count(" ") >= low):
                yield best / self.norm, offset + low, offset + high
            start = high

    def _leave(self, ends: list[list[str]], held: Counter, first: int, end: int) -> int:
        """Take out what begins at ``first`` in the window up to ``end``; the score that goes with it."""
        lost = 0
        for k in range(first, min(first + 3, end)):
            for g in ends[k]:
                if k - g.count(" ") == first:
                    lost += self.counts[g] if held[g] <= self.counts[g] else 0
                    held[g] -= 1
        return lost


@dataclass
class Model:
    """Weights of word pairs and triples per family (unknown last), temperature, templates, and the templates by seed."""

    families: list[str]
    grams: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: list[Template]
    seeds: dict[tuple[str, str], list[int]]

    def __post_init__(self) -> None:
        self.pairs: dict[tuple[str, str], int] = {}
        self.triples: dict[tuple[str, str, str], int] = {}
        for g, i in self.grams.items():
            t = tuple(g.split())
            (self.pairs if len(t) == 2 else self.triples)[t] = i

    def features(self, tokens: list[str]) -> tuple[list[int], list[int], list[int]]:
        """(number, first word, word behind the last) of every known pair and triple, by first word."""
        found = []
        for i, pair in enumerate(zip(tokens, tokens[1:])):
            f = self.pairs.get(pair)
            if f is not None:  # the pairs of a known triple are known
                found.append((f, i, i + 2))
                f = self.triples.get((*pair, tokens[i + 2])) if i + 2 < len(tokens) else None
                if f is not None:
                    found.append((f, i, i + 3))
        return tuple(map(list, zip(*found))) if found else ([], [], [])

    def probabilities(self, features: list[int]) -> np.ndarray:
        return self._softmax(self.weights[features].sum(0) + self.bias)

    def _softmax(self, z: np.ndarray) -> np.ndarray:
        z = z / self.temperature
        e = np.exp(z - z.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    def predictions(self, features: tuple[list[int], list[int], list[int]], part: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, probabilities) of the parts of ``part`` words that begin at a known pair."""
        numbers, first, behind = features
        w = self.weights[numbers]
        starts = np.unique(first)
        begin, end = np.searchsorted(first, starts), np.searchsorted(first, starts + part)
        upto = np.concatenate([np.zeros((1, w.shape[1]), np.float64), np.cumsum(w, 0, dtype=np.float64)])
        z = upto[end] - upto[begin] + self.bias
        for k, s in enumerate(starts.tolist()):  # what begins in a part and ends behind it
            for j in range(end[k] - 1, begin[k] - 1, -1):
                if first[j] < s + part - 2:
                    break
                if behind[j] > s + part:
                    z[k] -= w[j]
        return starts, self._softmax(z)

    def notices(self, paragraph: str) -> list[tuple[str, float, float]]:
        """Family, its probability and the share of a template, for each notice in a paragraph."""
        tokens = words(paragraph)
        features = self.features(tokens)
        if not features[0]:
            return []
        told: dict[int, list[tuple[int, int]]] = {}
        for part in PARTS:
            starts, p = self.predictions(features, part)
            best = p.argmax(1)
            for k in np.flatnonzero((best < len(self.families)) & (p[np.arange(len(p)), best] >= MIN_PROBABILITY)).tolist():
                told.setdefault(int(best[k]), []).append((int(starts[k]), int(starts[k]) + part))
        if not told:
            return []
        places: dict[int, list[int]] = {}
        for i, pair in enumerate(zip(tokens, tokens[1:])):
            for t in self.seeds.get(pair, ()):
                if self.templates[t].family in told:
                    places.setdefault(t, []).append(i)
        found = [(share, low, high, self.templates[t].family) for t, at in places.items() for share, low, high in self.templates[t].matches(tokens, at)]
        taken, out = bytearray(len(tokens)), []
        for share, low, high, family in sorted(found, key=lambda m: (-m[0], m[1] - m[2], m[3], m[1])):
            if any(taken[low:high]) or not any(s < high and low < e for s, e in told[family]):
                continue
            mine = self.probabilities(self.features(tokens[max(0, low - CONTEXT) : high + CONTEXT])[0])
            if mine.argmax() == family and mine[family] >= MIN_PROBABILITY:
                taken[low:high] = b"\1" * (high - low)
                out.append((self.families[family], float(mine[family]), share))
        return out

    def scan(self, paragraph: str) -> tuple[str, float, float]:
        """Family (or unknown), its probability, and how far a template confirms it, of the likeliest notice."""
        return max(self.notices(paragraph), key=lambda f: (f[1], f[2]), default=(UNKNOWN, 1.0, 0.0))


def paragraphs(text: str) -> list[str]:
    """Runs of lines that are not blank."""
    return ["\n".join(lines) for blank, lines in groupby(text.split("\n"), lambda p: not p or p.isspace()) if not blank]


def negatives(docs: DataFrame, most: int = MAX_NEGATIVE_PARAGRAPHS) -> list[str]:
    """A bounded sample of corpus paragraphs that share no three-word run with a template."""
    known = {g for notices in TEMPLATES.values() for t in notices for g in grams(words(t)) if g.count(" ") == 2}
    # the smallest hashes make the sample the same on every run
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_NEGATIVE_DOCUMENTS)
    picked = text_rows(docs).join(F.broadcast(ids), "doc_id").orderBy("doc_id", "text").limit(MAX_NEGATIVE_TEXTS).collect()
    lines = [p for r in picked for p in r.text.split("\n") if words(p)]
    lines = [p for p in lines if known.isdisjoint(grams(words(p)))]
    return lines[:most]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(corpus_lines: list[str], per_notice: int = 60, epochs: int = 300, seed: int = 11) -> Model:
    """Full-batch gradient descent with a soft threshold (sparse weights), then a temperature on held-out variants."""
    rng = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    filler = [w for p in corpus_lines for w in words(p)][:MAX_FILLER_WORDS]
    several = lambda text: [g for g in grams(words(text)) if " " in g]
    names = {g: i for i, g in enumerate(sorted({g for f in families for t in TEMPLATES[f] for g in several(t)} | {g for t in OTHERS for g in several(t)}))}
    rows = [(k, v) for k, f in enumerate(families) for t in TEMPLATES[f] for v in [t, *variants(rng, t, filler, per_notice)]]
    unknown = [v for t in OTHERS for v in [t, *variants(rng, t, filler, per_notice // 2)]] + corpus_lines
    rows += [(len(families), p) for p in unknown]
    x = np.zeros((len(rows), len(names)), np.float32)
    for r, (_, p) in enumerate(rows):
        for g, n in grams(words(p)).items():
            if g in names:
                x[r, names[g]] = n
    y = np.array([k for k, _ in rows])
    known = np.bincount(y, minlength=len(families) + 1).astype(float)
    weight = (1 / np.maximum(known, 1))[y]
    weight /= weight.sum()
    fit = rng.random(len(rows)) < 0.8
    onehot = np.eye(len(families) + 1)[y]
    xf, onehot, weight = x[fit], onehot[fit].astype(np.float32), weight[fit, None].astype(np.float32)
    w, b = np.zeros((len(names), len(families) + 1), np.float32), np.zeros(len(families) + 1, np.float32)
    gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(epochs):
        g = (_softmax(xf @ w + b) - onehot) * weight
        dw, db = xf.T @ g, g.sum(0)
        gw += dw * dw
        gb += db * db
        w -= 0.3 * dw / np.sqrt(gw)
        b -= 0.3 * db / np.sqrt(gb)
        w = np.sign(w) * np.maximum(np.abs(w) - 2e-4, 0)
    z, held = x[~fit] @ w + b, y[~fit]
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(held)), held] + 1e-12).mean()
    temperature = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), key=loss) if len(held) else 1.0
    templates = [Template(k, t) for k, f in enumerate(families) for t in TEMPLATES[f]]
    seeds: dict[tuple[str, str], list[int]] = {}
    for i, t in enumerate(templates):
        for g in sorted(t.seeds):
            seeds.setdefault(tuple(g.split()), []).append(i)
    return Model(families, names, w, b, float(temperature), templates, seeds)


def scan_documents(docs: DataFrame) -> DataFrame:
    """Per document: paragraphs, paragraphs with a licence, the families found (joined by commas), the best family, its probability and template share."""
    model = train(negatives(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                each = [model.notices(p) for p in paragraphs(text)]
                found = [f for fs in each for f in fs]
                best = max(found, key=lambda f: (f[1], f[2]), default=(UNKNOWN, 0.0, 0.0))
                out.append((doc_id, len(each), sum(map(bool, each)), ",".join(sorted({f[0] for f in found})), *best))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=["doc_id", "n_paragraphs", "n_licensed", "families", "family", "probability", "template_share"])

    return text_rows(docs).mapInArrow(run, "doc_id long, n_paragraphs long, n_licensed long, families string, family string, probability double, template_share double")

