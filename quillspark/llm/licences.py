"""Operator 8: licence statements by a trained paragraph classifier.

Every line is a paragraph, and so is every join of lines that wraps a statement: lines in a
row without a blank one between them (comment marks count as blanks) that together cover a
template. A multinomial logistic regression over sparse word 1- and 2-grams
gives each a licence family or "unknown"; its temperature is calibrated on held-out variants.
A likely family is confirmed only if the paragraph covers enough of one of the family's
templates. The training table is made by rule from the templates: wording variants of each
family, and unknown paragraphs that share words with them.

A paragraph without any vocabulary word has the same features as an empty one, whose class
is unknown, so it is skipped; that changes no result.

Headings ("MIT License", "License: GPLv3") state a licence only where they are a whole line.

Defined results: null text counts as empty and has no licence; texts of any length are scanned
whole, in time that grows with their lines; of classes with equal probability the first in
``FAMILIES`` counts; null ids and repeated rows pass through one to one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, text_slices

MIN_PROBABILITY = 0.5
MIN_COVERAGE = 0.6
VARIANTS = 30
L2 = 1e-4

#: Short statements of each licence family.
TEMPLATES = {
    "MIT": [
        "released under the MIT License", "licensed under the MIT license", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "Apache-2.0": [
        "licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0",
        "released under the Apache 2.0 license",
    ],
    "BSD": [
        "released under the BSD license", "licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause",
        "licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "GPL": [
        "this work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "released under the GPL version 2", "released under the GNU GPL v2 or later", "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "AGPL": [
        "licensed under the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0-only",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "LGPL": [
        "licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "MPL-2.0": [
        "this Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "EPL": [
        "made available under the terms of the Eclipse Public License 2.0", "licensed under the Eclipse Public License", "SPDX-License-Identifier: EPL-2.0",
    ],
    "ISC": [
        "released under the ISC license", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "CC-BY": ["licensed under CC BY 4.0", "SPDX-License-Identifier: CC-BY-4.0", "this work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0": ["released under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0", "SPDX-License-Identifier: Unlicense", "dedicated to the public domain under the Unlicense", "this is free and unencumbered software released into the public domain"],
    "Proprietary": ["all rights reserved", "proprietary and confidential, unauthorized copying of this file is strictly prohibited"],
}
#: Headings and notes that state a licence where they are all that a paragraph holds.
HEADINGS = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "License: MIT", "Licence: MIT"],
    "Apache-2.0": ["Apache License", "License: Apache-2.0", "License: Apache 2.0", "Apache License Version 2.0"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "License: BSD", "License: BSD-3-Clause"],
    "GPL": ["GPLv2", "GPLv3", "License: GPLv2", "License: GPLv3", "License: GPL", "GNU General Public License", "GNU General Public License version 3", "GNU General Public License version 2"],
    "LGPL": ["LGPLv3", "License: LGPL", "GNU Lesser General Public License", "GNU Lesser General Public License version 3"],
    "AGPL": ["AGPLv3", "License: AGPLv3", "GNU Affero General Public License", "GNU Affero General Public License version 3"],
    "MPL-2.0": ["License: MPL-2.0", "Mozilla Public License", "Mozilla Public License Version 2.0"],
    "EPL": ["License: EPL-2.0", "Eclipse Public License", "Eclipse Public License - v 2.0"],
    "ISC": ["ISC License", "The ISC License", "License: ISC"],
    "CC0": ["The Unlicense", "License: CC0", "CC0 1.0 Universal"],
}
#: Words that may follow a heading of at least ``LONG_HEADING`` words, such as a date.
LONG_HEADING, AFTER_HEADING = 4, 3
#: What may not follow: here rights are told of, not kept.
TOLD = re.compile(r"all rights reserved (?=[a-z])")

#: Paragraphs that name licences or share their words without granting one.
UNKNOWN = [
    "a driving licence is needed to rent a car", "the licence plate was found on the road", "licensed doctors work in the clinic",
    "the general public was released from the duty", "version 2.0 of the film was released in the spring", "this work is under review",
    "the license fee is due in may", "she went to MIT to study physics", "apache helicopters flew under the bridge", "creative people in common places",
    "software is free to use for any person", "the foundation published a book", "permission was granted by the city",
    "rights of way are reserved for walkers", "copy the files to the other folder", "the public domain of the park is large",
    "terms and conditions apply to this offer", "the source of the river is in the north", "international attribution of goals",
    "redistribution of land was the aim", "the bar is licensed to sell beer", "and the work of the people is to be under the sun",
    "the committee has all rights reserved by law", "students at MIT protest the license fees", "a total eclipse was seen by the public",
    "in 1991 he wrote that version 2 of the GPL had been released to much debate", "ISC stands for a school in the city", "MIT and BSD are names",
]
FAMILIES = [*TEMPLATES, "unknown"]
STOP = frozenset("a an and any are as at be by for in is it may of on or that the this to was with you".split())
PREFIXES = ["", "note", "copyright 2021 acme", "this project is", "the code is", "unless noted otherwise", "all content here is", "by the authors"]


def words(paragraph: str) -> list[str]:
    return re.findall(r"[a-z]+(?:-[a-z]+)*|\d+(?:\.\d+)*", paragraph.lower())


def grams(paragraph: str) -> list[str]:
    """Content words and word pairs; stop words count only within pairs."""
    w = words(paragraph)
    return [x for x in w if x not in STOP] + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if a not in STOP or b not in STOP]


@dataclass
class Classifier:
    index: dict[str, int]
    weights: np.ndarray
    temperature: float
    vocabulary: frozenset[str]

    def probabilities(self, paragraphs: list[str]) -> np.ndarray:
        out = np.empty((len(paragraphs), len(FAMILIES)))
        for i, p in enumerate(paragraphs):
            ids = [self.index[g] for g in set(grams(p)) if g in self.index]
            out[i] = self.weights[-1] + (self.weights[ids].sum(axis=0) / np.sqrt(len(ids)) if ids else 0)
        out /= self.temperature
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def training_table(seed: int = 23) -> list[tuple[str, int]]:
    """(paragraph, family) rows, by rule from the templates and the unknown paragraphs."""
    rng = np.random.default_rng(seed)
    one = lambda xs: xs[int(rng.integers(len(xs)))]
    filler = sorted({w for u in UNKNOWN for w in words(u)})
    rows = []
    for label, family in enumerate(FAMILIES):
        for text in TEMPLATES.get(family, UNKNOWN):
            for _ in range(VARIANTS):
                w = text.split()
                if len(w) > 8:
                    w = [x for x in w if rng.random() > 0.1]
                extra = [one(filler) for _ in range(int(rng.integers(0, 6)))]
                lead = one(PREFIXES).split() if family != "unknown" else []
                rows.append((" ".join([*lead, *w, *extra]), label))
    for family, texts in HEADINGS.items():
        rows += [(text, FAMILIES.index(family)) for text in texts for _ in range(VARIANTS // 3)]
    for _ in range(4 * VARIANTS):  # words of licence statements out of any order
        pool = [x for t in TEMPLATES.values() for s in t for x in words(s) if x not in ("mit", "apache", "bsd", "gpl", "gnu", "cc", "cc0", "mozilla")]
        rows.append((" ".join(one(pool) for _ in range(int(rng.integers(1, 9)))), len(FAMILIES) - 1))
    order = rng.permutation(len(rows))
    return [rows[i] for i in order]


@lru_cache(maxsize=1)
def fitted() -> Classifier:
    """Softmax regression by gradient steps on four fifths, temperature on the held-out fifth."""
    rows = training_table()
    cut = len(rows) * 4 // 5
    index = {g: i for i, g in enumerate(sorted({g for p, _ in rows[:cut] for g in grams(p)}))}
    x = np.zeros((len(rows), len(index) + 1), np.float32)
    for row, (p, _) in zip(x, rows, strict=True):
        ids = [index[g] for g in set(grams(p)) if g in index]
        row[ids] = 1 / np.sqrt(max(1, len(ids)))
        row[-1] = 1
    y = np.eye(len(FAMILIES), dtype=np.float32)[[k for _, k in rows]]
    w = np.zeros((x.shape[1], len(FAMILIES)), np.float32)
    square = np.full_like(w, 1e-6)
    for _ in range(200):
        s = x[:cut] @ w
        p = np.exp(s - s.max(axis=1, keepdims=True))
        g = x[:cut].T @ (y[:cut] - p / p.sum(axis=1, keepdims=True)) / cut - L2 * w
        square += g * g
        w += 1.0 * g / np.sqrt(square)
    s = x[cut:] @ w

    def loss(t: float) -> float:
        z = s / t
        z = z - z.max(axis=1, keepdims=True)
        return float(-(y[cut:] * (z - np.log(np.exp(z).sum(axis=1, keepdims=True)))).sum())

    # A paragraph with nothing known to it is unknown by construction, not by chance.
    w[-1, -1] += 1.0
    used = frozenset(v for g in index for v in g.split() if v not in STOP)
    return Classifier(index, w, min(np.linspace(0.2, 3, 57), key=loss), used)


def confirmed(paragraph: str, family: str) -> bool:
    """Whether the paragraph is one of the family's headings, or holds enough word pairs of one of its templates."""
    w = words(paragraph)
    for heading in HEADINGS.get(family, []):
        h = words(heading)
        if w[: len(h)] == h and len(w) <= len(h) + (AFTER_HEADING if len(h) >= LONG_HEADING else 0):
            return True
    if family == "Proprietary" and TOLD.search(" ".join(re.findall(r"[a-z]+|[.!;)]", paragraph.lower()))):
        return False
    have = set(zip(w, w[1:], strict=False))
    for template in TEMPLATES[family]:
        t = words(template)
        want = set(zip(t, t[1:], strict=False))
        if len(want & have) >= MIN_COVERAGE * len(want):
            return True
    return False


def pairs(w: list[str]) -> set[tuple[str, str]]:
    return set(zip(w, w[1:], strict=False))


#: (family, word pairs) of each template.
WANTED = [(k, pairs(words(t))) for k, ts in TEMPLATES.items() for t in ts]
ALL_PAIRS = frozenset(p for _, want in WANTED for p in want)
#: Comment marks and quotes before and after the text of a line (a hyphen at its end may part a word).
BEFORE, AFTER = " \t\r\f\v/*#-;%<!>|\"'", " \t\r\f\v/*#;%>|\"'"
#: Words that the lines between the first and the last of a join may hold for each word pair of the template.
INNER = 2


def bare(line: str, at: int) -> tuple[str, int, int]:
    """A line without comment marks, and where it starts and ends in the text."""
    rest = line.lstrip(BEFORE)
    body = rest.rstrip(AFTER)
    start = at + len(line) - len(rest)
    return body, start, start + len(body)


def joined(lines: list[tuple[str, int, int]]) -> str:
    """Lines as one paragraph; a word that was cut at a hyphen is whole again."""
    return "".join(x if x[-1:] == "-" and x[-2:-1].isalpha() else x + " " for x, _, _ in lines).rstrip()


def wraps(run: list[tuple[str, int, int]]) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(family, lines) of the least joins of a run that cover a template, each after its extension.

    The extension takes the lines around a join as long as they cover more of the template.
    """
    if len(run) < 2:
        return []
    count = [len(words(x)) for x, _, _ in run]
    two = [ALL_PAIRS & pairs(words(joined(run[k : k + 2]))) for k in range(len(run) - 1)]
    total = frozenset().union(*two)
    out = []
    for family, want in WANTED:
        need = MIN_COVERAGE * len(want)
        if len(want & total) < need:
            continue
        hit = [want & t for t in two]
        i = 0
        while i < len(hit):
            covered: set[tuple[str, str]] = set()
            j, inner = i, 0
            while hit[i] and j < len(hit) and len(covered) < need and inner <= INNER * len(want):
                covered |= hit[j]
                j += 1
                inner += count[j]
            if len(covered) < need:
                i += 1
                continue
            while i + 1 < j and len(set().union(*hit[i + 1 : j])) >= need:
                i += 1
            first, last = i, j
            while last < len(hit) and hit[last] - covered:
                covered |= hit[last]
                last += 1
            while first and hit[first - 1] - covered:
                covered |= hit[first - 1]
                first -= 1
            out += [(family, run[first : last + 1]), (family, run[i : j + 1])]
            i = j
    return out


def statements(texts: list[str], model: Classifier) -> list[list[tuple[str, int, int]]]:
    """(family, start, end) of each confirmed licence paragraph of each text."""
    rows: list[tuple[int, int, int, str, str]] = []
    for n, text in enumerate(texts):
        at = 0
        run: list[tuple[str, int, int]] = []
        wrapped: list[tuple[str, list[tuple[str, int, int]]]] = []
        known = False
        for line in text.split("\n"):
            w = words(line)
            here = not model.vocabulary.isdisjoint(w)
            if here:
                body = line.strip()
                start = at + line.index(body)
                rows.append((n, start, start + len(body), line, ""))
            stripped = bare(line, at)
            if w:
                run.append(stripped)
                known |= here
            elif not stripped[0]:
                wrapped += wraps(run) if known else []
                run, known = [], False
            at += len(line) + 1
        wrapped += wraps(run) if known else []
        rows += [(n, lines[0][1], lines[-1][2], joined(lines), family) for family, lines in wrapped]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    taken: dict[tuple[int, str], list[tuple[int, int]]] = {}  # spans of a text and family, in order and apart
    if not rows:
        return out
    p = model.probabilities([r[3] for r in rows])
    best = p.argmax(axis=1)
    for (n, start, end, paragraph, sought), k, prob in zip(rows, best, p.max(axis=1), strict=True):
        family = FAMILIES[k]
        # Lines come first; a join adds a statement only where its family has none yet.
        if family == "unknown" or prob < MIN_PROBABILITY:
            continue
        spans = taken.setdefault((n, family), [])
        at = bisect.bisect_left(spans, (start, end))
        if sought and any(a < end and start < b for a, b in spans[max(0, at - 1) : at + 1]):
            continue
        if confirmed(paragraph, family):
            spans.insert(at, (start, end))
            out[n].append((family, start, end))
    return [sorted(found, key=lambda x: x[1:]) for found in out]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_statements, families (sorted, comma-joined) and spans (``family:start:end``)."""
    model = fitted()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            found = statements(texts, model)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([",".join(sorted({k for k, _, _ in f})) for f in found]),
                    pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in f) for f in found]),
                ],
                names=["doc_id", "n_statements", "families", "spans"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_statements long, families string, spans string")
