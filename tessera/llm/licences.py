"""Licence scan: a trained paragraph classifier, an unknown class by calibration, and a comparison with templates.

Paragraphs (lines, and runs of lines that hold a wrapped notice) become sparse vectors of hashed one- and two-word n-grams. A multinomial logistic regression, trained
on varied templates of each family against ordinary paragraphs of a bounded sample of the corpus, proposes a family. The least
probability that a proposal needs is set on held-out variants; a proposal must also share half of the n-grams of one of the
family's templates. What looks like a licence but passes neither test is `unknown`.
"""

from __future__ import annotations

import itertools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import text_runs

# Usual notices of the licence families.
TEMPLATES: dict[str, list[str]] = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work and dedicated it to the public domain.",
        "Released under CC0 1.0 Universal, public domain dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "Copyright. All rights reserved. No part of this work may be reproduced without written permission.",
        "All rights reserved.",
        "This work is proprietary and may not be redistributed.",
    ],
}
NONE, UNKNOWN = "none", "unknown"
BITS = 14
#: Ordinary paragraphs for training come from about so many documents, chosen by a hash of doc_id.
TRAIN_DOCS = 1000
#: ... and at most so many lines of theirs are used.
TRAIN_LINES = 1000
VARIANTS = 30
LEAST_SHARED = 0.5
#: A wrapped notice is looked for in lines of so many times the longest template's words.
MOST_WORDS = 1.5
#: An unknown licence has so many different words that only licences have.
LEAST_CUES = 2
_WORD = re.compile(r"[^\W_]+(?:[.+][^\W_]+)*")


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams_of(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _cell(gram: str) -> int:
    h = 1469598103934665603
    for c in gram.encode():
        h = ((h ^ c) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return (h ^ (h >> 29)) & ((1 << BITS) - 1)


def vector_of(words: list[str]) -> np.ndarray:
    """Cells of the paragraph's distinct n-grams; each counts once, scaled by the root of their number."""
    return np.unique(np.array([_cell(g) for g in set(grams_of(words))], dtype=np.int64))


@dataclass
class Model:
    families: list[str]
    weights: np.ndarray  # cells x (families + none)
    bias: np.ndarray
    least: float  # probability that a family needs
    least_any: float  # 1 - probability of `none` that `unknown` needs
    cues: frozenset[str]  # words of the templates that ordinary paragraphs of the sample don't have
    templates: dict[str, list[frozenset[str]]]

    def classify(self, paragraph: str) -> tuple[str, float]:
        """The family, `unknown` or `none`, and its probability."""
        return self.classify_words(words_of(paragraph))

    def classify_words(self, words: list[str]) -> tuple[str, float]:
        if self.cues.isdisjoint(words):
            return NONE, 1.0
        p = self._probability(vector_of(words))
        best = int(p[:-1].argmax())
        family, grams = self.families[best], set(grams_of(words))
        if p[best] >= self.least and self.nearest(family, grams)[0] >= LEAST_SHARED:
            return family, float(p[best])
        some = 1 - p[-1] >= self.least_any and len(self.cues.intersection(words)) >= LEAST_CUES
        return (UNKNOWN, float(1 - p[-1])) if some else (NONE, float(p[-1]))

    def nearest(self, family: str, grams: set[str]) -> tuple[float, frozenset[str]]:
        """The family's template that shares most of its n-grams, after that share."""
        return max(((len(t & grams) / len(t), t) for t in self.templates[family]), key=lambda x: x[0])

    def scan(self, lines: list[str]) -> list[tuple[int, str, float, str]]:
        """(number of the first line, family or `unknown`, probability, text) of the notices in a text's lines.

        A notice is a line, or a run of lines that no line without words parts: a notice wrapped over them, with or without
        comment marks. A line that is a part of a wrapped notice isn't one of its own.
        """
        words = [words_of(x) for x in lines]
        cue = [not self.cues.isdisjoint(w) for w in words]
        if not any(cue):
            return []
        found = {k: self.classify_words(w) for k, w in enumerate(words) if cue[k]}
        most = MOST_WORDS * max(len(words_of(t)) for ts in TEMPLATES.values() for t in ts)
        out, k = [], 0
        while k < len(lines) - 1:
            best = None
            if cue[k] or cue[k + 1] and words[k]:
                run, j = list(words[k]), k + 1
                while j < len(lines) and words[j] and len(run) + len(words[j]) <= most:
                    run += words[j]
                    j += 1
                    family, p = self.classify_words(run)
                    if family not in (NONE, UNKNOWN):
                        share, template = self.nearest(family, set(grams_of(run)))
                        if best is None or share > best[0]:
                            best = (share, template, family, p, j)
            # a line that is a notice alone needs no others
            if best is None or any(found[i][0] == best[2] and self.nearest(best[2], set(grams_of(words[i])))[0] >= best[0] for i in range(k, best[4]) if i in found):
                k += 1
                continue
            _, template, family, p, end = best
            for i in range(k, end):
                own = found.get(i, (NONE, 0.0))[0]
                if own not in (NONE, UNKNOWN):
                    grams = set(grams_of(words[i]))
                    grams &= self.nearest(own, grams)[1]
                if own == UNKNOWN or own != NONE and 2 * len(grams & template) >= len(grams):
                    del found[i]
            out.append((k, family, p, "\n".join(lines[k:end])))
            k = end
        out += [(k, family, p, lines[k]) for k, (family, p) in found.items() if family != NONE]
        return sorted(out)

    def _probability(self, cells: np.ndarray) -> np.ndarray:
        z = self.weights[cells].sum(axis=0) / np.sqrt(max(1, len(cells))) + self.bias
        e = np.exp(z - z.max())
        return e / e.sum()


def _variants(text: str, filler: list[str], rng: random.Random) -> list[list[str]]:
    words = words_of(text)
    out = [words]
    for _ in range(VARIANTS - 1):
        n = len(words)
        a = rng.randint(0, max(0, n // 5)) if n > 8 else 0
        part = words[a : n - rng.randint(0, n // 5) if n > 8 else n]
        part = [w for w in part if n <= 8 or rng.random() > 0.08]
        if filler and rng.random() < 0.4:
            part = rng.sample(filler, min(len(filler), rng.randint(1, 12))) + part
        if filler and rng.random() < 0.4:
            part = part + rng.sample(filler, min(len(filler), rng.randint(1, 12)))
        out.append(part)
    return out


def _of_a_notice(words: list[str], templates: list[frozenset[str]]) -> bool:
    """Whether a line holds most of a template, or is itself a piece of one."""
    grams = set(grams_of(words))
    return any(len(t & grams) >= LEAST_SHARED * (min(len(t), len(grams)) if len(words) >= 4 else len(t)) for t in templates)


def fit(ordinary: list[str], seed: int = 1) -> Model:
    """The model for the templates against the given ordinary paragraphs."""
    rng = random.Random(seed)
    families = sorted(TEMPLATES)
    templates = {f: [frozenset(grams_of(words_of(t))) for t in ts] for f, ts in TEMPLATES.items()}
    every = [t for ts in templates.values() for t in ts]
    plain = [w for w in map(words_of, ordinary) if w and not _of_a_notice(w, every)]
    met = {w for p in plain for w in p}
    cues = frozenset({w for ts in TEMPLATES.values() for t in ts for w in words_of(t)} - met)
    filler = sorted(met)
    rows, labels = [], []
    for k, f in enumerate(families):
        for t in TEMPLATES[f]:
            for v in _variants(t, filler, rng):
                rows.append(vector_of(v))
                labels.append(k)
    # ordinary paragraphs, and such with a stray word of the templates in them
    stray = sorted(cues)
    for p in plain or [["text"]]:
        rows.append(vector_of(p))
        labels.append(len(families))
        mixed = [rng.choice(stray) if rng.random() < 0.03 else w for w in p]
        rows.append(vector_of([*mixed, rng.choice(stray)]))
        labels.append(len(families))
    y = np.array(labels)
    place = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cell = np.concatenate(rows)
    size = np.sqrt(np.maximum(1, np.bincount(place, minlength=len(rows))))
    held = np.array([rng.random() < 0.2 for _ in rows])
    share = np.bincount(y, minlength=len(families) + 1)
    w = np.where(held, 0.0, 1.0 / np.maximum(1, share)[y])
    w /= w.sum()
    used, col = np.unique(cell, return_inverse=True)
    weights, bias = np.zeros((len(used), len(families) + 1)), np.zeros(len(families) + 1)
    target = np.eye(len(families) + 1)[y]

    def scores() -> np.ndarray:
        z = np.zeros((len(rows), len(families) + 1))
        for c in range(z.shape[1]):
            z[:, c] = np.bincount(place, weights[col, c], minlength=len(rows))
        z = z / size[:, None] + bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    rate = 60.0
    for step in range(150):
        d = (target - scores()) * w[:, None]
        bias += rate * 0.05 * d.sum(axis=0)
        pull = (d / size[:, None])[place]
        for c in range(weights.shape[1]):
            weights[:, c] += rate * np.bincount(col, pull[:, c], minlength=len(used))
        weights *= 1 - 1e-4
    p = scores()[held]
    truth, best = y[held], p[:, :-1].argmax(axis=1)
    top = p[np.arange(len(p)), best]
    # the least probability at which held-out proposals are right 199 times in 200
    least = 0.5
    for t in np.arange(0.3, 0.96, 0.05):
        proposed = top >= t
        if proposed.any() and (best[proposed] == truth[proposed]).mean() >= 0.995:
            least = float(t)
            break
    # more than all but one in a thousand ordinary paragraphs that were held out
    other = 1 - p[truth == len(families), -1]
    least_any = max(0.5, float(np.quantile(other, 0.999))) if len(other) else 0.5
    full = np.zeros((1 << BITS, len(families) + 1))
    full[used] = weights
    return Model(families, full.astype(np.float32), bias, least, least_any, cues, templates)


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    n = max(1, docs.count())
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, train_docs / n) * (1 << 20)))
    lines = chosen.select(F.explode(F.split("text", "\n")).alias("line")).filter("trim(line) <> ''")
    some = lines.select("line").distinct().orderBy(F.xxhash64("line"), "line").limit(TRAIN_LINES)
    return fit([r["line"] for r in some.collect()])


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        types = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.string()]
        for batch in batches:
            for a, b in text_runs(batch.column("text")):
                rows = []
                for doc, text in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), batch.column("text").slice(a, b - a).to_pylist(), strict=True):
                    # numbered are the lines that aren't blank; blank ones part the paragraphs
                    every = (text or "").split("\n")
                    number = list(itertools.accumulate(map(bool, map(str.strip, every)), initial=0))
                    rows += [(doc, number[k], family, p, notice) for k, family, p, notice in model.scan(every)]
                    rows.append((doc, number[-1], None, None, None))  # one row that counts the paragraphs
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "paragraph", "family", "p", "text"])

    return run


def licence_paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, paragraph, family, p, text) of every line, or run of lines, that is a licence notice, and for each row of docs one row
    without family whose `paragraph` is the number of its paragraphs (lines that aren't blank)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_scan(shared), "doc_id long, paragraph int, family string, p double, text string")


def licence_scan(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Per doc_id: n_paragraphs, n_licences (paragraphs with a family or unknown), families (sorted, comma-joined), least_p.

    Null and empty texts have no paragraphs and families ''; rows with one doc_id are summed up together; notices wrapped
    over several lines count once; an empty table gives no rows and other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    found = licence_paragraphs(docs, train(docs, train_docs))
    hit = F.col("family").isNotNull()
    return found.groupBy("doc_id").agg(
        F.sum(F.when(~hit, F.col("paragraph"))).alias("n_paragraphs"),
        F.count_if(hit).alias("n_licences"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.round(F.min("p"), 6).alias("least_p"),
    )
