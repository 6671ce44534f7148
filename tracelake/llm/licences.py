"""Licence scans: a word n-gram logistic regression names the family of a paragraph, templates confirm it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import table, tidied
from tracelake.llm.linededup import _mix as mix
from tracelake.llm.linededup import folded as plain
from tracelake.llm.linededup import words_of as lines_of

# Wordings in which licences are named or granted.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license, see the file LICENSE for details.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "https://creativecommons.org/licenses/by/4.0/",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "https://creativecommons.org/licenses/by-sa/4.0/",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "https://creativecommons.org/licenses/by-nc/4.0/",
    ],
    "cc0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "https://creativecommons.org/publicdomain/zero/1.0/",
    ],
}
# Names of the licences, and phrases in which a name grants one.
NAMES = {
    "mit": ["MIT License", "MIT"],
    "apache": ["Apache License 2.0", "Apache License, Version 2.0", "Apache-2.0"],
    "gpl": ["GNU General Public License", "GNU GPL v3", "GPLv2 or later", "GPL-3.0"],
    "lgpl": ["GNU Lesser General Public License", "GNU LGPL v2.1", "LGPL-3.0"],
    "agpl": ["GNU Affero General Public License", "GNU AGPL v3", "AGPL-3.0"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD-2-Clause"],
    "mpl": ["Mozilla Public License", "Mozilla Public License 2.0", "MPL 2.0"],
    "cc-by": ["Creative Commons Attribution License", "Creative Commons Attribution 4.0 International License", "CC BY 4.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution-ShareAlike 3.0 License", "CC BY-SA 4.0"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial License", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"],
    "cc0": ["Creative Commons Zero", "CC0 1.0 Universal", "CC0 public domain dedication"],
}
PHRASES = [
    "Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.", "Available under {}.", "Published under a {}.",
    "This file is covered by the {}.", "Subject to the terms of the {}.", "Use is governed by the {}.", "License: {}", "See the {} for details.", "Made available under {}.",
    "All files in this directory are under the {}.", "SPDX-License-Identifier: {}", "You may use it under the terms of the {}.",
]
# Sentences that speak of licences and grant none.
OTHERWISE = [
    "The office issues a driver's license within ten working days.",
    "License plate numbers were recorded at the gate.",
    "He said that poetic license permits it, and released the statement under pressure.",
    "A license fee is due for each copy of the program that is sold.",
    "All rights reserved. No part of this work may be reproduced without permission of the publisher.",
    "The museum of the public library is free of charge for any person under twelve.",
    "The software is version 3 of a general purpose work, published by the foundation.",
    "Students of the university library may obtain a copy at the desk.",
    "They were licensed under the old act of the state.",
    "The article compares open licenses in general, without naming one.",
]

#: Paragraphs of the corpus that are examples of no licence, at most (those of smallest hash), and copies of each wording.
SAMPLE, COPIES = 4000, 9
#: Words of a piece: a longer paragraph is looked at in pieces that overlap by half.
PIECE = 80
#: Calibrated probability of a family, and likeness to one of its templates, from which a paragraph counts.
LEAST, ALIKE = 0.5, 0.6
#: Likeness to a template from which a paragraph of the corpus is no example of no licence; it may be a notice.
DOUBT = 0.4
#: Bytes of text that are looked at a time.
AT_ONCE = 8 << 20
UNKNOWN = "unknown"
_ZEROS, _SIGNS = re.compile(b"0+"), [c.encode() for c in "\u201c\u201d\u2018\u2019\u2013\u2014\u2026\u00a9\u00ab\u00bb"]


def folded(text: str) -> bytes:
    """Lower case, numbers as 0, signs as spaces; line feeds stay."""
    out = _ZEROS.sub(b"0", plain(text))
    for c in _SIGNS:
        out = out.replace(c, b" ")
    return out


def hashes(text: str) -> np.ndarray:
    """Of the words of a text, whatever its lines."""
    return lines_of([folded(text).replace(b"\n", b" ")])[4]


def grams(e: np.ndarray, owner: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams, 1 to ``most``, that lie within one owner, and the owner of each."""
    x, out, own = mix(e), [mix(e)], [owner]
    for n in range(1, most):
        x = mix(x[:-1] * np.uint64(0x9E3779B97F4A7C15) + e[n:])
        inside = owner[n:] == owner[:-n]
        out.append(x[inside])
        own.append(owner[n:][inside])
    return np.concatenate(out), np.concatenate(own)


def gram_set(e: np.ndarray, most: int = 3) -> np.ndarray:
    return np.unique(grams(e, np.zeros(len(e), dtype=np.int64), most)[0])


def likeness(own: np.ndarray, template: np.ndarray) -> float:
    """Shared 1- and 2-grams, of the smaller side's."""
    return len(np.intersect1d(own, template, assume_unique=True)) / max(1, min(len(own), len(template)))


def pieces(counts: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of ``counts`` words, laid end to end, as pieces: line, first word and words of each."""
    many = np.maximum(1, -(-(counts - size) // (size // 2)) + 1)
    line = np.repeat(np.arange(len(counts)), many)
    first = (np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many)) * (size // 2)
    start = (np.cumsum(counts) - counts)[line] + first
    return line, start, np.minimum(size, counts[line] - first)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """Sparse multinomial logistic regression over word 1- to 3-grams; ``unknown`` is a class of its own. The vocabulary is
    that of the wordings: n-grams that none of them has weigh nothing."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0) -> None:
        self.families = [*TEMPLATES, UNKNOWN]
        self.vocabulary, self.weights, self.bias, self.temperature = vocabulary, weights, bias, temperature
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.templates = {f: [gram_set(hashes(t), 2) for t in ts] for f, ts in TEMPLATES.items()}

    def logits(self, e: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of texts, given as runs of words' hashes."""
        g, own = grams(e, np.repeat(np.arange(len(counts)), counts))
        some = self.maybe[(g & np.uint64(0xFFFF)).astype(np.int64)]
        g, own = g[some], own[some]
        at = np.minimum(np.searchsorted(self.vocabulary, g), len(self.vocabulary) - 1)
        real = self.vocabulary[at] == g
        pair = np.unique(own[real] * len(self.vocabulary) + at[real])  # an n-gram counts once
        own, at = pair // len(self.vocabulary), pair % len(self.vocabulary)
        z = np.tile(self.bias, (len(counts), 1))
        if len(own):
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            z[own[first]] += np.add.reduceat(self.weights[at], first)
        return z

    def find(self, e: np.ndarray, counts: np.ndarray) -> list[tuple[int, str, float, float]]:
        """The lines, given as runs of words' hashes, that name or grant a licence: line, family, probability of the surest
        piece, and its likeness to the nearest template of the family."""
        line, start, size = pieces(counts)
        words = e[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] if (counts > PIECE).any() else e
        p = _softmax(self.logits(words, size) / self.temperature)
        best = p.argmax(axis=1)
        hit = np.flatnonzero((best < len(self.families) - 1) & (p.max(axis=1) >= LEAST))
        surest: dict[int, int] = {}
        for k in hit.tolist():
            own = int(line[k])
            if own not in surest or p[k].max() > p[surest[own]].max():
                surest[own] = k
        out = []
        for own, k in sorted(surest.items()):
            family, grams_ = self.families[best[k]], gram_set(e[start[k] : start[k] + size[k]], 2)
            out.append((own, family, float(p[k].max()), max(likeness(grams_, t) for t in self.templates[family])))
        return out

    def predict(self, text: str) -> tuple[str, float, float]:
        """Of one paragraph: family (or unknown), probability and likeness."""
        e = hashes(text)
        found = self.find(e, np.array([len(e)])) if len(e) else []
        return found[0][1:] if found else (UNKNOWN, 0.0, 0.0)


def _fit(rows: list[tuple[np.ndarray, int]], vocabulary: np.ndarray, rounds: int, ridge: float) -> Model:
    classes = len(TEMPLATES) + 1
    n = len(rows)
    i = np.repeat(np.arange(n), [len(g) for g, _ in rows])
    j, y = np.concatenate([g for g, _ in rows]), np.array([k for _, k in rows])
    share = 1 / np.bincount(y, minlength=classes).clip(1)[y]  # classes count the same
    share[y == classes - 1] *= 5
    share /= share.sum()
    target = np.eye(classes)[y]
    by = np.argsort(j, kind="stable")
    first = np.flatnonzero(np.append(True, j[by][1:] != j[by][:-1])) if len(j) else np.zeros(0, dtype=np.int64)
    full = np.unique(i)
    starts = np.searchsorted(i, full)
    w, b, m1, m2 = np.zeros((len(vocabulary), classes)), np.zeros(classes), 0.0, 0.0
    for k in range(1, rounds + 1):
        z = np.tile(b, (n, 1))
        z[full] += np.add.reduceat(w[j], starts)
        g = (_softmax(z) - target) * share[:, None]
        gw = ridge * w
        gw[j[by][first]] += np.add.reduceat(g[i[by]], first)
        grad = np.concatenate([gw, g.sum(axis=0)[None]])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        step = 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(vocabulary, w, b)


def train(background: list[str], seed: int = 3, copies: int = COPIES, rounds: int = 120, ridge: float = 1e-4, folds: int = 3) -> Model:
    """Fits on wordings of each family, whole and in parts, alone and amid words of ``background``, against the paragraphs of
    ``background`` (in pieces; without those that resemble a template) and sentences that speak of licences.

    Wordings are those of TEMPLATES and every name in every phrase. The temperature that makes probabilities honest is set
    on phrases, sentences and paragraphs that the fit did not see: each of ``folds`` parts of them, with all their copies,
    is scored by a fit without it. (TEMPLATES are in every fit: of most there is no second wording to learn them from.)"""
    rng = np.random.default_rng(seed)
    none = len(TEMPLATES)
    known = [gram_set(hashes(t), 2) for ts in TEMPLATES.values() for t in ts]
    prose = []
    for t in background:
        e = hashes(t)
        for _, at, size in zip(*(x.tolist() for x in pieces(np.array([len(e)])))) if len(e) else ():
            piece = e[at : at + size]
            own = gram_set(piece, 2)
            if len(piece) < 4 or max(likeness(own, k) for k in known) < DOUBT:
                prose.append(piece)
    texts: list[tuple[np.ndarray, int, int]] = [(x, none, k % folds) for k, x in enumerate(prose)]

    def amid(e: np.ndarray, before: bool, after: bool) -> np.ndarray:
        a, b = (prose[int(rng.integers(len(prose)))] if prose else e[:0] for _ in range(2))
        return np.concatenate([a[: int(rng.integers(0, 30))] if before else a[:0], e, b[: int(rng.integers(0, 30))] if after else b[:0]])

    wordings = [(hashes(t), k, -1, copies) for k, ts in enumerate(TEMPLATES.values()) for t in ts]
    wordings += [(hashes(p.format(name)), k, i % folds, 2) for k, f in enumerate(TEMPLATES) for name in NAMES[f] for i, p in enumerate(PHRASES)]
    wordings += [(hashes(t), none, i % folds, copies) for i, t in enumerate(OTHERWISE)]
    for e, k, fold, times in wordings:
        for c in range(times):
            part = e[: int(rng.integers(len(e) * 2 // 3, len(e)))] if c % 3 == 1 and len(e) > 8 and k != none else e  # a long wording may be cut at its end
            texts.append((amid(part, c > 0 and c % 2 == 1, c > 0 and c % 3 > 0), k, fold))
    vocabulary = np.unique(np.concatenate([gram_set(w[0]) for w in wordings]))
    rows = []
    for e, k, fold in texts:
        g = gram_set(e)
        at = np.minimum(np.searchsorted(vocabulary, g), len(vocabulary) - 1)
        rows.append((at[vocabulary[at] == g], k, fold))
    z, y = [], []
    for f in range(folds):
        out = [(e, k) for e, k, fold in texts if fold == f]
        model = _fit([r[:2] for r in rows if r[2] != f], vocabulary, rounds, ridge)
        z.append(model.logits(np.concatenate([e for e, _ in out]), np.array([len(e) for e, _ in out])))
        y += [k for _, k in out]
    z, y = np.concatenate(z), np.array(y)
    weight = 1 / np.bincount(y, minlength=none + 1).clip(1)[y]
    loss = lambda t: -(weight * np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12)).sum()
    model = _fit([r[:2] for r in rows], vocabulary, rounds, ridge)
    model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


_FOUND = "paragraph int, start int, end int, family string, probability double, similarity double, confirmed boolean"


def _scan(model: Model):
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
    names = ["id", "paragraph", "start", "end", "family", "probability", "similarity", "confirmed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, size, held = 0, 0, []
            for hi, text in enumerate(b.column(1)):
                held.append(text.as_py() or "")
                size += len(held[-1])
                if size < AT_ONCE and hi < b.num_rows - 1:
                    continue
                owner, number, n, _, e = lines_of([folded(t) for t in held])
                rows, ids = [], []
                for k, family, p, like in model.find(e, n) if len(n) else ():
                    i, at = int(owner[k]), int(number[k])
                    lines = held[i].split("\n")
                    start = sum(map(len, lines[:at])) + at
                    ids.append(lo + i)
                    rows.append((at, start, start + len(lines[at]), family, p, like, like >= ALIKE))
                cols = list(zip(*rows)) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)
                lo, size, held = hi + 1, 0, []

    return tidied(run)


def paragraphs(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> list[str]:
    """Examples of paragraphs for training: ``sample`` different lines at most, those of smallest hash among all."""
    each = docs.select(F.explode(F.split(text, "\n", -1)).alias("t")).filter("t <> ''").select(F.xxhash64("t", F.lit(5)).alias("o"), F.length("t").alias("n"))
    # first the smallest hashes, which are small rows, then the texts that have them
    least = each.select("o").distinct().orderBy("o").limit(sample).agg(F.max("o")).first()[0]
    if least is None:
        return []
    found = docs.select(F.explode(F.split(text, "\n", -1)).alias("t")).filter((F.col("t") != "") & (F.xxhash64("t", F.lit(5)) <= F.lit(least)))
    return sorted(r["t"] for r in found.distinct().collect())


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """A row for each paragraph (line) that names or grants a licence: id, paragraph (from 0), start, end (characters of the
    text), family, probability, similarity to its nearest template, and whether that confirms it.

    The classifier scores every paragraph of every whole text, long ones in overlapping pieces of which the surest
    counts. Null and empty texts, and empty tables, give no rows; a repeated row gives its rows again; null keys are
    keys like others; other columns of ``docs`` are not looked at."""
    if model is None:
        model = train(paragraphs(docs, text, sample))
    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(_scan(model), f"id {kind}, {_FOUND}")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of all ``documents``."""
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
