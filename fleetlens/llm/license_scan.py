"""Licence scan: a trained paragraph classifier, with templates to confirm it.

A paragraph is a run of non-blank lines. It is classified by its pieces: each of its lines, and
where it has several lines or is longer than any notice, overlapping windows of words as well, so
that a notice wrapped over lines stands whole in one of them. A piece's sparse features are word
1- to 3-grams from the vocabulary of the licence templates; a multinomial logistic regression over the licence families and
``unknown`` is trained on altered templates (words dropped, swapped, cut, and set among corpus
words) against a bounded sample of the corpus's own paragraphs. A temperature, fitted on
held-out alterations, calibrates the probabilities. A prediction counts as confirmed if enough
of one template's word pairs of that family stand in the piece.

Only paragraphs, and of these only pieces, that pass a gate are classified: those with an anchor, or with a
word of a template that isn't an everyday word of this corpus (``corpus_gate``, counted over all its distinct lines).
What doesn't pass has no word of any licence but everyday ones. The gate is tested on paragraphs in the JVM, so
Python sees few paragraphs of most corpora; it sees all that pass.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.text import text_of
from fleetlens.plans.shared import bounded_batches

#: Paragraphs of the corpus that ``unknown`` is trained on, at most.
SAMPLE = 3000
CONFIRM = 0.6
UNKNOWN = "unknown"

# Licence families and notices by which they are usually declared.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "This software is licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GPL v2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the LGPL version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal, dedicated to the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the copyright holder.",
        "Copyright (c) the company. All rights reserved. Confidential and proprietary.",
    ],
}
# Words that pass the gate however common they are.
ANCHORS = ["licen[cs]e", "licensed", "copyright", "permission", "redistribut", "spdx", "cc0", "rights reserved", "public domain", "creative commons"]

ANCHOR = "(?i)" + "|".join(a.replace(" ", r"\W+") for a in ANCHORS)
HAS_ANCHOR = re.compile(ANCHOR)
BLANK = r"\n\s*\n"

WORD = re.compile(r"[a-z0-9][a-z0-9.\-]*[a-z0-9]|[a-z0-9]")


def grams(text: str) -> list[str]:
    w = WORD.findall(text.lower())
    return [*w, *map(" ".join, zip(w, w[1:], strict=False)), *map(" ".join, zip(w, w[1:], w[2:], strict=False))]


def pairs(text: str) -> set[str]:
    w = WORD.findall(text.lower())
    return set(map(" ".join, zip(w, w[1:], strict=False))) or set(w)


#: Notices of up to so many words are whole in a window half as long again.
LENGTHS = (8, 16, max(len(WORD.findall(x.lower())) for t in TEMPLATES.values() for x in t))


#: A template's word is everyday if more than this share of the lines, and more than a few, have it.
EVERYDAY, FEW = 0.005, 3
#: The templates' words of two characters or more and with a letter.
OWN = {w for t in TEMPLATES.values() for x in t for w in WORD.findall(x.lower()) if len(w) > 1 and not w.isdigit() and any(map(str.isalpha, w))}


def uncommon(held: dict[str, int], lines: int) -> frozenset[str]:
    return frozenset(w for w in OWN if held.get(w, 0) <= max(FEW, EVERYDAY * lines))


def gate_words(lines: list[str]) -> frozenset[str]:
    """The templates' words that aren't everyday in the lines."""
    return uncommon(Counter(w for x in lines for w in OWN.intersection(WORD.findall(x.lower()))), len(lines))


def corpus_gate(docs: DataFrame) -> frozenset[str]:
    """The templates' words that aren't everyday in the distinct lines of the whole corpus; one count a word comes to the driver."""
    held = F.array_intersect(F.regexp_extract_all(F.lower("p"), F.lit(WORD.pattern), F.lit(0)), F.array(*map(F.lit, sorted(OWN))))
    each = corpus_lines(docs).select("h", held.alias("held")).distinct()
    n = {r["w"]: r["n"] for r in each.select(F.explode(F.array_append("held", F.lit(""))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return uncommon(n, n.get("", 0))


def gate_pattern(gate: frozenset[str]) -> str:
    """A regular expression (Java's) for lower-cased text that passes; words are told apart by their first two characters."""
    heads: dict[str, list[str]] = {}
    for w in sorted(gate):
        heads.setdefault(w[:2], []).append(rf"\Q{w[2:]}\E" if w[2:] else "")
    words = "|".join(rf"\Q{h}\E(?:{'|'.join(sorted(t, reverse=True))})" for h, t in heads.items())
    return ANCHOR.removeprefix("(?i)") + (rf"|(?<![a-z0-9])(?:{words})(?![a-z0-9])" if words else "")


def pieces(paragraph: str, gate: frozenset[str] = frozenset()) -> list[str]:
    """The lines and windows of a paragraph that pass the gate, none twice."""
    lines = [x for x in paragraph.split("\n") if x.strip()]
    out = dict.fromkeys(lines)
    words = WORD.findall(paragraph.lower())
    if len(lines) > 1 or len(words) > LENGTHS[-1] * 3 // 2:
        for n in LENGTHS:
            step = n // 2
            out |= dict.fromkeys(" ".join(words[at : at + n + step]) for at in range(0, max(len(words) - n - step, 0) + step, step))
    return [x for x in out if HAS_ANCHOR.search(x) or not gate.isdisjoint(WORD.findall(x.lower()))]


@dataclass
class Model:
    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    gate: frozenset[str] = frozenset()

    def likelihood(self, text: str) -> np.ndarray:
        """The families' probabilities: of a text's n-grams, those of the vocabulary count, each once."""
        held = sorted({i for g in grams(text) if (i := self.vocabulary.get(g)) is not None})
        z = (self.weights[held].sum(axis=0) + self.bias) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def vector(self, text: str) -> np.ndarray:
        x = np.zeros(len(self.vocabulary))
        for g in grams(text):
            if (i := self.vocabulary.get(g)) is not None:
                x[i] = 1
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.weights + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)


def alter(template: str, rng: random.Random, noise: list[str]) -> str:
    """A template as it may stand in a text: words lost or misspelt, other words around it."""
    words = template.split()
    if len(words) > 6:
        words = [w for w in words if rng.random() > 0.06]
        if rng.random() < 0.3 and len(words) > 12:
            at = rng.randrange(len(words) // 3)
            words = words[at : at + max(10, 2 * len(words) // 3)]
    around = lambda: rng.choices(noise, k=rng.randrange(6)) if noise and rng.random() < 0.5 else []
    return " ".join([*around(), *words, *around()])


def fit(unknown: list[str], seed: int = 5, per_template: int = 24) -> Model:
    """Train on altered templates and the given paragraphs; calibrate on further alterations."""
    rng = random.Random(seed)
    families = [*TEMPLATES, UNKNOWN]
    words = [w for t in unknown[:500] for w in t.split()[:50]] or ["text"]
    stop = [w for t in TEMPLATES.values() for x in t for w in x.split()]
    # texts that use the templates' words loosely are unknown too
    loose = [" ".join(rng.choices(words, k=rng.randrange(2, 30)) + rng.choices(stop, k=rng.randrange(0, 4))) for _ in range(400)]
    loose += ["A license to drive.", "The licence fee was paid.", "Ask for permission first.", "The work is permitted.", "The copyright of the song", "An artistic license was taken."] * 8
    vocabulary = {g: i for i, g in enumerate(sorted({g for t in TEMPLATES.values() for x in t for g in grams(x)}))}
    model = Model(families, vocabulary, np.zeros((len(vocabulary), len(families))), np.zeros(len(families)), 1.0)

    def rows(n: int) -> tuple[np.ndarray, np.ndarray]:
        texts = [(alter(x, rng, words), k) for k, f in enumerate(TEMPLATES) for x in TEMPLATES[f] for _ in range(n)]
        texts += [(t, len(families) - 1) for t in loose + [u for u in unknown if not re.search("|".join(ANCHORS), u, re.IGNORECASE)][:SAMPLE]]
        return np.array([model.vector(t) for t, _ in texts]), np.array([k for _, k in texts])

    x, y = rows(per_template)
    target = np.eye(len(families))[y]
    weight = 1 / np.maximum(target.sum(axis=0), 1)
    weight = (target @ weight)[:, None] * len(y) / len(families)
    for turn in range(400):
        g = (model.probabilities(x) - target) * weight / len(y)
        rate = 4.0 / (1 + turn / 200)
        model.weights -= rate * (x.T @ g + 1e-4 * model.weights)
        model.bias -= rate * g.sum(axis=0)
    x, y = rows(6)
    best = None
    for t in (0.5, 0.7, 1.0, 1.4, 2.0):
        model.temperature = t
        loss = -np.log(np.maximum(model.probabilities(x)[np.arange(len(y)), y], 1e-12)).mean()
        best = min(best or (loss, t), (loss, t))
    model.temperature = best[1]
    model.gate = gate_words(unknown)
    return model


def similarity(text: str, family: str) -> float:
    """The largest share of a template's word pairs that stand in the text."""
    have = pairs(text)
    return max((len(pairs(x) & have) / len(pairs(x)) for x in TEMPLATES.get(family, [])), default=0.0)


def classifier(model: Model):
    """Batches of paragraphs to a row for each family that their pieces get: its best piece, a confirmed one if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for b in batches:
            at, out = [], []
            for i, paragraph in enumerate(b.column("paragraph").to_pylist()):
                best: dict[str, tuple] = {}
                for t in pieces(paragraph, model.gate):
                    if t not in known:
                        p = model.likelihood(t)
                        k = int(p.argmax())
                        family = model.families[k]
                        s = similarity(t, family)
                        if len(known) > 10_000:
                            known.clear()
                        known[t] = (family != UNKNOWN and s >= CONFIRM, float(p[k]), s, family)
                    best[known[t][3]] = max(best.get(known[t][3], known[t]), known[t])
                at += [i] * len(best)
                out += best.values()
            rows = b.take(pa.array(at, pa.int64()))
            sure, probability, like, family = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("row"), rows.column("pos"), pa.array(family, pa.string()), pa.array(probability, pa.float64()), pa.array(like, pa.float64()), pa.array(sure, pa.bool_())], ["doc_id", "row", "pos", "family", "probability", "similarity", "confirmed"])

    return run


def corpus_lines(docs: DataFrame) -> DataFrame:
    """The lines ``p`` of 20 to 2,000 characters, with their hash ``h``."""
    return docs.select(F.explode(F.split(text_of(), "\n")).alias("p")).where("length(p) between 20 and 2000").withColumn("h", F.xxhash64("p"))


def sample_lines(docs: DataFrame) -> list[str]:
    """The ``SAMPLE`` distinct lines of the smallest hashes, fewer if there aren't so many.

    Only lines below a hash that about four times as many reach are sorted, so what comes to the
    driver doesn't grow with the number of tasks.
    """
    lines = corpus_lines(docs)
    different = lines.agg(F.approx_count_distinct("h")).first()[0]
    if different > 4 * SAMPLE:
        lines = lines.where(F.col("h") < F.lit(-(2**63) + 2**64 * 4 * SAMPLE // different))
    return [r["p"] for r in lines.distinct().orderBy("h", "p").limit(SAMPLE).collect()]


def scan_paragraphs(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The paragraphs that pass the gate, each with the families predicted for its pieces.

    Returns ``doc_id, row, pos, family, probability, similarity, confirmed``, a row for each
    paragraph and family; ``row`` tells rows of one id apart within a run.
    """
    bounded_batches(docs.sparkSession)
    if model is None:
        model = fit(sample_lines(docs))
        model.gate = corpus_gate(docs)
    passes = lambda c: F.lower(c).rlike(gate_pattern(model.gate))
    found = docs.select("doc_id", text_of().alias("text")).where(passes("text"))
    found = found.select("doc_id", F.monotonically_increasing_id().alias("row"), F.posexplode(F.split("text", BLANK)).alias("pos", "paragraph")).where(passes("paragraph"))
    return found.mapInArrow(classifier(model), "doc_id long, row long, pos int, family string, probability double, similarity double, confirmed boolean")


def scan_licenses(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The licence of each document.

    Input ``docs(doc_id, text, ...)``; other columns are ignored. Null and empty texts have no
    licence. Of several confirmed paragraphs the most probable counts, then the first. Rows
    with one id are one document. An empty table gives an empty result.

    Returns ``doc_id, license`` (null without a confirmed paragraph), ``families`` (all confirmed
    ones), ``n_candidates`` (paragraphs that pass the gate), ``n_confirmed``, ``probability``.
    """
    p = scan_paragraphs(docs, model)
    # by paragraph first, so that a document's paragraphs are counted and not gathered
    sure = F.col("confirmed")
    one = p.groupBy("doc_id", "row", "pos").agg(
        F.max(F.when(sure, F.struct("probability", -F.col("pos"), "family"))).alias("best"), F.collect_set(F.when(sure, F.col("family"))).alias("families"), F.bool_or(sure).alias("sure")
    )
    per = one.groupBy("doc_id").agg(
        F.max("best")["family"].alias("license"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))).alias("families"),
        F.count(F.lit(1)).cast("int").alias("n_candidates"), F.count_if("sure").cast("int").alias("n_confirmed"), F.max("best")["probability"].alias("probability"),
    )
    out = docs.select("doc_id").distinct().join(per.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return out.select("doc_id", "license", F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), "probability")
