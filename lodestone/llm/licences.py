"""License scans: a trained paragraph classifier with an unknown class, confirmed against templates.

Every paragraph (line with a word) of every text gets hashed word 1- and 2-gram features and is scored by a multinomial
logistic regression over licence families and "none". Probabilities are calibrated by a temperature fitted on held-out
rows; below `sure` the answer is unknown. A family counts as found only if the paragraph also holds enough of one of the
family's templates (share of the template's word pairs).

Notices that are wrapped over lines or lie inside a longer text are looked for in blocks, the lines between blank ones:
wherever WINDOW words in a row hold enough of a template's word pairs, the shortest spans with the most of them are scored
and confirmed like a paragraph. Paragraphs of more than WINDOW words are also scored in overlapping windows. What is found
counts for every paragraph that the span or window touches.

Training rows: the templates, with words dropped and corpus words around them, by a seeded generator; and at most
10 * `negative_docs` paragraphs (of up to 5000 characters) of that many documents, drawn by hashes, that resemble no
template. These bounds are parameters; the scan covers every paragraph of every document.

Defined cases: a null or blank text has no paragraphs; paragraphs of any length are scored as a whole too; repeated rows stay
repeated; an empty table trains without corpus words and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, pieces, to_bytes
from .shards import batch_of

FEATURES = 1 << 12
NEGATIVE_DOCS = 300
SURE, CONFIRM = 0.6, 0.6
NONE = "none"
#: Words in a row that are searched for a template at once; twice the longest template and more.
WINDOW = 48

#: Short public notices by family.
TEMPLATES = {
    "agpl": ["This program is free software under the GNU Affero General Public License", "Licensed under the GNU Affero General Public License, version 3."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Released under Apache-2.0."],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under the BSD License.", "Licensed under the BSD 3-Clause License."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights", "This work is dedicated to the public domain under CC0 1.0."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "Released under GPL-3.0."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License.", "Licensed under the ISC license."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software under the terms of the GNU Lesser General Public License"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Licensed under the MIT License."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part may be reproduced without permission."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable", "Released under the zlib License."],
}
_MARKS = b".,;:()\"'[]!?"

_code = zlib.crc32


def blocks(text: bytes | None) -> tuple[list[list[bytes]], list[int]]:
    """The words of every line that has one, and the number of its block: blank lines part blocks."""
    lines, numbers, block = [], [], 0
    for line in text.lower().translate(None, _MARKS).split(b"\n") if text else ():
        if words := line.split():
            lines.append(words)
            numbers.append(block)
        else:
            block += 1
    return lines, numbers


def paragraphs(text: bytes | None) -> list[list[bytes]]:
    """The words of every line that has one."""
    return blocks(text)[0]


def features(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all paragraphs in a row, and where each paragraph's begin."""
    lengths = np.array([len(w) for w in words])
    flat = np.array([_code(w) for p in words for w in p], np.int64)
    first = np.cumsum(lengths) - lengths
    pair = (31 * flat[:-1] + flat[1:] + 7) % FEATURES
    # A paragraph of n words has n single words and n - 1 pairs; interleave them, so that its features are together.
    out = np.empty(2 * len(flat), np.int64)
    out[0::2], out[1:-1:2] = flat % FEATURES, pair
    keep = np.ones(len(out), bool)
    keep[2 * (first + lengths) - 1] = False
    return out[keep], 2 * first - np.arange(len(first))


@dataclass(frozen=True)
class Model:
    classes: tuple[str, ...]
    weights: np.ndarray  # FEATURES x classes
    bias: np.ndarray
    temperature: float

    def probabilities(self, words: list[list[bytes]]) -> np.ndarray:
        at, starts = features(words)
        sums = np.add.reduceat(self.weights[at], starts, axis=0)
        count = np.diff(np.append(starts, len(at)))[:, None]
        return _softmax((sums / np.sqrt(count) + self.bias) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _pairs(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:]))


_TEMPLATE_PAIRS = {k: [_pairs(paragraphs(t.encode())[0]) for t in v] for k, v in TEMPLATES.items()}


def resemblance(words: list[bytes], family: str) -> float:
    """The largest share of a template's word pairs that the paragraph holds."""
    mine = _pairs(words)
    return max(len(mine & t) / len(t) for t in _TEMPLATE_PAIRS[family])


def _key(codes: np.ndarray) -> np.ndarray:
    """A number for every two words in a row."""
    return (codes[:-1].astype(np.uint64) << np.uint64(32)) | codes[1:].astype(np.uint64)


_TEMPLATES = [t for family in _TEMPLATE_PAIRS.values() for t in family]
_KEYS = np.unique(np.concatenate([_key(np.array([_code(a), _code(b)])) for t in _TEMPLATES for a, b in t]))
#: Pair x template: whether the template holds the pair.
_HOLDS = np.array([np.isin(_KEYS, [_key(np.array([_code(a), _code(b)]))[0] for a, b in t]) for t in _TEMPLATES]).T


def spans(words: list[list[bytes]], block: np.ndarray, confirm: float = CONFIRM, window: int = WINDOW) -> list[tuple[int, int]]:
    """First and last word, counted over all paragraphs, of what holds `confirm` of a template's word pairs within `window`
    words of one block: per template the spans with most pairs, shorter ones first, none over another; and none within one
    that holds a larger share of its template, as notices of one family hold parts of another's."""
    codes = np.array([_code(w) for p in words for w in p], np.int64)
    if len(codes) < 2:
        return []
    of = np.repeat(block, [len(w) for w in words])
    key = _key(codes)
    at = np.minimum(np.searchsorted(_KEYS, key), len(_KEYS) - 1)
    hit = np.flatnonzero((_KEYS[at] == key) & (of[:-1] == of[1:]))
    found = []
    for t, pairs in enumerate(_TEMPLATES):
        need = max(1, int(np.ceil(confirm * len(pairs) - 1e-9)))
        mine = hit[_HOLDS[at[hit], t]]
        if len(mine) < need:
            continue
        a, b = mine[: len(mine) - need + 1], mine[need - 1 :]
        begins = np.flatnonzero((b - a < window - 1) & (of[a] == of[b])).tolist()
        if not begins:
            continue
        place, which, inside = mine.tolist(), at[mine].tolist(), of[mine].tolist()
        most = []
        for i in begins:
            seen = set()
            for j in range(i, len(place)):
                if place[j] - place[i] >= window - 1 or inside[j] != inside[i]:
                    break
                if which[j] not in seen:
                    seen.add(which[j])
                    if len(seen) >= need:
                        most.append((-len(seen), place[j] - place[i], place[i]))
        taken = set()
        for n, length, first in sorted(most):
            span = range(first, first + length + 2)
            if taken.isdisjoint(span):
                taken.update(span)
                found.append((n / len(pairs), length, first))
    over: dict[int, list[int]] = {}  # word -> ends of the spans over it
    out = set()
    for _, length, first in sorted(found):
        last = first + length + 1
        if all(end < last for end in over.get(first, ())):
            out.add((first, last))
            for k in range(first, last + 1):
                over.setdefault(k, []).append(last)
    return sorted(out)


def windows(n: int, size: int = WINDOW) -> list[tuple[int, int]]:
    """Begin and end of overlapping windows over n words, half a window apart."""
    return [(a, min(a + size, n)) for a in range(0, max(1, n - size // 2), size // 2)]


def training_rows(corpus: list[list[bytes]], per_template: int = 30, seed: int = 7) -> tuple[list[list[bytes]], np.ndarray, tuple[str, ...]]:
    rng = np.random.default_rng(seed)
    classes = (NONE, *TEMPLATES)
    pool = [w for p in corpus for w in p] or [b"text"]
    rows, labels = [], []
    for k, family in enumerate(TEMPLATES, 1):
        for template in TEMPLATES[family]:
            words = paragraphs(template.encode())[0]
            for i in range(per_template):
                kept = [w for w in words if i < 5 or rng.random() > 0.08] or words
                around = [pool[j] for j in rng.integers(len(pool), size=int(rng.integers(0, 6)) if i >= 5 else 0)]
                cut = int(rng.integers(len(around) + 1))
                rows.append(around[:cut] + kept + around[cut:])
                labels.append(k)
    none = [p for p in corpus if all(resemblance(p, f) < 0.3 for f in TEMPLATES)]
    return rows + none, np.array(labels + [0] * len(none)), classes


def fit_rows(rows: list[list[bytes]], labels: np.ndarray, classes: tuple[str, ...], rounds: int = 80, seed: int = 7) -> Model:
    order = np.random.default_rng(seed).permutation(len(rows))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]

    def matrix(which):
        x = np.zeros((len(which), FEATURES), np.float32)
        for r, i in enumerate(which):
            at, _ = features([rows[i]])
            np.add.at(x[r], at, 1 / np.sqrt(len(at)))
        return x

    x, y = matrix(used), np.eye(len(classes), dtype=np.float32)[labels[used]]
    weight = (len(used) / (len(classes) * np.maximum(1, y.sum(0))))[labels[used]][:, None].astype(np.float32)  # classes count alike
    w, b = np.zeros((FEATURES, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        g = (_softmax(x @ w + b) - y) * weight / len(used)
        vw, vb = 0.9 * vw - 8 * (x.T @ g + 1e-5 * w), 0.9 * vb - 8 * g.sum(0)
        w, b = w + vw, b + vb
    z, t = matrix(held) @ w + b, labels[held]
    loss = {c: -np.log(np.maximum(_softmax(z / c)[np.arange(len(t)), t], 1e-9)).mean() for c in np.geomspace(0.25, 4, 17)} if len(t) else {1.0: 0}
    return Model(classes, w, b, float(min(loss, key=loss.get)))


def fit(docs: DataFrame, negative_docs: int = NEGATIVE_DOCS) -> Model:
    ids = [r[0] for r in drawn(docs.filter("doc_id IS NOT NULL").select("doc_id"), F.col("doc_id"), negative_docs)]
    if not ids:
        return fit_rows(*training_rows([]))
    lines = docs.filter(F.col("doc_id").isin(ids)).select(F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line").between(1, 5000))
    lines = drawn(lines.distinct(), F.col("line"), 10 * negative_docs)
    corpus = [p for r in lines for p in paragraphs(r["line"].encode())]
    return fit_rows(*training_rows(corpus))


SCAN = "doc_id long, n_paragraphs long, n_licence long, n_unknown long, licences string, best_probability double"


def scan(docs: DataFrame, model: Model | None = None, sure: float = SURE, confirm: float = CONFIRM) -> DataFrame:
    """One row per document: paragraphs, those with a confirmed licence, those that look like one but are not confirmed or
    sure, the families found (sorted, comma-separated; null if none) and the best probability of a confirmed one."""
    model = model or fit(docs)
    families = np.array(model.classes)

    def judged(units, licensed, looks):
        """Notes what paragraphs a..b of every unit (words, a, b) hold: confirmed families, or only the look of one."""
        probability = model.probabilities([w for w, _, _ in units]) if units else np.zeros((0, len(families)))
        top = probability.argmax(1)
        for i in np.flatnonzero(top).tolist():
            (words, a, b), family, p = units[i], str(families[top[i]]), float(probability[i, top[i]])
            if p >= sure and resemblance(words, family) >= confirm:
                for k in range(a, b + 1):
                    licensed.setdefault(k, []).append((family, p))
            else:
                looks.update(range(a, b + 1))

    def run(batches):
        for table in pieces(batches, 2 << 20):
            texts = [blocks(t) for t in to_bytes(table["text"])]
            flat = [p for t, _ in texts for p in t]
            firsts = np.cumsum([0] + [b[-1] + 1 if b else 0 for _, b in texts])
            block = np.array([f + k for f, (_, b) in zip(firsts.tolist(), texts) for k in b], np.int64)
            licensed, looks = {}, set()
            judged([(p, k, k) for k, p in enumerate(flat)], licensed, looks)
            long = [(k, a, b) for k, p in enumerate(flat) if len(p) > WINDOW for a, b in windows(len(p))]
            for i in range(0, len(long), 4096):
                judged([(flat[k][a:b], k, k) for k, a, b in long[i : i + 4096]], licensed, looks)
            if near := spans(flat, block, confirm):
                words = [w for p in flat for w in p]
                of = np.repeat(np.arange(len(flat)), [len(p) for p in flat])
                judged([(words[a : b + 1], int(of[a]), int(of[b])) for a, b in near], licensed, looks)
            rows, a = [], 0
            for doc_id, (t, _) in zip(table["doc_id"].to_pylist(), texts):
                mine = range(a, a + len(t))
                found = [x for k in mine for x in licensed.get(k, ())]
                hits, unknown = sum(k in licensed for k in mine), sum(k in looks and k not in licensed for k in mine)
                a += len(t)
                rows.append((doc_id, len(t), hits, unknown, ",".join(sorted({f for f, _ in found})) or None, round(max(p for _, p in found), 4) if found else None))
            yield batch_of(rows, ["doc_id", "n_paragraphs", "n_licence", "n_unknown", "licences", "best_probability"], [pa.int64()] * 4 + [pa.string(), pa.float64()])

    return docs.select("doc_id", "text").mapInArrow(run, SCAN)
