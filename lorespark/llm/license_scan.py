"""License scans by a trained paragraph classifier.

Paragraphs are the lines of a text that have a word. Their words and word pairs, A-Z
lower-cased, are hashed into ``DIMS`` features; a softmax regression over them gives each
licence family and ``unknown`` a probability. It is trained here, on variants of the notices
in ``TEMPLATES`` (words dropped, cut, holders added, wrapped in other words) and on paragraphs of
at most ``max_background`` documents of least id hash as unknown, a documented bound; paragraphs
that hold half of a template, or a pair that only a family's notices have, are not used as unknown. A temperature is fitted on held-out
variants, so that the probabilities are calibrated; a family counts only from ``min_probability``
on. A prediction is confirmed if the paragraph's word pairs hold at least ``min_template`` of
those of one of the family's notices; a short paragraph of probability ``SURE`` is by a pair that only that
family's notices have, with a word that no other family uses, if it has no such pair of another family.

Notices are looked for in single paragraphs and in windows of any number of adjacent ones, so
that a wrapped notice is found: a window is a least stretch of lines, none of them blank, that
holds ``min_template`` of a notice's pairs (pairs across line breaks count), made longer by the
lines that go on with that notice. It is classified and confirmed as a single paragraph is. Of
finds that overlap, the one that holds most pairs of a notice stays, of equal ones the shorter.

Result: one row per input row with ``doc_id, n_paragraphs, n_licensed`` (finds, each of one or
more paragraphs), ``families`` (sorted, distinct, comma-joined) and ``spans`` (family:start:end by
start, comma-joined; code points of the find, its white space stripped at both ends). A null text has no paragraphs. Repeated
rows give repeated results. Other columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _tokens as tk
from ._store import least_hashed
from ._store import named as _named

DIMS = 1 << 16
#: Probability from which a paragraph is confirmed by a pair of words that only its family's notices have, if it has so many words at most.
SURE, MOST_WORDS = 0.9, 40
#: Wording of well-known licence notices by family.
TEMPLATES = {
    "agpl": [
        "licensed under the GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "licensed under the AGPLv3", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "licensed under the terms of the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "Released under the BSD License", "licensed under the terms of the BSD license", "SPDX-License-Identifier: BSD-2-Clause", "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0",
        "Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung 4.0 International Lizenz",
        "Cette œuvre est mise à disposition selon les termes de la Licence Creative Commons Attribution 4.0 International",
        "Esta obra está bajo una Licencia Creative Commons Atribución 4.0 Internacional",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": [
        "Licensed under CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: CC0-1.0", "SPDX-License-Identifier: Unlicense",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "licensed under the Eclipse Public License", "SPDX-License-Identifier: EPL-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "released under the GNU GPL v2", "released under the GNU GPL v3", "licensed under the GPLv2", "licensed under the GPLv3",
        "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License", "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "licensed under the GNU Lesser General Public License, version 2.1", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "licensed under the LGPLv3", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "mit": [
        "Released under the MIT License", "licensed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": [
        "All rights reserved", "Confidential and proprietary", "All rights reserved. No part of this work may be reproduced without the prior written permission of the publisher",
        "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited", "Alle Rechte vorbehalten", "Tous droits réservés", "Todos los derechos reservados",
    ],
}
FAMILIES = (*TEMPLATES, "unknown")
_USED = [{w for t in notices for w in t.split()} for notices in TEMPLATES.values()]
_SHARED = {w for used in _USED for w in used if sum(w in other for other in _USED) > 1}
#: Words around notices in training variants.
_AROUND = "copyright (c) 2019 2024 the authors of this file see also notice text is inc and contributors".split()


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of every word, then of every pair of words of a row."""
    lower = tk.LOWER[data]
    starts, ends, row = tk.word_spans(lower, offsets, _SEPARATOR)
    words = tk.span_hashes(lower, starts, ends)
    if not len(words):
        return row, words, row, words
    pair_row, pair, first = tk.shingles(words, row, 2)
    whole = np.zeros(len(words), bool)
    whole[:-1] = row[1:] == row[:-1]
    real = whole[first]
    return row, words, pair_row[real], pair[real]


#: Punctuation ends a word here, but for what names and versions hold.
_SEPARATOR = tk.IS_SPACE.copy()
for _c in range(128):
    if not (chr(_c).isalnum() or chr(_c) in "-."):
        _SEPARATOR[_c] = True


def _rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts; full stops at a word's end are blanked, as in ``_clean``."""
    raw = [t.encode() for t in texts]
    return _clean(np.frombuffer(b"".join(raw), np.uint8)), np.cumsum([0, *map(len, raw)])


def _clean(data: np.ndarray) -> np.ndarray:
    """A full stop or hyphen before a separator or the end separates too."""
    out = data.copy()
    ends = np.ones(len(data), bool)
    ends[:-1] = _SEPARATOR[data[1:]]
    out[ends & ((data == 0x2E) | (data == 0x2D))] = 0x20
    return out


def scores(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of class scores for each row: the sum of its features' weights by the root of their number."""
    row, words, pair_row, pair = features(data, offsets)
    n = len(offsets) - 1
    out = np.zeros((n, weights.shape[1]), np.float32)
    count = np.zeros(n, np.int64)
    for r, h in ((row, words), (pair_row, pair)):
        if len(r):
            first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            out[r[first]] += np.add.reduceat(weights[(h & np.uint64(DIMS - 1)).astype(np.int64)], first, axis=0)
            count += np.bincount(r, minlength=n)
    return out / np.sqrt(np.maximum(count, 1))[:, None]


def _variants(rnd: random.Random, background: list[str], each: int) -> tuple[list[str], list[int]]:
    texts, labels = [], []
    for label, family in enumerate(TEMPLATES):
        for notice in TEMPLATES[family]:
            texts.append(notice)
            labels.append(label)
            for _ in range(each):
                words = notice.split()
                # words that only one family uses stay, as without them the family is another
                keep = [w for w in words if w not in _SHARED or rnd.random() > 0.08] if len(words) > 8 else words
                keep = rnd.choices(_AROUND, k=rnd.randrange(0, 4)) + keep + rnd.choices(_AROUND, k=rnd.randrange(0, 3))
                if background and rnd.random() < 0.4:
                    other = rnd.choice(background).split()
                    at = rnd.randrange(len(other) + 1)
                    keep = other[max(0, at - rnd.randrange(12)) : at] + keep + other[at : at + rnd.randrange(12)]
                text = " ".join(keep)
                texts.append(rnd.choice([text, text, text.lower(), text + "."]))
                labels.append(label)
    for other in background:
        texts.append(other)
        labels.append(len(TEMPLATES))
    for _ in range(200):  # words of notices that make none
        texts.append(" ".join(rnd.choices(_AROUND + ["license", "licensed", "under", "version", "public", "the", "a"], k=rnd.randrange(1, 9))))
        labels.append(len(TEMPLATES))
    return texts, labels


def _pairs(text: str) -> set[int]:
    _, words, _, pair = features(*_rows([text]))
    return set(pair.tolist()) or set(words.tolist())


_NOTICES = [[_pairs(t) for t in TEMPLATES[f]] for f in TEMPLATES]


_SIZES = np.array([len(n) for notices in _NOTICES for n in notices])
_ALL = np.array(sorted({x for notices in _NOTICES for n in notices for x in n}), np.uint64)
#: The notices (columns) that have each of all pairs (rows).
_HAS = np.array([[x in n for notices in _NOTICES for n in notices] for x in _ALL.tolist()])


def held(label: int, text: str, least: float) -> int:
    """Pairs that the text has of the family's notice that it has most of, of those confirmed; 0 if none is."""
    own = _pairs(text)
    return max((len(own & notice) for notice in _NOTICES[label] if len(own & notice) >= least * len(notice)), default=0)


#: Pairs that one family's notices alone have, one of whose words no other family uses; not of the family without a licence.
_BY_PAIR = {x: {k for k, notices in enumerate(_NOTICES) if any(x in n for n in notices)} for x in _ALL.tolist()}


def _own_pairs(label: int, family: str) -> set[int]:
    words = _USED_LOWER[label] - set().union(*(u for k, u in enumerate(_USED_LOWER) if k != label))
    near = {p for t in TEMPLATES[family] for a, b in _neighbours(t) if a in words or b in words for p in _pairs(f"{a} {b}")}
    return {x for x in near if _BY_PAIR.get(x) == {label}}


def _neighbours(text: str) -> list[tuple[str, str]]:
    words = "".join(" " if ord(c) < 128 and _SEPARATOR[ord(c)] else c for c in text).split()
    words = [w.rstrip(".-").lower() for w in words]
    return list(zip(words, words[1:]))


_USED_LOWER = [{w for t in notices for pair in _neighbours(t) for w in pair} for notices in TEMPLATES.values()]
_OWN = [_own_pairs(k, f) if f != "proprietary" else set() for k, f in enumerate(TEMPLATES)]


def named(label: int, text: str) -> int:
    """Pairs of the text that only this family's notices have; 0 if it also has another family's."""
    pairs = _pairs(text)
    return 0 if any(pairs & own for k, own in enumerate(_OWN) if k != label) else len(pairs & _OWN[label])


def confirmed(label: int, text: str, least: float) -> bool:
    return held(label, text, least) > 0


def train(background: list[str], seed: int = 5, each: int = 40, steps: int = 200) -> tuple[np.ndarray, float, float]:
    """Weights divided by a fitted temperature, that temperature, and the accuracy on held-out variants."""
    rnd = random.Random(seed)
    background = [t for t in background if not any(confirmed(k, t, 0.5) or named(k, t) for k in range(len(TEMPLATES)))]
    texts, labels = _variants(rnd, background, each)
    order = list(range(len(texts)))
    rnd.shuffle(order)
    cut = len(order) * 4 // 5
    n_classes = len(FAMILIES)

    def matrix(ids: list[int]):
        row, words, pair_row, pair = features(*_rows([texts[i] for i in ids]))
        r = np.concatenate((row, pair_row))
        f = (np.concatenate((words, pair)) & np.uint64(DIMS - 1)).astype(np.int64)
        v = (1 / np.sqrt(np.bincount(r, minlength=len(ids))))[r].astype(np.float32)
        return r, f, v, np.array([labels[i] for i in ids])

    def softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def logits(w, r, f, v, n):
        out = np.zeros((n, n_classes), np.float32)
        np.add.at(out, r, w[f] * v[:, None])
        return out

    r, f, v, y = matrix(order[:cut])
    used, column = np.unique(f, return_inverse=True)
    w, m, s = (np.zeros((len(used), n_classes), np.float32) for _ in range(3))
    by = np.argsort(column, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], column[by][1:] != column[by][:-1])))
    rby, vby = r[by], v[by][:, None]
    start = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    size = np.bincount(y, minlength=n_classes)
    weight = (len(y) / n_classes / np.maximum(size, 1))[y][:, None].astype(np.float32) ** 0.5
    onehot = np.eye(n_classes, dtype=np.float32)[y]
    by_row = np.argsort(r, kind="stable")
    start = np.flatnonzero(np.concatenate(([True], r[by_row][1:] != r[by_row][:-1])))
    rows = r[by_row][start]
    for t in range(1, steps + 1):  # Adam on the penalised likelihood
        x = np.zeros((len(y), n_classes), np.float32)
        x[rows] = np.add.reduceat(w[column[by_row]] * v[by_row][:, None], start, axis=0)
        g = (softmax(x) - onehot) * weight / len(y)
        grad = np.add.reduceat(g[rby] * vby, first, axis=0) + 1e-6 * w
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    full = np.zeros((DIMS, n_classes), np.float32)
    full[used] = w
    r, f, v, y = matrix(order[cut:])
    x = logits(full, r, f, v, len(y))
    loss = {t: -np.log(softmax(x / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.25, 8, 36)}
    temperature = float(min(loss, key=loss.get))
    return full / temperature, temperature, float((x.argmax(axis=1) == y).mean())


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines of all rows, and the row of each; a newline is the end of its line."""
    cuts = np.unique(np.concatenate((offsets, np.flatnonzero(data == 0x0A) + 1)))
    return cuts, np.searchsorted(offsets, cuts[:-1], "right") - 1


def _windows(data: np.ndarray, lines: np.ndarray, of: np.ndarray, blank: np.ndarray, least: float) -> list[tuple[int, int]]:
    """First and last line of each stretch of several lines that may be a notice; ``data`` is clean."""
    if not len(of):
        return []
    fresh = np.ones(len(of), bool)
    fresh[1:] = (of[1:] != of[:-1]) | blank[1:] | blank[:-1]
    runs = np.append(lines[:-1][fresh], lines[-1])
    lower = tk.LOWER[data]
    starts, ends, row = tk.word_spans(lower, runs, _SEPARATOR)
    if len(starts) < 2:
        return []
    pair_row, pair, first = tk.shingles(tk.span_hashes(lower, starts, ends), row, 2)
    real = first < len(row) - 1
    real[real] = row[first[real]] == row[first[real] + 1]
    line = np.searchsorted(lines, starts, "right") - 1
    top, bottom = line[first[real]], line[first[real] + 1]
    pair_row, pair = pair_row[real], pair[real]
    whole = np.bincount(top[top == bottom], minlength=len(of))
    kind = np.minimum(np.searchsorted(_ALL, pair), len(_ALL) - 1)
    hit = np.flatnonzero(_ALL[kind] == pair)
    # each hit once for each notice that has it, grouped by run and notice, in the order of the text
    which, notice = np.nonzero(_HAS[kind[hit]])
    at = hit[which]
    group = pair_row[at].astype(np.int64) * len(_SIZES) + notice
    distinct = np.unique(group * len(_ALL) + kind[at]) // len(_ALL)
    ids, n = np.unique(distinct, return_counts=True)
    ids = ids[n >= least * _SIZES[ids % len(_SIZES)]]
    mine = np.isin(group, ids)
    at, group = at[mine], group[mine]
    order = np.argsort(group, kind="stable")
    at, group = at[order], group[order]
    found: set[tuple[int, int]] = set()
    for g, a, b in zip(ids.tolist(), np.searchsorted(group, ids).tolist(), np.searchsorted(group, ids, "right").tolist()):
        part = at[a:b]
        found |= _stretches(kind[part].tolist(), top[part].tolist(), bottom[part].tolist(), whole, least * int(_SIZES[g % len(_SIZES)]))
    return sorted(found)


def _stretches(kind: list[int], top: list[int], bottom: list[int], whole: np.ndarray, need: float) -> set[tuple[int, int]]:
    """Least stretches of lines that hold ``need`` kinds of one notice's pairs, with the lines that go on with it."""
    out: set[tuple[int, int]] = set()
    seen: set[tuple[int, int]] = set()
    count: dict[int, int] = {}
    i = 0
    for j, k in enumerate(kind):
        count[k] = count.get(k, 0) + 1
        if len(count) < need:
            continue
        while len(count) >= need:
            if count[kind[i]] == 1:
                del count[kind[i]]
            else:
                count[kind[i]] -= 1
            i += 1
        a, b = i - 1, j
        if (top[a], bottom[b]) in seen:
            continue
        seen.add((top[a], bottom[b]))
        have = set(kind[a : b + 1])
        while True:  # the rest of its lines, then a line that adds pairs and is joined by one or half of the notice
            while b + 1 < len(kind) and bottom[b + 1] == bottom[b]:
                b += 1
            while a > 0 and top[a - 1] == top[a]:
                a -= 1
            have |= set(kind[a : b + 1])
            low, high = a, b
            while high + 1 < len(kind) and bottom[high + 1] == bottom[min(b + 1, len(kind) - 1)]:
                high += 1
            while low > 0 and top[low - 1] == top[max(a - 1, 0)]:
                low -= 1
            if high > b and set(kind[b + 1 : high + 1]) - have and (top[b + 1] <= bottom[b] or bottom[high] == bottom[b] + 1 and 2 * (high - b) >= whole[bottom[high]]):
                b = high
            elif low < a and set(kind[low:a]) - have and (bottom[a - 1] >= top[a] or top[low] == top[a] - 1 and 2 * (a - low) >= whole[top[low]]):
                a = low
            else:
                break
        if bottom[b] > top[a]:
            out.add((top[a], bottom[b]))
    return out


def _scan(shared, min_probability: float, min_template: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        unknown = len(FAMILIES) - 1

        def predict(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            best = x[:, :unknown].argmax(axis=1)
            return best, np.exp(x[np.arange(len(x)), best] - np.logaddexp.reduce(x, axis=1))

        for batch in batches:
            for a, b, data, offsets in tk.text_slices(batch.column(1)):
                n = b - a
                lines, of = _lines(data, offsets)
                words = np.bincount(np.searchsorted(lines, tk.word_spans(data, lines)[0], "right") - 1, minlength=len(of))
                clean = _clean(data)
                best, p = predict(scores(weights, clean, lines))
                ranges = [(i, i, int(best[i]), bool(p[i] >= SURE)) for i in np.flatnonzero((p >= min_probability) & (words > 0)).tolist()]
                if windows := _windows(clean, lines, of, words == 0, min_template):
                    texts = [data[lines[i] : lines[j + 1]].tobytes().decode() + "\n" for i, j in windows]
                    best, p = predict(scores(weights, *_rows(texts)))
                    ranges += [(i, j, int(k), False) for (i, j), k, q in zip(windows, best, p) if q >= min_probability]
                finds = []
                for i, j, k, sure in ranges:
                    text = data[lines[i] : lines[j + 1]].tobytes().decode()
                    if holds := held(k, text, min_template) or (named(k, text) if sure and words[i] <= MOST_WORDS else 0):
                        finds.append((-holds, j - i, i, j, k, text))
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
                taken: set[int] = set()
                for _, _, i, j, k, text in sorted(finds):
                    if taken.isdisjoint(range(i, j + 1)):
                        taken.update(range(i, j + 1))
                        r = int(of[i])
                        begin = len(data[offsets[r] : lines[i]].tobytes().decode()) + len(text) - len(text.lstrip(" \t\n\v\f\r"))
                        found[r].append((begin, begin + len(text.strip(" \t\n\v\f\r")), k))
                found = [sorted(f) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, n),
                        pa.array(np.bincount(of, words > 0, minlength=n).astype(np.int64)),
                        pa.array([len(f) for f in found], pa.int64()),
                        pa.array([",".join(sorted({FAMILIES[k] for _, _, k in f})) for f in found], pa.string()),
                        pa.array([",".join(f"{FAMILIES[k]}:{s}:{e}" for s, e, k in f) for f in found], pa.string()),
                    ],
                    names=["doc_id", "n_paragraphs", "n_licensed", "families", "spans"],
                )

    return run


def background_sample(docs: DataFrame, max_background: int, seed: int) -> list[str]:
    """One paragraph of each of the ``max_background`` documents of least id hash, the longest up to 80 words."""
    order = F.xxhash64(F.lit(seed), "doc_id")
    rows = docs.filter("text IS NOT NULL").select(order.alias("o"), "doc_id", F.split("text", "\n").alias("lines"))
    line = F.element_at(F.col("lines"), (F.pmod(F.col("o"), F.size("lines")) + 1).cast("int"))
    paragraphs = rows.select("o", "doc_id", F.array_join(F.slice(F.split(line, " "), 1, 80), " ").alias("t"))
    picked = least_hashed(paragraphs, "o", max_background, docs.count(), "doc_id")
    return [t for r in picked.collect() if (t := r["t"].strip())]


def license_scan(docs: DataFrame, max_background: int = 2000, min_probability: float = 0.5, min_template: float = 0.7, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(_named(id_col).cast("bigint").alias("doc_id"), _named(text_col).cast("string").alias("text"))
    weights, _, _ = train(background_sample(rows, max_background, seed), seed)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return rows.mapInArrow(_scan(shared, min_probability, min_template), "doc_id bigint, n_paragraphs bigint, n_licensed bigint, families string, spans string")
