"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creativeaudit.llm.common import _IS_SPACE, Words, pieces_of

# Short notices of licences as their stewards or users word them.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "Apache": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.",
               "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
            "Released under the GNU GPL version 3 or later."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the GNU Lesser General Public License, version 3.",
             "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Released under the BSD license.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Dedicated to the public domain under CC0 1.0."],
}
#: Notices of no family here; {} is a made-up name. They teach what a licence looks like without being known.
OTHERS = ["Licensed under the {} License.", "Released under the {} Public License, version 1.", "This work is licensed under the {} licence.",
          "Use of this text is subject to the {} license agreement.", "Distributed under the terms of the {} License, version 5."]
# End of fixed values.

NONE, UNKNOWN = "none", "unknown"
CLASSES = [NONE, UNKNOWN, *TEMPLATES]
#: Words of a window and of its step: a notice inside a long paragraph has a window of its own.
WINDOW, STEP = 32, 16
#: Documents whose paragraphs teach what is no licence. The only bound on training; it never grows.
NEGATIVE_DOCS = 200
FEATURES = 1 << 16
#: Share of a template's word pairs that a confirmed window has, and of a general notice's that an unknown licence has.
CONFIRMED, LICENCE_LIKE = 0.75, 0.4
#: Of windows that hold a licence of no known family, the share that must end as unknown.
CALIBRATION = 0.95


def windows(words: Words, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end) of the windows that cover each text, or each part if ``first`` says where parts begin and the last ends."""
    first = words.first if first is None else first
    n = np.diff(first)
    k = np.maximum(1, -(-(n - WINDOW) // STEP) + 1)
    k[n == 0] = 0
    text = np.repeat(np.arange(len(n)), k)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(k) - k, k)
    start = first[:-1][text] + nth * STEP
    return text, start, np.minimum(start + WINDOW, first[1:][text])


def layout(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line of each word in its text, where lines with words begin and the last ends, the same of paragraphs).

    Paragraphs end at blank lines and with the text.
    """
    breaks = np.flatnonzero(words.data == 10)
    upto = np.concatenate(([0], np.cumsum(~_IS_SPACE[words.data])))
    blank = np.concatenate(([0, 0], np.cumsum(upto[breaks[1:]] == upto[breaks[:-1]])))[:len(breaks) + 1]
    line, owner = np.searchsorted(breaks, words.start), words.owner()
    new_text = owner[1:] != owner[:-1]
    new_line = new_text | (line[1:] != line[:-1])
    # Lines i + 1 to j - 1 lie between words of lines i and j.
    between = blank[line[1:]] - blank[np.minimum(line[:-1] + 1, line[1:])]
    new_paragraph = new_text | (between > 0)
    ends = lambda x: np.concatenate(([0], np.flatnonzero(x) + 1, [len(words)]))
    return line - np.searchsorted(breaks, words.offsets[:-1])[owner], ends(new_line), ends(new_paragraph)


def features(words: Words) -> np.ndarray:
    """Hashed runs of one, two and three words that start at each word; the last place stands for none."""
    out = np.full((len(words), 3), FEATURES, np.int64)
    for k in (1, 2, 3):
        at, h = words.runs(k, seed=20 + k)
        out[at, k - 1] = (h % np.uint64(FEATURES)).astype(np.int64)
    return out


def _inside(found: np.ndarray, start: int, end: int) -> np.ndarray:
    """The features of a window: its last words start no longer run."""
    part = found[start:end].copy()
    part[-1:, 1:] = FEATURES
    part[-2:, 2] = FEATURES
    return part.ravel()


@dataclass
class Classifier:
    """Logistic regression over hashed word runs, a temperature, and the probability below which a family is not believed."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.5

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        x = logits / self.temperature
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def logits(self, words: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Sums of weights per window, from sums up to each word."""
        found = features(words)
        out = np.repeat(self.bias[None, :], len(start), axis=0)
        for k in range(3):
            upto = np.concatenate((np.zeros((1, len(self.bias))), np.cumsum(self.weights[found[:, k]], axis=0, dtype=np.float64)))
            out += upto[np.maximum(end - k, start)] - upto[start]
        return out


def _fit(rows: list[np.ndarray], labels: np.ndarray, passes: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> Classifier:
    """Full-batch gradient steps with Adagrad; classes weigh alike, so that many negatives don't drown the rest."""
    n_classes = len(CLASSES)
    index = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, index = np.unique(index, return_inverse=True)
    w, b = np.zeros((len(used), n_classes)), np.zeros(n_classes)
    gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    share = np.bincount(labels, minlength=n_classes)
    weight = (1 / np.maximum(share, 1))[labels] / np.count_nonzero(share)
    aim = np.eye(n_classes)[labels]
    by_word = np.argsort(index, kind="stable")
    heads = np.searchsorted(index[by_word], np.arange(len(used)))
    starts = np.searchsorted(owner, np.arange(len(rows)))
    live = (used != FEATURES)[:, None]
    for _ in range(passes):
        logits = np.add.reduceat(w[index], starts, axis=0) + b
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        off = (p / p.sum(axis=1, keepdims=True) - aim) * weight[:, None]
        g = np.add.reduceat(off[owner[by_word]], heads, axis=0) * live + ridge * w
        gw += g * g
        w -= rate * g / np.sqrt(gw)
        g = off.sum(axis=0)
        gb += g * g
        b -= rate * g / np.sqrt(gb)
    full = np.zeros((FEATURES + 1, n_classes))
    full[used] = w * live
    return Classifier(full.astype(np.float32).astype(np.float64), b)


def _rows(texts: list[str]) -> list[np.ndarray]:
    words = Words(pa.array(texts, pa.string()), "bare")
    found = features(words)
    return [_inside(found, a, b) for a, b in zip(words.first[:-1], words.first[1:])]


def _examples(paragraphs: list[str], rng) -> tuple[list[str], list[str]]:
    """Notices alone and between words of other paragraphs, whole and with a word lost, and the paragraphs themselves."""
    filler = [p.split() for p in paragraphs if p.split()] or [["text"]]

    def around(notice: str) -> str:
        a, b = (filler[rng.integers(len(filler))] for _ in "ab")
        words = notice.split()
        if rng.random() < 0.3 and len(words) > 6:
            words.pop(int(rng.integers(len(words))))
        room = max(0, WINDOW - len(words))
        before = int(rng.integers(0, room // 2 + 1)) if rng.random() < 0.6 else 0
        after = int(rng.integers(0, room // 2 + 1)) if rng.random() < 0.6 else 0
        return " ".join([*(a[-before:] if before else []), *words, *b[:after]])

    texts, labels = [], []
    for family, notices in TEMPLATES.items():
        for notice in notices:
            texts += [notice] + [around(notice) for _ in range(40)]
            labels += [family] * 41
    for notice in OTHERS:
        for _ in range(80):
            name = "".join(rng.choice(list("bcdfglmnprstvaeiou"), int(rng.integers(4, 9)))).title()
            texts.append(around(notice.format(name)))
            labels.append(UNKNOWN)
    for p in filler:
        for i in range(0, len(p), WINDOW):
            texts.append(" ".join(p[i:i + WINDOW]))
            labels.append(NONE)
    return texts, labels


def train(paragraphs: list[str], seed: int = 5) -> Classifier:
    """Fits on three quarters of the examples; temperature and threshold come from the rest.

    ``paragraphs``: text without known licences. Those that a template matches
    are left out.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    compare = Templates()
    texts, labels = _examples([p for p in paragraphs if compare.best(p)[1] < 0.5], rng)
    y = np.array([CLASSES.index(x) for x in labels])
    rows = _rows(texts)
    keep = [i for i, r in enumerate(rows) if len(r)]
    held = rng.random(len(rows)) < 0.25
    fit, rest = [i for i in keep if not held[i]], [i for i in keep if held[i]]
    model = _fit([rows[i] for i in fit], y[fit])
    logits = np.array([model.weights[rows[i]].sum(axis=0) + model.bias for i in rest])
    own = y[rest]

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), own]).mean())

    model.temperature = min(np.geomspace(0.25, 8, 41), key=loss)
    best = model.probabilities(logits)[:, 2:].max(axis=1)
    strange = np.sort(best[own == CLASSES.index(UNKNOWN)])
    if len(strange):
        model.least = float(np.clip(strange[min(len(strange) - 1, int(CALIBRATION * len(strange)))], 0.5, 0.95))
    return model


class Templates:
    """Word pairs of each notice, to compare windows with. Versions are numbers: they don't tell families apart."""

    def __init__(self) -> None:
        self.pairs = [(family, _pairs(notice)) for family, notices in TEMPLATES.items() for notice in notices]

        self.general = [frozenset().union(*map(_pairs, notice.split("{}"))) for notice in OTHERS]

    def like_a_licence(self, text: str) -> float:
        own = _pairs(text)
        return max(len(p & own) / len(p) for p in [*self.general, *(p for _, p in self.pairs)])

    def matches(self, words: list[str]) -> list[tuple[float, str, frozenset[int]]]:
        """(share, family, places of its word pairs) of every notice whose pairs the words have by CONFIRMED."""
        folded = [(w, i) for i, word in enumerate(words) for w in _folded(word)]
        at: dict[tuple[str, str], list[int]] = {}
        for j, ((a, _), (b, _)) in enumerate(zip(folded, folded[1:])):
            at.setdefault((a, b), []).append(j)
        out = []
        for family, pairs in self.pairs:
            found = pairs & at.keys()
            if len(found) / len(pairs) >= CONFIRMED:
                # The shortest stretch that has all of them: a pair may come again in another notice.
                hits = sorted((j, x) for x in found for j in at[x])
                held, low, best = dict.fromkeys(found, 0), 0, None
                for high, (j, x) in enumerate(hits):
                    held[x] += 1
                    while held[hits[low][1]] > 1:
                        held[hits[low][1]] -= 1
                        low += 1
                    if all(held.values()) and (best is None or j - hits[low][0] < best[1] - best[0]):
                        best = (hits[low][0], j)
                out.append((len(found) / len(pairs), family, frozenset(folded[j][1] for j, _ in hits if best[0] <= j <= best[1])))
        return out

    def best(self, text: str, family: str | None = None) -> tuple[str, float]:
        own = _pairs(text)
        return max(((f, len(p & own) / len(p)) for f, p in self.pairs if family in (None, f)), key=lambda x: x[1])


def _pairs(text: str) -> frozenset[tuple[str, str]]:
    words = _folded(text)
    return frozenset(zip(words, words[1:]))


def _folded(text: str) -> list[str]:
    bare = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text).lower().split()
    return ["0" if w.isdigit() else w for w in bare]


def negative_paragraphs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = NEGATIVE_DOCS) -> list[str]:
    """Paragraphs of the ``most`` documents with the smallest hashes: a bounded sample, for training only."""
    rows = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("h"), F.col(text).alias("text"))
    # The hashes first, then the texts of those that were chosen: tasks send no texts that aren't used.
    last = rows.select("h").distinct().orderBy("h").limit(most).agg(F.max("h").alias("h")).first()["h"]
    if last is None:
        return []
    chosen = rows.filter(F.col("h") <= last).dropDuplicates(["h"]).orderBy("h").collect()
    return [p for r in chosen for p in (r["text"] or "").split("\n")]


def scan(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every paragraph that holds a licence: its family, or unknown.

    Paragraphs end at blank lines. They, and their lines, are covered by
    overlapping windows of 32 words, and all of them are classified. In a
    window that is likely a licence every family with a template that agrees is
    named, unless most of the agreeing words belong to a better match; what is
    worded like a licence, but not close to a known one in its paragraph, is
    unknown. Of the matches of a family that begin in one line, the best
    counts. Nothing is shuffled.

    Null and empty texts have none. Repeated rows and ids each have their own
    findings. No rows give no rows; further columns are ignored. Columns:
    doc_id, paragraph (the line, from 0, in which the notice begins), family, probability, similarity, confirmed.
    """
    weights, bias, temperature, least = model.weights, model.bias, model.temperature, model.least
    kept = np.flatnonzero(weights.any(axis=1))
    small = (kept, weights[kept].astype(np.float32))

    def run(batches):
        full = np.zeros((FEATURES + 1, len(CLASSES)))
        full[small[0]] = small[1]
        own, compare = Classifier(full, bias, temperature, least), Templates()
        for batch in batches:
            row = 0
            for piece in pieces_of([batch], 1 << 20):
                ids = batch.column(0).slice(row, piece.num_rows)
                row += piece.num_rows
                words = Words(piece.column(1), "bare")
                if not len(words):
                    continue
                owner, (nth, lines, paragraphs) = words.owner(), layout(words)
                # Windows of lines as well as of paragraphs: a short line has one of its own, whatever stands around it.
                spans = np.unique(np.concatenate([np.stack(windows(words, x)[1:], axis=1) for x in (lines, paragraphs)]), axis=0)
                start, end = spans[:, 0], spans[:, 1]
                paragraph = np.searchsorted(paragraphs, np.arange(len(words)), "right")
                p = own.probabilities(own.logits(words, start, end))
                likely = np.flatnonzero(p[:, 0] < 0.5)
                said = lambda a, b: [words.data[x:y].tobytes().decode() for x, y in zip(words.start[a:b], words.end[a:b])]
                seen = []
                for i in likely:
                    for alike, family, at in compare.matches(said(start[i], end[i])):
                        at = frozenset(int(start[i]) + x for x in at)
                        seen.append((alike, family, at, i))
                if seen:
                    a, b = (np.array([f(x[2]) for x in seen]) for f in (min, max))
                    near = own.probabilities(own.logits(words, a, b + 2))
                # A family that the classifier is sure of comes first, then the closer and longer match.
                order = [(near[n, CLASSES.index(f)] >= own.least, alike, len(at), -n) for n, (alike, f, at, _) in enumerate(seen)]
                taken: dict[int, str] = {}
                out: dict[tuple[int, int, str], tuple] = {}
                for n in sorted(range(len(seen)), key=order.__getitem__, reverse=True):
                    alike, family, at, i = seen[n]
                    if 2 * sum(x in taken for x in at) > len(at):
                        continue  # the same words already name a family
                    value, first = float(max(near[n, CLASSES.index(family)], p[i, CLASSES.index(family)])), min(at)
                    rival = CLASSES[2 + int(np.argmax(near[n, 2:]))]
                    if value < 0.05 and not any(f == rival and at & z for _, f, z, _ in seen):
                        continue
                    taken |= dict.fromkeys(at, family)
                    key = (int(owner[first]), int(nth[first]), family)
                    out[key] = max(out.get(key, (0.0, 0.0)), (alike, value))
                named = np.unique(paragraph[list(taken)]) if taken else []
                for i in likely:
                    # A paragraph with a known family isn't unknown as well, for a window that cuts its notice off.
                    close = paragraph[start[i]] in named and any(x in taken for x in range(start[i] - WINDOW, end[i] + WINDOW))
                    if not close and (alike := compare.like_a_licence(" ".join(said(start[i], end[i])))) >= LICENCE_LIKE:
                        key = (int(owner[start[i]]), int(nth[start[i]]), UNKNOWN)
                        out[key] = max(out.get(key, (0.0, 0.0)), (alike, 1 - float(p[i, 0])))
                found = [(k, line, f, *v) for (k, line, f), v in sorted(out.items())]
                if found:
                    k, line, family, alike, value = zip(*found)
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array(k)), pa.array(line, pa.int64()), pa.array(family, pa.string()),
                        pa.array(value, pa.float64()), pa.array(alike, pa.float64()), pa.array([f != UNKNOWN for f in family], pa.bool_())],
                        names=["doc_id", "paragraph", "family", "probability", "similarity", "confirmed"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, paragraph long, family string, probability double, similarity double, confirmed boolean")


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", negative_docs: int = NEGATIVE_DOCS) -> DataFrame:
    """Trains on the templates and a bounded sample of ``docs``, then scans all of ``docs``; see ``scan``."""
    return scan(docs, train(negative_paragraphs(docs, text, doc_id, negative_docs)), doc_id, text)
