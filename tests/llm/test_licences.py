"""Licence scans: held-out accuracy, and every notice of a small corpus."""

import messy
import numpy as np
import pyarrow as pa
import pytest

from creativeaudit.llm import licences
from creativeaudit.llm.common import Words


@pytest.fixture(scope="module")
def model():
    return licences.train([p for r in messy.documents(seed=6) for p in (r[1] or "").split("\n")])


def test_held_out_accuracy(model):
    paragraphs = [p for r in messy.documents(seed=77) for p in (r[1] or "").split("\n")]
    texts, labels = licences._examples(paragraphs, np.random.Generator(np.random.PCG64(99)))
    words = Words(pa.array(texts, pa.string()), "bare")
    p = model.probabilities(model.logits(words, words.first[:-1], words.first[1:]))
    said = [licences.CLASSES[i] for i in p.argmax(axis=1)]
    right = sum(a == b for a, b, n in zip(said, labels, words.counts()) if n)
    assert right / np.count_nonzero(words.counts()) > 0.97
    assert 0.5 <= model.least <= 0.95


def test_sums_by_window_equal_sums_by_feature(model):
    words = Words(pa.array(["a b c d e", "", "x"], pa.string()), "bare")
    start, end = np.array([0, 1, 5]), np.array([3, 5, 6])
    found = licences.features(words)
    want = [model.weights[licences._inside(found, a, b)].sum(axis=0) + model.bias for a, b in zip(start, end)]
    assert np.allclose(model.logits(words, start, end), want)


def test_every_notice_is_found(spark, model):
    filler = " ".join(f"filler{i}" for i in range(300))
    rows, want = messy.documents(), set()
    notices = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ts]
    for i, (family, notice) in enumerate(notices):
        rows.append((1000 + i, f"first line\n\n{notice}", "en", "s", 1))
        rows.append((2000 + i, f"{filler} {notice} {filler}\nlast", "en", "s", 1))
        want |= {(1000 + i, 2, family), (2000 + i, 0, family)}
    rows.append((3000, "Licensed under the Zorblat License.", "en", "s", 1))
    got = licences.scan(messy.frame(spark, rows), model).collect()
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in got} == want | {(3000, 0, "unknown")}
    assert all(r["confirmed"] == (r["family"] != "unknown") for r in got)


def found(spark, model, texts):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    return {(r["doc_id"], r["paragraph"], r["family"]) for r in licences.scan(messy.frame(spark, rows), model).collect()}


def test_wrapped_notices(spark, model):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software)"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    assert found(spark, model, ["head\n\n" + mit, gpl, bsd + "\n \nend"]) == {(0, 2, "MIT"), (1, 0, "GPL"), (2, 0, "BSD")}


def test_two_notices_in_one_window(spark, model):
    both = "Licensed under the MIT License. Licensed under the Apache License, Version 2.0."
    assert found(spark, model, [both, "Licensed under CC BY-SA 4.0."]) == {(0, 0, "MIT"), (0, 0, "Apache"), (1, 0, "CC-BY-SA")}


def test_nothing_in_nothing_out(spark, model):
    assert licences.scan(messy.frame(spark, []), model).collect() == []
    assert licences.scan_licences(messy.frame(spark, [])).collect() == []
