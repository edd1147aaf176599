"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from creativeaudit.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, cut_every=97):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % cut_every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    about = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in about.items():
        best = min(vs, key=lambda v: (-n[v], v.encode()), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = Counter()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[(w, form[w], root, n[w], len(about[w]), n[form[w]] if form[w] else None)] += 1
    return out


def texts(seed=5):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÖ") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "x" * 300, "x" * 299, "ÀÀÀÀÀ", "àÀÀÀÀ", "÷×÷×÷"]

    def word():
        w = list(rng.choice(base[:12] if rng.random() < .3 else base))
        if rng.random() < .3:
            i = rng.randrange(len(w))
            w[i:i + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é", "z"])
        return "".join(w).title() if rng.random() < .2 else "".join(w)

    rows = [(i, rng.choice([" ", "1", ", ", "\n", "漢"]).join(word() for _ in range(rng.randint(0, 60)))) for i in range(150)]
    return rows + [(None, rows[3][1]), (None, None), (900, ""), (901, None), rows[5], rows[5], (902, "longest " * 5000),
                   *[(910 + i, "zzzzzzz yzzzzzz"[:15 if i < 12 else 7] + (" yyzzzzz" if i < 4 else "")) for i in range(40)]]


@pytest.mark.parametrize("cell, sample", [(1 << 15, 200_000), (20, 200_000), (10, 30)])
def test_same_as_all_pairs(spark, monkeypatch, cell, sample):
    from pyspark.sql import functions as F

    monkeypatch.setattr(spelling, "CELL", cell), monkeypatch.setattr(spelling, "SAMPLE", sample), monkeypatch.setattr(spelling, "AT_ONCE", 7)
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("word", "n", "run", "id", "h", "cell", "root")])
    for cut_every in (97, 5):
        got = Counter(map(tuple, spelling.spelling_variants(df.repartition(4), cut_every=cut_every).collect()))
        want = plain(rows, cut_every)
        assert got == want and sum(r[1] is not None for r in want) > 10
    assert any(r[2] != r[1] is not None for r in want)  # chains of more than one step


def test_boxes_reach_all_that_is_near():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (500, spelling.DIMS)).astype(np.int8)
    x[100:160] = x[100]
    for tight in (True, False):
        tree = spelling.Tree(x, 4, tight)
        assert sorted(tree.order) == list(range(500))
        i, leaf = tree.reach(x, 2)
        reached = {(int(a), int(p)) for a, b in zip(i, leaf) for p in tree.order[tree.start[b]:tree.stop[b]]}
        close = np.abs(x[:, None].astype(int) - x[None].astype(int)).sum(axis=2) <= 2
        assert set(zip(*map(np.ndarray.tolist, np.nonzero(close)))) <= reached and len(reached) < 500 * 500
    assert np.array_equal(tree.reach(x, 0)[0][np.argsort(tree.reach(x, 0)[0])], np.arange(500))  # planes give each point one home


def test_nothing_gives_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, "rare words only")], "doc_id long, text string")).collect() == []
