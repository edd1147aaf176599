"""Hard negatives against a plain search over all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from creativeaudit.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def rows(n=240, dim=20):
    rng = random.Random(4)
    made = [(i, [rng.gauss(0, 1) + .4 for _ in range(dim)], rng.choice([0, 0, 0, 1, 2, 3])) for i in range(n)]
    made += [(i, made[i % 7][1], i % 3) for i in range(300, 330)]     # ties
    return made + [(400, None, 1), (410, [None] * dim, 1), (420, [math.nan] * dim, 1), (430, [math.inf] + [0.0] * (dim - 1), 1),
                   (440, [1.0] * dim, None), (None, [9.0] * dim, 1), (450, [], 2), (460, [1.0, 2.0], 1), (461, [1.0, 1.0], 1), (462, [1.0, 1.9], 2),
                   (470, [0.0] * dim, 1), (480, [-5.0] * dim, 9), (10, [.9] * dim, 1), (10, [.9] * dim, 1), (8, made[8][1], 2)]


def plain(table, k=5, least=80):
    ok = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in table
          if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, y in sorted(((i, v, y) for i, v, y in table if any(i == o[0] for o in ok) and v is not None and y is not None and None not in v), key=lambda r: (r[0], r[1], r[2])):
        if i % 10 == 0:
            anchors.setdefault(i, ([math.floor(256 * x) for x in v], y))
    out = Counter()
    for i, (q, y) in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, z) for j, v, z in ok if j != i and len(v) == len(q))
        for p, pid, _ in [s for s in scored if s[2] == y][:k]:
            inside = [(j, -s) for s, j, z in scored if z != y and least * -p <= 100 * -s <= 100 * -p][:k]
            out.update((i, pid, r, j, -p, s) for r, (j, s) in enumerate(inside, 1))
    return out


@pytest.mark.parametrize("block, part, anchors", [(1 << 19, 1 << 22, 1 << 15), (200, 900, 100)])
def test_same_as_all_pairs(spark, monkeypatch, block, part, anchors):
    monkeypatch.setattr(negatives, "BLOCK", block), monkeypatch.setattr(negatives, "ROWS", part), monkeypatch.setattr(negatives, "ANCHORS", anchors)
    table = rows()
    df = spark.createDataFrame(table, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("v", "dim", "nth", "rank", "low", "asks", "score")]).repartition(5)
    got = Counter(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()))
    want = plain(table)
    assert got == want and len(want) > 100


def test_the_index_omits_prunes_and_loses_nothing():
    rng = np.random.default_rng(3)
    x, q = (np.floor(256 * rng.normal(0, 1, (n, 40)) / np.arange(1, 41)) for n in (500, 30))
    s = q @ x.T
    for t in (s.max(axis=1) * .5, s.max(axis=1) * .9, np.full(30, -1e9)):
        index = negatives.Index(x, float((t / np.linalg.norm(q, axis=1)).min()))
        i, j, got = index.join(q, t)
        assert set(zip(i, j)) == set(zip(*np.nonzero(s >= t[:, None]))) and (got == s[i, j]).all()
        assert (t.min() > 0) == (index.lists[-1] < len(x))  # a low threshold needs all dimensions, others don't


def test_thresholds_fall_until_windows_are_full():
    x = np.arange(1000, dtype=float)[:, None]
    got = negatives.windows(np.ones((1, 1)), x, np.arange(1000), np.array([[800.0, 10.0]]), np.array([[999.0, 20.0]]), 3, lambda i, j: j % 2 == 0)
    assert sorted(r[1:] for r in got) == [(0, 994, 994), (0, 996, 996), (0, 998, 998), (1, 16, 16), (1, 18, 18), (1, 20, 20)]


def test_scores_beyond_what_doubles_hold(spark):
    big = 2.0 ** 22
    table = [(0, [big, 0.0], 1), (1, [big, 0.0], 1), (2, [big - 1 / 256, 0.0], 2), (3, [big, 5.0], 2), (4, [2 * big, 0.0], 2)]
    got = negatives.hard_negatives(spark.createDataFrame(table, SCHEMA), F.col("vec_id") == 0)
    assert Counter(map(tuple, got.collect())) == Counter({k: v for k, v in plain(table).items() if k[0] == 0})


def test_nothing_gives_nothing(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(0, [1.0], 1)], SCHEMA), F.col("vec_id") == 0).collect() == []
