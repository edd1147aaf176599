"""Scores of the language model against plain Python, token by token."""

import math
import re
import zlib
from collections import Counter, defaultdict

import messy
import numpy as np
import pytest
from pyspark.sql import functions as F

from creativeaudit.llm import katz
from creativeaudit.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text) + [None]


def held_out(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 10 == 0


class Plain:
    """Counts in dictionaries, one order defined by the one below."""

    def __init__(self, texts):
        self.one, self.two = Counter(), defaultdict(Counter)
        for text in texts:
            prev = "start"
            for w in tokens(text):
                self.one[w] += 1
                self.two[prev][w] += 1
                prev = ("word", w)
        self.n = sum(self.one.values())
        self.d1 = self._factors(Counter(self.one.values()))
        self.d2 = self._factors(Counter(r for c in self.two.values() for r in c.values()))
        self.cache = {}

    @staticmethod
    def _factors(n):
        d = katz.discounts([n[r] for r in range(1, 7)])
        return lambda r: r if r > 5 else d[r] * r

    def _shares(self, counts, d):
        kept = math.fsum(d(r) for r in counts.values())
        total = sum(counts.values()) + (kept >= sum(counts.values()))
        return kept, total

    def p1(self, w):
        if "one" not in self.cache:
            self.cache["one"] = self._shares(self.one, self.d1)
        kept, total = self.cache["one"]
        return self.d1(self.one[w]) / total if w in self.one else 1 - kept / total

    def p2(self, prev, w):
        if prev not in self.two:
            return self.p1(w)
        if prev not in self.cache:
            seen = self.two[prev]
            kept, total = self._shares(seen, self.d2)
            self.cache[prev] = total, (1 - kept / total) / (1 - math.fsum(self.p1(x) for x in seen))
        total, weight = self.cache[prev]
        return self.d2(self.two[prev][w]) / total if w in self.two[prev] else weight * self.p1(w)

    def scored(self, text):
        prev, base, score, known = "start", 0.0, 0.0, 0
        for w in tokens(text):
            base += math.log10((self.one[w] + 0.1) / (self.n + 0.1 * (len(self.one) + 1)))
            score += math.log10(self.p2(prev, w))
            known += w in self.one
            prev = ("word", w)
        return len(tokens(text)), known, base, score


def same(got, rows, held):
    model = Plain([t for i, t in rows if not held(i)])
    want = sorted((messy.key(i), held(i), *model.scored(t)) for i, t in rows)
    got = sorted((messy.key(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"], r["train_tokens"]) for r in got)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and g[6] == model.n
        assert g[4:6] == pytest.approx(w[4:6], rel=1e-9)
    return model


def is_held():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


@pytest.mark.parametrize("block, hot, common", [(16_000_000, 2048, 1 << 19), (3000, 2048, 20), (3000, 3, 0)])
def test_same_as_plain_model(spark, monkeypatch, block, hot, common):
    monkeypatch.setattr(katz, "COMMON", common)
    monkeypatch.setattr(katz, "BLOCK_BYTES", block), monkeypatch.setattr(katz, "HOT", hot), monkeypatch.setattr(katz, "NUMBERED", 50)
    rows = messy.documents(n=60)
    docs = messy.frame(spark, rows).select("*", *[F.lit("x").alias(c) for c in ("taught", "hash", "part", "asks")])
    same(katz.scores(docs, is_held()).collect(), [r[:2] for r in rows], held_out)


def test_the_registered_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_language_model"](spark, SF).collect()
    same(got, rows, held_out)
    # Pairs tell more than words do, also about texts that the model hasn't seen.
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_each_context_adds_up_to_one():
    texts = ["a b c a b", "a c", "b b b b b b b b", "", None, "c c c c c c a", "z z z z z z z"] + ["copy of a text"] * 9
    model = Plain(texts)
    words = [*model.one, "unknown"]
    for prev in [*model.two, ("word", "unknown")]:
        assert math.fsum(model.p2(prev, w) for w in words) == pytest.approx(1, abs=1e-12)


def test_discounts_of_usual_and_odd_counts():
    assert katz.discounts([1000, 400, 200, 120, 80, 56])[1:] == pytest.approx(
        [(r * - 1 and ((r + 1) * n2 / (r * n1) - .336) / (1 - .336)) for r, n1, n2 in zip(range(1, 6), [1000, 400, 200, 120, 80], [400, 200, 120, 80, 56])])
    for n in ([0] * 6, [5, 0, 0, 0, 0, 0], [0, 3, 0, 1, 0, 0], [10, 50, 200, 1, 0, 0], [1, 1, 1, 1, 1, 1], [100, 40, 20, 12, 90, 1]):
        d = katz.discounts(n)
        assert d[0] == 1 and ((0 < d[1:]) & (d[1:] <= 1)).all() and d[1] < 1
    assert katz.discounts([100, 40, 20, 12, 90, 1])[4:].tolist() == [1, 1]  # only the counts below the bulge are discounted


def test_nothing_to_learn_from_and_nothing_at_all(spark):
    schema = "doc_id long, text string"
    got = katz.scores(spark.createDataFrame([(1, "a b"), (2, None)], schema), F.lit(True)).collect()
    assert [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["score"], r["base_score"]) for r in sorted(got)] == [(1, 3, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0)]
    assert katz.scores(spark.createDataFrame([], schema), F.lit(None).cast("boolean")).collect() == []


def test_numbers_survive_packing():
    import pyarrow as pa

    v, w = np.array([7, 7, 0, 2 ** 40]), np.array([3, 300, 70000, 2 ** 35])
    body = katz._body(v=v, w=w, hot=np.array([True, False, True, False]), p=np.array([.1, .2, .3, -1]))
    got = katz._loaded([pa.scalar(body)] * 2, ["v", "w", "hot", "p"])
    assert [x.tolist() for x in got] == [[*x, *x] for x in ([7, 7, 0, 2 ** 40], [3, 300, 70000, 2 ** 35], [True, False, True, False], [.1, .2, .3, -1])]
    for x in ([-1, 127], [-129, 0], [0, 255], [-1, 128], [-2 ** 31, 2 ** 31 - 1], [-1, 2 ** 31]):
        assert katz._fewest(np.array(x)).tolist() == x
