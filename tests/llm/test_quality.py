"""The language model and the classifier against a plain one."""

import math
import random
from collections import Counter, defaultdict

import messy
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from creativeaudit.llm import quality


def units(text):
    raw = (text or "").encode("utf-16-le")
    return [0, 0, 0] + [int.from_bytes(raw[i:i + 2], "little") for i in range(0, len(raw), 2)]


class Plain:
    """Interpolated modified Kneser-Ney of order four, term by term."""

    def __init__(self, texts):
        self.count = {4: Counter()}
        for t in texts:
            u = units(t)
            self.count[4].update(tuple(u[i - 3:i + 1]) for i in range(3, len(u)))
        for n in (3, 2, 1):
            self.count[n] = Counter(g[1:] for g in self.count[n + 1])
        self.discount, self.follow = {}, {n: defaultdict(list) for n in self.count}
        for n, c in self.count.items():
            of = Counter(c.values())
            y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0
            d = [i - (i + 1) * y * of[i + 1] / of[i] if of[i] else i / 2 for i in (1, 2, 3)]
            self.discount[n] = [min(x, i) for i, x in enumerate(d, 1)] if min(d) > 0 else [y if 0 < y < 1 else .5] * 3
            for g, k in c.items():
                self.follow[n][g[:-1]].append(k)

    def p(self, gram):
        n = len(gram)
        if not n:
            return 1 / (len(self.count[1]) + 1)
        lower, seen = self.p(gram[1:]), self.follow[n].get(gram[:-1])
        if not seen:
            return lower
        take = lambda k: self.discount[n][min(k, 3) - 1]
        own = self.count[n].get(gram, 0)
        return (max(own - take(own), 0) * (own > 0) + sum(map(take, seen)) * lower) / sum(seen)

    def bits(self, text):
        u = units(text)
        return -sum(math.log2(self.p(tuple(u[i - 3:i + 1]))) for i in range(3, len(u)))


def test_bits_equal_the_plain_model(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_BYTES", 4000)
    rows = messy.documents(n=30) + [(500, "emoji \U0001F600 here", "en", "s", 1)]
    known = [r for r in rows if r[0] is not None and r[0] % 2 == 0]
    plain = Plain([r[1] for r in known])
    docs = quality._rows_of(messy.frame(spark, rows), "doc_id", "text", "lang")
    model = quality.Model(quality.gram_counts(docs.filter("doc_id % 2 = 0")))
    got = Counter((r["doc_id"], r["units"], round(r["bits"], 6)) for r in quality.bits_of(docs, model).collect())
    assert got == Counter((r[0], len(units(r[1])) - 3, round(plain.bits(r[1]), 6)) for r in rows)


def test_odd_counts_of_counts_leave_no_probability_of_zero(spark):
    """A discount of 0 gave infinite bits, and through the running sum no number for the next texts."""
    trusted = [(i, t, "en") for i, t in enumerate(["ab", "ab", "ac", "ac", "ad", "ad", "ae", "ae", "ae", "af", "af", "af", "ag", "ag", "ag"] * 3)]
    model = quality.Model(quality.gram_counts(spark.createDataFrame(trusted, "doc_id long, text string, lang string")))
    assert all(d > 0 for ds in model.discounts.values() for d in ds)
    docs = spark.createDataFrame([(1, "mz", "en"), (2, "ab", "en"), (3, "", "en"), (4, "zzzz", "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["bits"] for r in quality.bits_of(quality._rows_of(docs, "doc_id", "text", "lang"), model).collect()}
    assert all(math.isfinite(b) for b in got.values()) and got[3] == 0 and got[2] < got[1]


def test_columns_may_have_any_names(spark):
    rows = [(i, "plain words of text " * 3 if i < 20 else "zq#x" * 9, "en", "a", "b") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, bad_id string, bad_mark string")
    trusted = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    got = quality.keep_good(docs, trusted)
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= set(rows)


def test_grams_of_a_column():
    length, keys = quality.grams(pa.array(["ab", None, "", "é"]))
    assert list(length) == [2, 0, 0, 1] and [int(k) & 0xFFFF for k in keys] == [97, 98, 233]
    assert [int(k) >> 16 for k in keys] == [0, 97, 0]


def corpus(n=300):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice("the cat and dog walk over green hills while rain falls on old roofs".split()) for _ in range(60))
    junk = lambda: "".join(chr(rng.randint(33, 90)) for _ in range(300))
    rows = [(i, junk() if i % 10 == 9 else good(), "en" if i % 2 else "fr", "s", 1) for i in range(n)]
    return rows + [(900, None, "en", "s", 1), (901, "", "xx", "s", 1), (902, "cat", "xx", "s", 1), (None, junk(), None, "s", 1), rows[0], rows[9]]


def test_junk_goes_and_clean_text_stays(spark):
    rows = corpus()
    trusted = spark.createDataFrame([(i,) for i in range(200) if i % 10 != 9] + [(None,)], "doc_id long")
    docs = messy.frame(spark, rows)
    out = quality.classified(docs, trusted)
    got = {(r["doc_id"], r["kept"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert got == {(r[0], not (r[0] is None or (r[0] < 300 and r[0] % 10 == 9))) for r in rows}
    kept = quality.keep_good(docs, trusted)
    assert kept.columns == docs.columns
    assert sorted(messy.key(r["doc_id"]) for r in kept.collect()) == sorted(messy.key(r[0]) for r in rows if (r[0], True) in got)


def test_without_trusted_text_all_stay(spark):
    none = spark.createDataFrame([], "doc_id long")
    out = quality.classified(messy.frame(spark), none)
    assert out.count() == len(messy.documents()) and out.filter("NOT kept").count() == 0
    assert quality.classified(messy.frame(spark, []), none).collect() == []


@pytest.mark.parametrize("q", [0.5, 0.99])
def test_quantile_from_steps(spark, q):
    values = [random.Random(i).randint(0, 40) for i in range(500)]
    df = spark.createDataFrame([(v, 1) for v in values], "step int, n int").groupBy("step").agg(F.sum("n").alias("n"))
    assert quality._quantile(df, [], q).first()["step"] == np.sort(values)[math.ceil(q * len(values)) - 1]


def test_threshold_is_the_quantile_and_a_share_of_the_spread(spark):
    """Many rates: next to the quantile, however high it is. Few: further up, by their spread."""
    def limit(values):
        df = spark.createDataFrame(list(Counter(values).items()), "step int, n int")
        return quality._quantile(df, [], 0.99).first()

    rng = random.Random(2)
    many, few = [round(rng.gauss(3000, 100)) for _ in range(20000)], [round(rng.gauss(3000, 100)) for _ in range(15)]
    assert 0 <= limit(many)["limit"] - limit(many)["step"] < 0.05 * 100
    assert 0.5 < (limit(few)["limit"] - limit(few)["step"]) / np.std(few) < 3
    assert limit([3000] * 5)["limit"] == 3000 and limit([3000, 3001])["limit"] is None


def test_text_well_above_the_quantile_goes(spark):
    """Words with one letter in ten replaced: a fifth more bits than clean text or less, but above all held-out rates."""
    rng = random.Random(8)
    words = "the cat and dog walk over green hills while rain falls on old roofs".split()
    clean = lambda: " ".join(rng.choice(words) for _ in range(400))
    spoilt = lambda: "".join(rng.choice("abcdefghij") if rng.random() < 0.02 else c for c in clean())
    rows = [(i, clean() if i < 300 else spoilt(), "en", "s", 1) for i in range(320)]
    trusted = spark.createDataFrame([(i,) for i in range(250)], "doc_id long")
    out = quality.classified(messy.frame(spark, rows), trusted).collect()
    assert {r["doc_id"] for r in out if not r["kept"]} == set(range(300, 320))
