"""Exact dedup and source mixing against plain Python."""

import hashlib
from collections import Counter, defaultdict

import messy
import pytest
from pyspark.sql import functions as F

from creativeaudit.llm import exact, mixing


def bare(text):
    return (text or "").translate({ord(c): None for c in " \t\n\x0b\f\r"})


@pytest.mark.parametrize("counters", [3, 1024])
def test_exact_duplicates(spark, counters):
    rows = messy.documents()
    groups = defaultdict(list)
    for r in rows:
        groups[bare(r[1])].append(r)
    want = Counter()
    for text, own in groups.items():
        best = min(own, key=lambda r: (-len(r[1] or ""), messy.key(r[0])))[0]
        for r in own:
            want[(r[0], best, len(own), r[0] == best, hashlib.sha256(text.encode()).hexdigest())] += 1
    got = exact.exact_duplicates(messy.frame(spark), counters=counters)
    assert Counter(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == want


def test_frequent_digests_hold_every_heavy_one_and_few_others(spark):
    names = ["heavy"] * 400 + ["half"] * 150 + [f"x{i}" for i in range(450)]
    df = spark.createDataFrame([(x,) for x in names], "digest string").repartition(7)
    got = {r[0] for r in exact.frequent_digests(df, counters=10).collect()}
    assert "heavy" in got and len(got) <= 10


def test_exact_duplicates_of_nothing(spark):
    assert exact.exact_duplicates(messy.frame(spark, [])).collect() == []


def shares(sizes, weights=(5, 2, 1), most=3.0):
    """Full sources drop out until none is above its bound."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(full.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > most * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in rest}
        full |= {s: most * sizes[s] for s in over}


def test_mix_meets_its_targets(spark):
    rows = messy.documents(n=300)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(messy.words(r[1]))
    want = shares(sizes)
    got = mixing.mix(messy.frame(spark, rows)).collect()
    again = mixing.mix(messy.frame(spark, rows).repartition(3)).collect()
    assert Counter(map(str, got)) == Counter(map(str, again)) and len(got) == len(rows)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(largest[s], 1) * 3  # rows of one id and text go together


def test_targets_stop_at_the_bound(spark):
    sizes = {"a": 10, "b": 100, "c": 1000, None: 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(shares(sizes)) and sum(got.values()) == pytest.approx(1110)


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert mixing.mix(messy.frame(spark, [])).collect() == []
    got = mixing.mix(messy.frame(spark, [(1, None, "en", "a", 0), (2, " ", "en", None, 0)])).collect()
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_carried_columns(spark):
    got = mixing.mix(messy.frame(spark), carry=("text", "lang"))
    assert got.filter(F.col("text").isNotNull()).count() > 0 and {"text", "lang", "source"} <= set(got.columns)
