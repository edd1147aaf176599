"""Near-duplicates against all pairs."""

from collections import Counter

import messy
import pytest

from creativeaudit.llm import minhash


def model(rows, percent, k=5):
    low = {i: i + 32 for i in range(65, 91)}
    sets = []
    for r in rows:
        w = messy.words((r[1] or "").translate(low))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r, a in zip(rows, sets):
        for q, b in zip(rows, sets):
            if a and r[0] is not None and q[0] is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(r[0]), find(q[0])))
                root[y] = x
    return Counter((r[0], len(s), None if r[0] is None else find(r[0]), r[0] is None or find(r[0]) == r[0]) for r, s in zip(rows, sets))


@pytest.mark.parametrize("percent", [80, 85])
def test_components(spark, percent):
    base = " ".join(f"w{i}" for i in range(200))
    rows = messy.documents(n=60)
    for i in range(30):  # a chain and a star of edits
        words = base.split()
        words[:i] = [f"e{j}" for j in range(i)]
        rows += [(300 + i, " ".join(words), "en", "s", 1), (400 + i, base.replace(f"w{5 * i} ", "X "), "en", "s", 1)]
    got = minhash.near_duplicates(messy.frame(spark, rows), percent=percent)
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect())) == model(rows, percent)


def test_a_pair_counts_in_the_first_band_whose_keys_agree(spark):
    """Band 0 agrees in the last bytes of its minima but not in the minima: its bucket holds one of the two only."""
    shared = 3
    keys = [[100 * i + b for b in range(minhash.BANDS)] for i in (1, 2)]
    keys[1][shared] = keys[0][shared]
    sign = bytearray(range(minhash.BANDS * minhash.ROWS))
    rows = [(keys[0][shared], 0, 0, shared, i, i, 1, 50, sign, keys[i - 1]) for i in (1, 2)]
    both = spark.createDataFrame(rows, "key long, i int, j int, band int, class long, component long, main long, n long, sign binary, keys array<long>")
    assert list(map(tuple, minhash._chunks(both.filter("class = 2"), both, 85).collect())) == [(1, 2)]
    early = both.withColumn("band", both["band"] + 1)
    assert minhash._chunks(early.filter("class = 2"), early, 85).collect() == []


def test_each_text_of_an_id_has_its_links(spark):
    """Two texts of one id that nobody else holds; one that somebody with a smaller id holds too."""
    def text(name, end="."):
        return " ".join([f"{name}{i}" for i in range(100)] + [end])

    rows = [(20, text("a"), "en", "s", 1), (20, text("b"), "en", "s", 1), (20, text("c"), "en", "s", 1), (31, text("a", "x"), "en", "s", 1), (11, text("b", "x"), "en", "s", 1),
            (12, text("c"), "en", "s", 1), (40, text("d"), "en", "s", 1), (40, text("e"), "en", "s", 1), (41, text("d"), "en", "s", 1),
            (41, text("e"), "en", "s", 1), (35, text("d", "x"), "en", "s", 1), (36, text("e", "x"), "en", "s", 1)]
    got = minhash.near_duplicates(messy.frame(spark, rows))
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect())) == model(rows, 85)


def test_long_paths_end_at_the_smallest_id(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (150, 200), (7, 7)], "a long, b long")
    got = dict(map(tuple, minhash.connected_components(links).collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}


def test_nothing_in_nothing_out(spark):
    assert minhash.near_duplicates(messy.frame(spark, [])).collect() == []
    alone = minhash.near_duplicates(messy.frame(spark, [(5, None, "en", "s", 1), (6, "", "en", "s", 1)])).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in alone) == [(5, 0, 5, True), (6, 0, 6, True)]


def test_without_keeps_the_rest(spark):
    got = minhash.without(messy.frame(spark), spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert got.count() == len([r for r in messy.documents() if r[0] not in (1, 2)])


def test_columns_may_have_any_names(spark):
    docs = spark.createDataFrame([(1, "a", "b"), (2, "c", "d"), (None, "e", "f")], "doc_id long, __gone string, gone string")
    gone = spark.createDataFrame([(1,)], "doc_id long")
    assert sorted(map(tuple, minhash.without(docs, gone).collect()), key=str) == [(2, "c", "d"), (None, "e", "f")]
