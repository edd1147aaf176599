"""Line and substring dedup against plain Python."""

import hashlib
import time
from collections import Counter, defaultdict

import messy
import pytest

from creativeaudit.llm import lines, passages


def covered(sequences, k):
    """For each (id, sequence): which items lie in a run of k that also starts earlier."""
    first, gone = {}, []
    for i, seq in sequences:
        for at in range(len(seq) - k + 1):
            run, start = tuple(seq[at:at + k]), (messy.key(i), at)
            first[run] = min(first.get(run, start), start)
    for i, seq in sequences:
        late = [False] * len(seq)
        for at in range(len(seq) - k + 1):
            if first[tuple(seq[at:at + k])] < (messy.key(i), at):
                late[at:at + k] = [True] * k
        gone.append(late)
    return gone


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_repeated_lines(spark, depth):
    rows = messy.documents(n=60) + [(200 + i, f"head\n\n  \ntail {i}\nhead\ntail 1\nz", "en", "s", 1) for i in range(3)]
    full = [[x for x in (r[1] or "").split("\n") if x.strip(" \t\r\x0b\f")] for r in rows]
    want = Counter()
    for r, seq, late in zip(rows, full, covered([(r[0], s) for r, s in zip(rows, full)], depth)):
        left, out = iter(late), []
        for x in (r[1] or "").split("\n"):
            if not x.strip(" \t\r\x0b\f") or not next(left):
                out.append(x)
        want[(r[0], None if r[1] is None else "\n".join(out), sum(late))] += 1
    got = lines.drop_repeated_lines(messy.frame(spark, rows), min_lines=depth)
    assert Counter(map(tuple, got.select("doc_id", "text", "n_lines_removed").collect())) == want
    assert "extra mark" in {r["mark"] for r in got.select("mark").collect()}


def test_ranks_hold_when_files_are_cut(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"line {(i * 7 + j) % 50}" for j in range(20))) for i in range(60)], "doc_id long, text string")
    want = sorted(tuple(r) for r in lines.drop_repeated_lines(docs).collect())
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "20")
    try:
        assert sorted(tuple(r) for r in lines.drop_repeated_lines(docs).collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_very_many_lines_and_any_names_of_columns(spark):
    text = "\n".join(f"line {i}" for i in range(60_000))
    docs = spark.createDataFrame([(i, text, "x", "y", "z", "u", "v", "w") for i in (1, 2)], "doc_id long, text string, doc string, mark string, gone string, __doc string, __mark string, __gone string")
    began = time.monotonic()
    got = lines.drop_repeated_lines(docs)
    assert got.columns == [*docs.columns, "n_lines_removed"]
    assert [(r["doc_id"], r["text"] == text, r["n_lines_removed"], r["__gone"], r["gone"]) for r in got.orderBy("doc_id").collect()] == [
        (1, True, 0, "w", "z"), (2, False, 60_000, "w", "z")]
    assert time.monotonic() - began < 60


def test_runs_are_maximal(spark):
    rows = [(1, "a\nb\nc\nd", "en", "s", 1), (2, "x\na\nb\nc\ny\nc\nd", "en", "s", 1)]
    got = sorted(map(tuple, lines.repeated_runs(messy.frame(spark, rows)).collect()))
    assert got == [(2, 1, 3), (2, 5, 2)]


def test_ranks_are_the_order_of_a_suffix_array(spark):
    rows = [(1, "a\nb\na\nb\na", "en", "s", 1), (2, "a\nb\nc", "en", "s", 1)]
    ranks = lines.suffix_ranks(lines.line_ids(messy.frame(spark, rows)), 2).collect()
    by = defaultdict(set)
    for r in ranks:
        by[r["rank"]].add((r["doc"], r["pos"]))
    assert sorted(map(sorted, by.values())) == [[(1, 0), (1, 2), (2, 0)], [(1, 1), (1, 3)]]


@pytest.mark.parametrize("window, block", [(20, 3000), (20, 10_000_000), (5, 3000), (1, 3000)])
def test_repeated_passages(spark, window, block):
    rows = messy.documents(n=50)
    seqs = [(r[0], messy.words(r[1])) for r in rows]
    want = Counter()
    for (i, seq), late in zip(seqs, covered(seqs, window)):
        kept = b" ".join(w for w, x in zip(seq, late) if not x)
        want[(i, len(seq), sum(late), hashlib.sha256(kept).hexdigest())] += 1
    got = passages.repeated_passages(messy.frame(spark, rows), window=window, block_bytes=block)
    assert Counter(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == want


def test_kept_words_are_given_back(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "en", "s", 1), (2, f"new {text} end", "en", "s", 1), (3, "alone", "en", "s", 1)]
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in passages.repeated_passages(messy.frame(spark, rows), with_text=True).collect()}
    assert got[2] == (30, "new end") and got[3] == (0, None) and got[1][0] == 0


def test_nothing_in_nothing_out(spark):
    empty = messy.frame(spark, [])
    assert lines.drop_repeated_lines(empty).collect() == [] and passages.repeated_passages(empty).collect() == []
