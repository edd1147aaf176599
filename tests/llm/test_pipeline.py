"""Each stage of the pipeline against a plain model, on what its predecessor kept."""

import hashlib
from collections import Counter

import messy
import public_tokenizers
import pytest
import sentencepiece
from test_exact_mixing import shares
from test_lines_passages import covered
from test_minhash import model

import corpus_pipeline
from creativeaudit.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage, and what comes out of the last."""
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], SF), "stage"))
    return [[tuple(r) for r in d.collect()] for d in docs]


def test_columns_of_documents_are_kept(spark, stages):
    assert len(stages) == 6 and all(len(r) == 5 for s in stages[:-1] for r in s)


def test_quality(spark, stages):
    assert set(stages[1]) < set(stages[0])
    # Judged where there is enough trusted text to learn from. Words that only repeat themselves look fluent to the model.
    sf = "/root/testdata/sf0.01"
    kept = {r["doc_id"] for r in corpus_pipeline.good_text(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["doc_id"] for r in labels if r["quality"] == 0]
    assert sum(i in kept for i in good) >= 0.99 * len(good) and sum(i in kept for i in bad) <= 0.15 * len(bad)


def test_lines(stages):
    before, after = sorted(stages[1]), sorted(stages[2])
    full = [[x for x in r[1].split("\n") if x.strip(" \t\r\x0b\f")] for r in before]
    want = []
    for r, late in zip(before, covered([(r[0], s) for r, s in zip(before, full)], 2)):
        left = iter(late)
        text = "\n".join(x for x in r[1].split("\n") if not x.strip(" \t\r\x0b\f") or not next(left))
        if not any(late):
            want.append(r)
        elif text.strip(" \t\n\r\x0b\f"):
            want.append((r[0], text, *r[2:4], len(text)))
    assert after == want


def test_near_duplicates(stages):
    gone = {row[0] for row in model(sorted(stages[2]), 80) if not row[3]}
    assert sorted(stages[3]) == sorted(r for r in stages[2] if r[0] not in gone)


def test_mix(stages):
    before, after = stages[3], stages[4]
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        sizes[r[3]] += len(messy.words(r[1]))
        largest[r[3]] = max(largest[r[3]], len(messy.words(r[1])))
    for r in after:
        taken[r[3]] += len(messy.words(r[1]))
    want = shares(sizes)
    assert set(after) <= set(before) and max(Counter(after).values()) <= 3
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)


def test_ids(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.MODEL))
    want = Counter((r[0], r[2], r[3], tuple(library.encode(r[1])), hashlib.sha256(library.decode(library.encode(r[1])).encode()).hexdigest()) for r in stages[4])
    assert Counter((r[0], r[1], r[2], tuple(r[4]), r[5]) for r in stages[5]) == want
    assert all(r[3] == len(r[4]) for r in stages[5])


def test_run_is_all_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages[-1])


def test_odd_rows_go_through_every_stage(spark):
    """Null ids and texts, repeated rows, ties and an empty table, as messy tables have them."""
    rows = messy.documents(n=20)
    for given in (rows, []):
        docs = spark.createDataFrame(given, messy.SCHEMA)
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stored(stage(spark, docs, SF), "stage")
            assert docs.columns == corpus_pipeline.COLUMNS or n == 4
        assert (docs.count() > 0) == bool(given)
