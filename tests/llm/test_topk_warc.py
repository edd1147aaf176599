"""Exact search and archives against plain Python."""

import base64
import gzip
import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from creativeaudit.llm import topk, warc


def vectors(n=220, dim=6):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(dim)]) for i in range(n)]
    rows += [(i, [.5] * dim) for i in range(300, 340)]           # ties
    rows += [(400, None), (401, [None] * dim), (402, [math.nan] * dim), (403, [math.inf] + [0.0] * (dim - 1)), (None, [9.0] * dim),
             (405, []), (406, [1.0, 2.0]), (410, [1.0, -1.0]), (7, [.9] * dim), (7, [.9] * dim), (0, [.1] * dim)]
    return rows


def plain(rows, is_query, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for (i, v) in sorted((r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[1])):
        if is_query(i):
            asked.setdefault(i, [math.floor(256 * x) for x in v])
    out = Counter()
    for i, q in asked.items():
        best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out.update((i, r, j, -s) for r, (s, j) in enumerate(best, 1))
    return out


@pytest.mark.parametrize("block, blocks, queries", [(1024, 64, 2048), (16, 2, 4)])
def test_top_k(spark, monkeypatch, block, blocks, queries):
    monkeypatch.setattr(topk, "BLOCK", block), monkeypatch.setattr(topk, "BLOCKS", blocks), monkeypatch.setattr(topk, "QUERIES", queries)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dim", F.lit("x")).withColumn("v", F.lit(1)).repartition(5)
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=5)
    assert Counter(map(tuple, got.collect())) == plain(rows, lambda i: i % 10 == 0, 5)


def test_scores_beyond_what_doubles_hold(spark):
    rows = [(0, [2.0 ** 27, 1.0]), (1, [2.0 ** 27, 3 / 256]), (2, [2.0 ** 27, 2 / 256])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(1, 1, 2 ** 63 - 1), (2, 2, 2 ** 63 - 1)]


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect() == []


PAGES = "page_id long, url string, html string"


def pages():
    rng = random.Random(9)
    rows = [(i, f"http://{rng.choice(['a', 'b', 'www.c'])}.example.org:{rng.choice([80, 8080])}/{rng.randint(0, 5)}?q={i % 3}", f"<p>é {rng.randint(0, 20)}</p>\r\n\r\nWARC/1.1\r\n")
            for i in range(80)]
    return rows + [(100, None, None), (101, "not a url\r\nX: y", ""), (102, "http://[bad/", "x" * 300_000), (None, "http://n.example/", "<p>only</p>"),
                   (None, None, "same"), (103, "http://a.example/", "same"), (7, rows[7][1], rows[7][2])]


def test_histories_are_complete_and_in_order(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "PER_RANGE", 20)
    rows = pages()
    df = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("x")).repartition(5)
    at = F.timestamp_seconds(F.col("page_id"))
    path = str(tmp_path / "w")
    out = warc.merged_histories(warc.stored(_written(spark, df, at, path), "runs"), per_range=20)
    got = [r.asDict() for r in out.collect()]
    keys = [(r["url_key"], r["captured_at"], r["page_id"] is not None, r["page_id"] or 0) for r in got]
    assert keys == sorted(keys) and len(got) == len(rows)
    groups = defaultdict(list)
    for r in rows:
        groups[r[2] or ""].append(r[0])
    want = Counter()
    for r in rows:
        raw, own = (r[2] or "").encode(), groups[r[2] or ""]
        best = max((i for i in own if i is not None), default=None)
        again = len(own) > 1 and best is not None and best != r[0]
        want[(r[0], len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", best if again else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want


def _written(spark, df, at, path):
    warc.write_archives(warc.records(df, at), path, per_archive=9)
    return warc.read_runs(spark, path)


def test_small_payloads_are_never_revisits(spark):
    rows = [(1, "http://a/", "tiny"), (2, "http://b/", "tiny"), (3, "http://c/", "long enough"), (4, "http://d/", "long enough")]
    got = warc.capture_histories(spark.createDataFrame(rows, PAGES), F.timestamp_seconds("page_id"), least_bytes=5)
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got.collect()) == [
        (1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


def test_archives_are_warc_files(spark, tmp_path):
    warc.write_archives(warc.records(spark.createDataFrame([(1, "http://a/", "hé")], PAGES), F.timestamp_seconds("page_id")), str(tmp_path / "w"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith("hé\r\n\r\n".encode())
    assert b"WARC-Date: 1970-01-01T00:00:01Z\r\n" in data


def test_no_pages(spark):
    assert warc.capture_histories(spark.createDataFrame([], PAGES), F.timestamp_seconds("page_id")).collect() == []


def test_loser_tree():
    rng = random.Random(1)
    for k in range(0, 12):
        runs = [sorted((rng.randint(0, 30), i) for _ in range(rng.randint(0, 9))) for i in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("HTTP://www.A.Example.org:80/Path?Q=1") == "org,example,a)/path?q=1"
    assert warc.url_key("https://x.org:8443") == "org,x:8443)/" and warc.url_key(None) == "" and warc.url_key("No Url") == "no url"
