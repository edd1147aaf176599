"""Readers on files made for the purpose."""

import base64
import hashlib
import json

from pyspark.sql import functions as F

from creativeaudit.operators.intake import media_inventory
from creativeaudit.sources import media, requests, scores


def test_media_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    files = {"a.jpg": b"\x1aE\xdf\xa3 video in disguise", "sub/b.bin": b"\xff\xd8\xff picture", "note.txt": b"words"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit(str(tmp_path), 1)[1].lstrip("/"): r for r in media_inventory(media.read_media(spark, str(tmp_path))).collect()}
    assert {n: got[n]["media_hash"] for n in files} == {n: hashlib.sha256(d).hexdigest() for n, d in files.items()}
    assert {n: (got[n]["kind"], got[n]["mime"], got[n]["reject_code"]) for n in files} == {
        "a.jpg": ("video", None, None), "sub/b.bin": ("image", "image/jpeg", None),
        "note.txt": ("image", None, "INVALID_IMAGE")}


def test_empty_payload_is_rejected(spark):
    df = spark.createDataFrame([("e", bytearray(b""))], "path string, content binary")
    r = media_inventory(df).first()
    assert (r["n_bytes"], r["reject_code"], r["media_hash"]) == (0, "INVALID_IMAGE", hashlib.sha256(b"").hexdigest())


def test_eval_folder_order(spark, tmp_path):
    for name in ["dog/pos/b.JPG", "dog/pos/a.png", "dog/neg/c.gif", "dog/pos/notes.txt", "alcohol/neg/z.webp", "loose.jpg", "dog/other/x.jpg"]:
        p = tmp_path / "eval" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    paths = media.read_eval_paths(spark, str(tmp_path / "eval"))
    got = [(r["owner"], r["label"], r["path"].rsplit("/", 1)[1]) for r in media.eval_discover(paths).collect()]
    assert got == [("alcohol", False, "z.webp"), ("dog", True, "a.png"), ("dog", True, "b.JPG"), ("dog", False, "c.gif")]
    assert media.eval_discover(paths, 2).count() == 2
    assert "content" not in paths._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_request_bodies(spark):
    pic = base64.b64encode(b"hello").decode()
    bodies = {
        "both": {"media_base64": pic, "media_url": "http://x", "tags": "a"}, "old": {"image_base64": pic, "tags": ["a", " a ", "b"]},
        "blank": {"media_base64": "  ", "image_url": " http://y ", "tags": "a"}, "data": {"media_base64": "data:image/png;base64," + pic, "tags": "a"},
        "bad": {"media_base64": "%%%", "tags": "a"}, "pad": {"media_base64": pic.rstrip("="), "tags": "a"},
        "space": {"media_base64": pic[:4] + " " + pic[4:] + "   ", "tags": "a"}, "number": {"media_base64": 7, "tags": "a"},
        "notags": {"media_base64": pic, "tags": 42}, "none": {"tags": "a"}}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in bodies.items()] + [("list", "[1]"), ("junk", "{")], "request_id string, body_json string")
    got = {r["request_id"]: (bytes(r["media"]) if r["media"] is not None else None, r["media_url"], r["reject_code"])
           for r in requests.request_intake(df).collect()}
    assert got == {"both": (b"hello", None, None), "old": (b"hello", None, None), "blank": (None, "http://y", None), "data": (b"hello", None, None),
                   "bad": (None, None, "INVALID_IMAGE"), "pad": (None, None, "INVALID_IMAGE"), "space": (None, None, "INVALID_IMAGE"),
                   "number": (None, None, "NO_IMAGE"), "notags": (b"hello", None, "NO_TAGS"), "none": (None, None, "NO_IMAGE"),
                   "list": (None, None, "BAD_REQUEST"), "junk": (None, None, "BAD_REQUEST")}


def test_list_items_count_by_their_text(spark):
    df = spark.createDataFrame([(1, json.dumps({"image_url": "http://x", "tags": [" a ", 7, None, True, "a"]}))], "request_id int, body_json string")
    assert requests.request_intake(df).first()["tags"] == ["a", "7", "None", "True"]


def test_banked_scores_and_archive(spark, tmp_path):
    bank = {"x": {"p1": {"path": "p1", "owner": "a", "label": True, "bands": {"a": "present"}, "evidence": {}, "latency_ms": 5}},
            "y": {"p1": {"path": "p1", "owner": "a", "label": True, "bands": {}, "evidence": {}}}}
    (tmp_path / "bank.json").write_text(json.dumps(bank, indent=2))
    got = scores.banked_scores(scores.read_documents(spark, str(tmp_path / "bank.json"))).collect()
    assert sorted((r["arm"], r["path"], r["label"], r["latency_ms"]) for r in got) == [("x", "p1", True, 5), ("y", "p1", True, 0)]
    archive = {"tags": [{"slug": "a", "label": "A", "positives": ["p", "q"], "negatives": []}, {"slug": "b", "label": "B", "positives": ["p"]}]}
    (tmp_path / "arch.json").write_text(json.dumps(archive, indent=2))
    stats = scores.phrase_stats(scores.read_documents(spark, str(tmp_path / "arch.json"))).collect()
    assert sorted(map(tuple, stats)) == [("a", 2, 0), ("b", 1, 0)]


def test_an_empty_report_is_not_written(spark, tmp_path):
    empty = spark.range(0).select(F.lit("x").alias("arm"))
    assert not scores.write_report(empty, str(tmp_path / "r")) and not (tmp_path / "r").exists()
    assert scores.write_report(spark.range(1), str(tmp_path / "r")) and (tmp_path / "r").exists()


def test_stored_counters_touch_only_days_that_change(spark, tmp_path):
    from datetime import datetime
    from pathlib import Path

    from creativeaudit.operators import usage
    from creativeaudit.sources import counters

    path = f"{tmp_path}/counters"
    day = lambda d, h, k, n: [(k, f"2024-01-{d:02} {h:02}:00:{i:02}") for i in range(n)]
    table = lambda rows: usage.usage_counters(spark.createDataFrame(rows, "api_key_id long, t string").select("api_key_id", F.col("t").cast("timestamp").alias("ts")))
    files = lambda d: sorted(p.name for p in Path(path, f"day=2024-01-{d:02}").glob("*.parquet"))
    got = lambda: sorted((r["api_key_id"], str(r["window_start"]), r["count"]) for r in counters.read_counters(spark, path).collect())
    counters.create_counters(table(day(10, 1, 1, 2) + day(11, 1, 1, 3) + day(11, 23, 2, 1) + day(12, 5, 1, 1)), path)
    before = {d: files(d) for d in (10, 11, 12)}
    counters.upsert(table(day(12, 5, 1, 4) + day(12, 6, 2, 2) + day(13, 1, 3, 1)), path)
    assert files(10) == before[10] and files(11) == before[11] and files(12) != before[12]
    assert got() == [(1, "2024-01-10 01:00:00", 2), (1, "2024-01-11 01:00:00", 3), (1, "2024-01-12 05:00:00", 5), (2, "2024-01-11 23:00:00", 1),
                     (2, "2024-01-12 06:00:00", 2), (3, "2024-01-13 01:00:00", 1)]
    kept = files(12), files(13)
    assert counters.prune(spark, path, datetime(2024, 1, 12, 12)) == 2
    assert (files(12), files(13)) == kept and files(10) == [] and files(11) != before[11] and len(got()) == 4
    assert counters.prune(spark, path, datetime(2024, 1, 13)) == 1 and not Path(path, "day=2024-01-11").exists()
    assert counters.prune(spark, path, datetime(2024, 1, 13)) == 0 and (files(12), files(13)) == kept
