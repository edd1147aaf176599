"""Operators put together."""

from pyspark.sql import functions as F

from creativeaudit.operators import evalgate
from creativeaudit.plans import gate
from creativeaudit.plans.analyze import analyze_requests


def test_an_arm_is_scored_resumed_and_judged(spark):
    found = spark.createDataFrame([("a", True, "p1"), ("a", False, "p2"), ("b", True, "p3"), ("b", True, "p4")],
                                  "owner string, label boolean, path string")
    frames = spark.createDataFrame([(i, f"p{i}", 0) for i in range(1, 5)], "creative_id bigint, path string, frame_index bigint")
    old = spark.createDataFrame([("old", f"p{i}", o, l, {"a": "present", "b": "present"}, {}, 10)
                                 for i, (o, l) in enumerate([("a", True), ("a", False), ("b", True), ("b", True)], 1)],
                                "arm string, path string, owner string, label boolean, bands map<string,string>, "
                                "evidence map<string,string>, latency_ms bigint")
    calls = {1: {"a": True, "b": False}, 2: {"a": False, "b": False}, 3: {"a": False, "b": True}}

    def scorer(creative_id, items, tags):
        return [{"frame_index": 0, "tag": t, "present": calls[creative_id][t], "score": .9, "top_phrase": "seen"} for t in tags]

    new = gate.score_arm("new", found, frames, old, ["a", "b"], scorer, backoff_s=0.0)
    assert sorted(r["path"] for r in new.collect()) == ["p1", "p2", "p3"]   # p4 failed and stays to do
    bank = evalgate.arms_union(old, new)
    assert [r["path"] for r in evalgate.resume_todo(found, bank, "new").collect()] == ["p4"]
    slugs = spark.createDataFrame([("a",), ("b",)], "slug string")
    report, comparison, verdict = gate.judge(bank, slugs, "old", "new")
    by_arm = {r["arm"]: r for r in report.collect()}
    assert (by_arm["old"]["cross_tag_false_blocks"], by_arm["new"]["cross_tag_false_blocks"]) == (4, 0)
    assert by_arm["new"]["mean_recall"] == 1.0 and verdict.first()["verdict"] == "PASS"
    assert comparison.count() == 4


def test_requests_end_to_end(spark):
    catalog = spark.createDataFrame([("a", "active"), ("b", "active"), ("old", "retired")], "slug string, status string")
    req = spark.createDataFrame([(1, 10, "h", "a, b"), (2, 10, "h", "a,zzz"), (3, 10, "h", " , "), (4, 10, "h", "old"), (5, 10, "h", "b,a"), (6, 77, "k", "a,b"), (7, 77, "x", "a"), (8, 11, "y", "a,b"), (9, 11, "y", "a")],
                                "request_id int, creative_id int, image_hash string, tags_csv string")
    item = "array<struct<frame_index:int,tag:string,present:boolean,score:double,top_phrase:string>>"
    kept = [(0, "a", True, .9, "kept"), (0, "b", None, .5, "kept")]
    stored = spark.createDataFrame([(90, "k", ["b", "a"], "v2", 1, kept), (91, "k", ["b", "a"], "v2", 0, None)],
                                   f"request_id int, image_hash string, tags array<string>, packs_version string, created_at int, results {item}")
    raw = spark.createDataFrame([(10, 0, "a", None, .9, ""), (10, 1, "a", True, .6, "x"), (10, 0, "b", False, .2, ""), (10, 1, "b", False, .3, ""),
                                 (11, 0, "a", True, .7, ""), (11, 1, "a", True, .8, ""), (11, 0, "b", True, .7, "")],
                                "creative_id int, frame_index int, tag string, present boolean, score double, top_phrase string")
    limits = spark.createDataFrame([("a", True, "v2", .5, .5)], "slug string, calibrated boolean, packs_version_seen string, precision double, recall double")
    answered, rejected = analyze_requests(req, catalog, stored, raw, limits, "v2")
    got = sorted((r["request_id"], r["tag"], r["band"], r["frame_index"], r["calibrated_effective"], r["cached"]) for r in answered.collect())
    assert got == [*[(i, t, b, 1, c, False) for i in (1, 5) for t, b, c in (("a", "present", True), ("b", "absent", False))],
                   (6, "a", "present", 0, True, True), (6, "b", "uncertain", 0, False, True), (9, "a", "present", 1, True, False)]
    # 7: no answers and no stored analysis; 8: a frame without an answer for b.
    assert sorted(map(tuple, rejected.collect())) == [(2, "UNKNOWN_TAG"), (3, "NO_TAGS"), (4, "UNKNOWN_TAG"), (7, "INFERENCE_FAILED"), (8, "INFERENCE_FAILED")]
