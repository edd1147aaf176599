"""Streams over several micro-batches give what their batch twins give."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from creativeaudit.operators import intake, ordered, usage, verdicts
from creativeaudit.streaming import arrivals, streams
from creativeaudit.workload import inputs as I

SF = "/root/testdata/sf0.001"


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(tuple, df.select(*[F.col(c).cast("string") for c in cols]).collect()), key=str)


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    """The tables cut into five files in time order, so that each is one micro-batch."""
    def cut(name, order, parts=5):
        root = tmp_path_factory.mktemp(name)
        df = I.table(spark, SF, name)
        bounds = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.0)
        edges = [float("-inf"), *bounds, float("inf")]
        for i in range(parts):
            part = df.filter((F.col(order) > edges[i]) & (F.col(order) <= edges[i + 1]))
            part.coalesce(1).write.parquet(str(root / f"part{i}"))
        return df.schema, str(root / "part*")

    return {"events": cut("events", "event_id"), "conversations": cut("conversations", "conv_id")}


def stream(spark, split, name):
    schema, glob = split[name]
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(glob)


def run(query):
    query.awaitTermination()
    assert query.exception() is None
    return query


def test_usage(spark, split, tmp_path):
    src = I.requests_from(stream(spark, split, "events")).select("api_key_id", F.col("created_at").alias("ts"))
    run(streams.stream_usage(src, f"{tmp_path}/o", f"{tmp_path}/c"))
    got = streams.read_latest(spark, f"{tmp_path}/o", ["api_key_id", "window_start"])
    want = usage.usage_counters(I.requests(spark, SF).select("api_key_id", F.col("created_at").alias("ts")))
    assert rows(got) == rows(want)


def test_quota_and_late_rows(spark, split, tmp_path):
    q = run(streams.stream_quota(I.requests_from(stream(spark, split, "events")), f"{tmp_path}/o", f"{tmp_path}/c"))
    got = streams.read_latest(spark, f"{tmp_path}/o", ["api_key_id", "window_start"])
    assert rows(got) == rows(usage.quota_units(I.requests(spark, SF))) and streams.dropped_late(q) == 0


def files(spark, path, batches, schema):
    """One file per batch, named so that they are read in order."""
    for i, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/b{i}")
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/b*")


def test_rows_later_than_a_day_are_counted(spark, tmp_path):
    schema = "request_id long, api_key_id long, s long, latency_ms int, cached boolean, frames int"
    # A watermark filters late rows one micro-batch after it was reached.
    source = files(spark, f"{tmp_path}/in", [[(i, 1, s, 0, True, 1)] for i, s in enumerate([0, 400_000, 400_001, 10])], schema)
    q = run(streams.stream_quota(source().withColumn("created_at", F.timestamp_seconds("s")), f"{tmp_path}/o", f"{tmp_path}/c"))
    assert streams.dropped_late(q) == 1


def test_late_rows_are_split_off(spark, tmp_path):
    schema = "id long, s long"
    batches = [[(0, 100), (1, 50)], [(2, 200), (3, 40)], [(4, 140), (5, 139), (6, None)], [], [(7, 10_000), (8, 150)]]
    source = files(spark, f"{tmp_path}/in", batches, schema)
    for _ in range(2):  # a second run finds nothing new
        run(arrivals.split_late(source().withColumn("ts", F.timestamp_seconds("s")), f"{tmp_path}/o", f"{tmp_path}/c", delay="60 seconds"))
    kinds = spark.createDataFrame([], schema).withColumn("ts", F.timestamp_seconds("s")).schema
    assert sorted(r["id"] for r in arrivals.late_rows(spark, f"{tmp_path}/o", kinds).collect()) == [3, 4, 5, 6]
    assert spark.read.parquet(f"{tmp_path}/o/rows").filter("NOT late").count() == 5
    assert arrivals.clock(spark, f"{tmp_path}/o", 2)["n_late"] == 3
    # What is in time is never dropped by a watermark of the same delay.
    units = arrivals.in_time(spark, f"{tmp_path}/o", kinds).select(F.lit(1).alias("api_key_id"), "ts", F.lit(1).alias("units"))
    q = run(streams.stream_units(units, f"{tmp_path}/u", f"{tmp_path}/cu", late="60 seconds"))
    assert streams.dropped_late(q) == 0
    assert streams.read_latest(spark, f"{tmp_path}/u", ["api_key_id", "window_start"]).agg(F.sum("units")).first()[0] == 5


def test_a_batch_that_was_written_is_not_written_again(spark, tmp_path):
    source = files(spark, f"{tmp_path}/in", [[(0, 100)], [(1, 10)]], "id long, s long")
    for checkpoint in ("a", "b"):  # a lost checkpoint repeats all batches
        run(arrivals.split_late(source().withColumn("ts", F.timestamp_seconds("s")), f"{tmp_path}/o", f"{tmp_path}/{checkpoint}", delay="60 seconds"))
    assert spark.read.parquet(f"{tmp_path}/o/rows").count() == 2


def test_collapse(spark, split, tmp_path):
    raw = I.raw_from(stream(spark, split, "conversations")).withColumn(
        "ts", F.timestamp_seconds(F.col("creative_id") * 60 + F.col("frame_index")))
    run(streams.stream_collapse(raw, f"{tmp_path}/o", f"{tmp_path}/c"))
    want = verdicts.collapse_verdicts(verdicts.decide(I.raw_answers(spark, SF)))
    cols = ["creative_id", "tag", "frame_index", "present", "score", "band", "first_position"]
    assert rows(streams.read_collapsed(spark, f"{tmp_path}/o").select(*cols)) == rows(want.select(*cols))


def test_collapse_asks_for_thresholds_in_every_batch(spark, tmp_path):
    schema = "creative_id long, tag string, frame_index int, present boolean, score double, top_phrase string, decided_by string, timestamp_s double"
    source = files(spark, f"{tmp_path}/in", [[(1, "a", 0, True, .9, "x", "vlm", 0.0)], [(2, "a", 0, True, .9, "x", "vlm", 0.0)], [(1, "a", 1, False, .1, "x", "vlm", 0.0)]], schema)
    asked = []

    def thresholds(session):  # measured between the first batch and the second
        asked.append(1)
        return session.createDataFrame([("a", True, "v2", .7, .9)] if len(asked) > 1 else [], "slug string, calibrated boolean, packs_version_seen string, precision double, recall double")

    raw = source().withColumn("ts", F.timestamp_seconds(F.col("creative_id") * 60))
    run(streams.stream_collapse(raw, f"{tmp_path}/o", f"{tmp_path}/c", thresholds=thresholds, live="v2"))
    first = spark.read.parquet(f"{tmp_path}/o").filter("batch = 0").collect()
    assert [r["calibrated_effective"] for r in first] == [False] and len(asked) >= 3
    got = streams.read_collapsed(spark, f"{tmp_path}/o").select("creative_id", "band", "calibrated_effective")
    assert sorted(map(tuple, got.collect())) == [(1, "present", True), (2, "present", True)]  # its frame of the third batch touched the first again


HITS = "identity long, id long, ts timestamp"


def admitted(spark, tmp_path, batches, **how):
    """Feeds batches one by one; returns the answers and the queries' progress."""
    schema = spark.createDataFrame([], HITS).schema
    progress = []
    for i, part in enumerate(batches):
        spark.createDataFrame(part, "identity long, id long, s double").select("identity", "id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts")).coalesce(
            1).write.mode("append").parquet(f"{tmp_path}/in")
        run(arrivals.split_late(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/s", f"{tmp_path}/cs", delay=how["delay"]))
        q = run(streams.stream_admission(arrivals.in_time(spark, f"{tmp_path}/s", schema), f"{tmp_path}/o", f"{tmp_path}/c", **how))
        progress += q.recentProgress
    return streams.read_admission(spark, f"{tmp_path}/o", f"{tmp_path}/s", schema), progress


def test_admission_in_event_time(spark, tmp_path):
    rng = random.Random(6)
    hits = [(rng.randrange(4), i, i * 1.5 + rng.random()) for i in range(120)]
    order = sorted(hits, key=lambda h: h[2] + rng.uniform(0, 25))  # up to 25 seconds out of order
    late = [(1, 500, 3.0), (9, 501, 4.0)]
    batches = [order[:40], order[40:80], order[80:] + late, [(None, -1, 1e6)]]
    got, progress = admitted(spark, tmp_path, batches, limit=3, span_s=20, delay="30 seconds")
    frame = spark.createDataFrame(hits, "identity long, id long, s double").select("identity", "id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
    want = ordered.sliding_admission(frame, 3, 20).select("identity", "id", "admitted")
    on_time = got.filter("reject_code IS NULL").select("identity", "id", "admitted")
    assert rows(on_time) == rows(want) and on_time.filter("NOT admitted").count() > 5
    assert sorted(map(tuple, got.filter("reject_code = 'LATE'").collect())) == [(1, 500, False, "LATE"), (9, 501, False, "LATE")]
    state = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress]
    assert max(state) > 4 and state[-1] <= 1  # idle identities are forgotten


def test_admission_keeps_its_state_by_buckets(spark, tmp_path):
    rng = random.Random(7)
    big = 2 ** 60  # floats would not tell these apart
    hits = [(big + rng.randrange(150), i if i % 50 else None, i * 0.1 + rng.random()) for i in range(1200)] + [(-5, 1, 60.0), (-5, 2, 60.0)]
    order = sorted(hits, key=lambda h: h[2] + rng.uniform(0, 8))
    nobody = [(None, i, 125.0) for i in range(40)]
    batches = [order[:400], order[400:800], order[800:] + nobody, [(None, None, 1e6)]]
    got, progress = admitted(spark, tmp_path, batches, limit=2, span_s=30, delay="10 seconds", buckets=4)
    named = F.coalesce("identity", F.lit(-1)).alias("identity")
    frame = spark.createDataFrame(hits + nobody, "identity long, id long, s double").select(named, "id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
    want = ordered.sliding_admission(frame, 2, 30).select("identity", "id", "admitted")
    assert rows(got.select(named, "id", "admitted")) == rows(want) and got.filter("NOT admitted").count() > 50
    assert got.filter("identity IS NULL").count() == 40  # and take no others with them
    state = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress]
    assert 4 < max(state) <= 2 * (4 + 1) and state[-1] == 1  # not two for each of 151 identities; the last hit waits


def test_cache_entries_end(spark, tmp_path):
    schema = "request_id long, image_hash string, packs_version string, tags array<string>, created_at timestamp"
    kinds = spark.createDataFrame([], schema).schema
    at = lambda request, image, s: (request, image, "v", ["b", "a"] if request % 2 else ["a", "b"], datetime.fromtimestamp(s, timezone.utc))
    batches = [[at(0, "x", 5), at(1, "x", 3), at(2, "y", 4)], [at(3, "x", 103), at(4, "x", 104), at(5, "x", 200)], [at(6, "y", 1000), at(7, "x", 1)], [at(8, "z", 9000)]]
    state = []
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(arrivals.split_late(spark.readStream.schema(kinds).parquet(f"{tmp_path}/in"), f"{tmp_path}/s", f"{tmp_path}/cs", at="created_at", delay="10 seconds"))
        q = run(streams.stream_cache(arrivals.in_time(spark, f"{tmp_path}/s", kinds), f"{tmp_path}/o", f"{tmp_path}/c", horizon_s=100, delay="10 seconds"))
        state += [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress]
    got = streams.read_cache(spark, f"{tmp_path}/o", f"{tmp_path}/s", kinds)
    # An age of exactly the horizon is served; 7 comes late and is not.
    assert sorted(map(tuple, got.collect())) == [(0, True), (1, False), (2, False), (3, True), (4, False), (5, True), (6, False), (7, False), (8, False)]
    assert state[-1] < max(state)


def test_gate(spark, split, tmp_path):
    src = intake.normalise_tags(I.requests_from(stream(spark, split, "events")))
    run(streams.stream_gate(src, I.tags(spark), f"{tmp_path}/o", f"{tmp_path}/c"))
    got = streams.read_flag(spark, f"{tmp_path}/o", "accepted")
    assert got.filter("NOT accepted").count() == I.table(spark, SF, "events").filter("event_type = 'signup'").count()


def test_a_restarted_stream_counts_nothing_twice(spark, split, tmp_path):
    for _ in range(2):
        src = I.requests_from(stream(spark, split, "events")).select("api_key_id", F.col("created_at").alias("ts"))
        run(streams.stream_usage(src, f"{tmp_path}/o", f"{tmp_path}/c"))
    got = streams.read_latest(spark, f"{tmp_path}/o", ["api_key_id", "window_start"])
    assert got.agg(F.sum("count")).first()[0] == I.table(spark, SF, "events").count()
