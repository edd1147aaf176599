"""One query per operator over the given tables.

Lists leave as joined text and instants as text, so that two engines can
compare them value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creativeaudit.functions import text as X
from creativeaudit.operators import (answers, audit, catalog, changes, evalgate, frames, intake,
                                     ordered, scoring, usage, verdicts)
from creativeaudit.plans.analyze import analyze_requests
from creativeaudit.session import fresh_path
from creativeaudit.sources import counters
from creativeaudit.sources import media as media_src
from creativeaudit.sources import requests as request_src
from creativeaudit.sources import scores as score_src
from creativeaudit.streaming import arrivals, streams
from creativeaudit.workload import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = "2024-01-20 12:00:00"
DAY_S, HOUR_S = 86400, 3600
MAD = 0.13


def query(fn: Query) -> Query:
    def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Windows and days are UTC, whatever zone the session was started with.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = in_utc
    return fn


def stamp(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def joined(c: str | Column, sep: str = ",") -> Column:
    return F.array_join(c, sep)


# ------------------------------------------------------------- verdicts


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    raw = verdicts.decide(I.raw_answers(spark, sf))
    return verdicts.effective_calibrated(verdicts.threshold_join(raw, I.thresholds(spark)), I.LIVE)


def _collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.collapse_verdicts(_judged(spark, sf), carry=[
        "frame_index", "timestamp_s", "present", "score", "confidence", "band", "top_phrase",
        "decided_by", "calibrated_effective"])


@query
def collapse_verdicts(spark, sf):
    return _collapsed(spark, sf).select("creative_id", "tag", "frame_index", "present", "score",
                                        "confidence", "band", "calibrated_effective")


@query
def decide(spark, sf):
    return verdicts.decide(I.raw_answers(spark, sf)).select(
        "creative_id", "frame_index", "tag", "score", "confidence", "band", "decided_by")


@query
def threshold_join(spark, sf):
    out = verdicts.threshold_join(I.raw_answers(spark, sf), I.thresholds(spark))
    return out.select("creative_id", "frame_index", "tag", "calibrated", "packs_version_seen", "precision", "recall")


@query
def effective_calibrated(spark, sf):
    cat = I.catalog(spark, sf).select("slug")
    rows = cat.join(I.part_thresholds(spark, sf), "slug", "left")
    return verdicts.effective_calibrated(rows, I.LIVE).select("slug", "calibrated_effective")


@query
def band_counts(spark, sf):
    return verdicts.band_counts(_collapsed(spark, sf))


@query
def frame_coverage(spark, sf):
    considered = I.frames_sent(spark, sf).groupBy("creative_id").agg(
        (F.count(F.lit(1)) - 1 + F.max(F.length("text")) % 3).alias("considered"))
    return verdicts.frame_coverage(I.raw_answers(spark, sf), considered)


@query
def uncalibrated_tags(spark, sf):
    out = verdicts.uncalibrated_tags(_collapsed(spark, sf))
    return out.select("creative_id", joined(F.array_sort("tags")).alias("tags"))


@query
def verdict_json(spark, sf):
    media = I.frames_sent(spark, sf).groupBy("creative_id").agg(
        F.when(F.count(F.lit(1)) > 4, "video").otherwise("image").alias("kind"),
        F.count(F.lit(1)).alias("analyzed"), F.count(F.lit(1)).alias("considered"),
        (F.count(F.lit(1)) * 0.5).alias("duration_s"))
    return verdicts.verdict_json(_collapsed(spark, sf).join(media, "creative_id"))


@query
def response_json(spark, sf):
    """Responses with their headers: each request has the verdicts of its own tags."""
    rows = intake.normalise_tags(I.requests(spark, sf))
    asked = rows.select("request_id", "creative_id", F.explode("tags").alias("tag")).join(_collapsed(spark, sf), ["creative_id", "tag"])
    still = asked.withColumns({"kind": F.lit("image"), "duration_s": F.lit(None).cast("double"), "analyzed": F.lit(1), "considered": F.lit(1)})
    head = rows.withColumns({"image_bytes": F.col("creative_id") * 1000 + 512, "model": F.lit("vlm"), "decision_version": F.when(F.col("packs_version") == I.LIVE, "rule-1")})
    return verdicts.response_json(head, still)


@query
def decision_version(spark, sf):
    return verdicts.decision_version(I.part_thresholds(spark, sf), "rule-1")


@query
def verdict_display(spark, sf):
    return verdicts.verdict_display(_collapsed(spark, sf))


@query
def review_queue(spark, sf):
    return verdicts.review_queue(_collapsed(spark, sf))


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    rows = _requests_with_tags(spark, sf).filter(F.size("tags") > 0)
    return audit.audit_rows(rows, I.raw_answers(spark, sf), "v1")


def _requests_with_tags(spark: SparkSession, sf: str) -> DataFrame:
    return intake.normalise_tags(I.requests(spark, sf))


@query
def redecide(spark, sf):
    # The verdicts on record come from an older rule under which a bare majority of doubt cleared a tag.
    old = F.map_from_entries(F.transform(
        F.array_distinct(F.transform("results", lambda r: r["tag"])),
        lambda t: F.struct(t, F.when(F.exists("results", lambda r: (r["tag"] == t) & r["present"]), "present")
                           .otherwise("absent"))))
    stored = _stored(spark, sf).select("request_id", "results", old.alias("previous"))
    return verdicts.redecide(stored, I.thresholds(spark), I.LIVE)


# ------------------------------------------------------------- answers


@query
def unknown_tag_gate(spark, sf):
    out = answers.unknown_tag_gate(_requests_with_tags(spark, sf), I.tags(spark))
    return out.select("request_id", joined("unknown").alias("unknown"), "accepted")


@query
def fixture_scorer(spark, sf):
    sent = I.frames_sent(spark, sf).select(
        "creative_id", "frame_index", F.sha2(F.col("text").cast("binary"), 256).alias("hash"),
        F.array(*[F.lit(t) for t in I.EVAL_TAGS]).alias("tags"))
    n = F.length("text") % 3
    fixture = I.frames_sent(spark, sf).select(
        F.sha2(F.col("text").cast("binary"), 256).alias("hash"),
        F.when(F.col("role") == "user", "alcohol").otherwise("vaping").alias("slug"),
        F.when(n == 0, True).when(n == 1, False).alias("present")).distinct()
    return answers.fixture_scorer(sent, fixture)


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """Model replies built from the turns; some are short of a tag, a frame or a proper answer."""
    c = I.frames_sent(spark, sf).withColumn("n", F.length("text"))
    tag = lambda slug, present: F.concat(
        F.lit('{"slug":"' + slug + '",'), present, F.lit('"confidence":0.'), F.lit(10) + F.col("n") % 80,
        F.lit(',"evidence":"'), F.col("role"), F.lit('"}'))
    state = (F.when(F.col("n") % 11 == 0, F.lit('"present":"true",')).when(F.col("n") % 11 == 1, F.lit(""))
             .when(F.col("n") % 3 == 0, F.lit('"present":true,')).when(F.col("n") % 3 == 1, F.lit('"present":null,'))
             .otherwise(F.lit('"present":false,')))
    second = F.when(F.col("n") % 13 == 0, F.lit("")).otherwise(F.concat(F.lit(","), tag("vaping", F.lit('"present":false,'))))
    extra = F.when(F.col("n") % 17 == 0, F.concat(F.lit(","), tag("surprise", F.lit('"present":true,')))).otherwise(F.lit(""))
    frame = F.concat(F.lit('{"index":'), F.col("frame_index"), F.lit(',"tags":['), tag("alcohol", state), second, extra, F.lit("]}"))
    kept = F.when(F.col("n") % 29 != 0, F.struct("frame_index", frame.alias("j")))
    whole = c.groupBy("creative_id").agg(F.array_sort(F.collect_list(kept)).alias("f"))
    # Some replies are no JSON at all, some have a frame without an index.
    odd = F.when(F.col("creative_id") % 17 == 4, F.array(F.lit('{"tags":[]}'))).otherwise(F.array().cast("array<string>"))
    frames_ = F.array_join(F.concat(F.transform("f", lambda x: x["j"]), odd), ",")
    return whole.select("creative_id", F.when(F.col("creative_id") % 13 == 5, "I cannot help with that").otherwise(
        F.concat(F.lit('{"frames":['), frames_, F.lit("]}"))).alias("reply_json"))


@query
def tristate_strict(spark, sf):
    return answers.tristate_strict(_replies(spark, sf)).select(
        "creative_id", "frame_index", "slug", "present", F.round("confidence", 2).alias("confidence"), "evidence", "error")


@query
def reply_completeness(spark, sf):
    wanted = I.frames_sent(spark, sf).select("creative_id").distinct().withColumn(
        "tags", F.array(F.lit("alcohol"), F.lit("vaping")))
    parsed = answers.tristate_strict(_replies(spark, sf))
    out = answers.reply_completeness(I.frames_sent(spark, sf), wanted, parsed)
    return out.select("creative_id", "complete", joined("missing").alias("missing"), joined("unexpected").alias("unexpected"))


@query
def tag_set_diff(spark, sf):
    asked = _requests_with_tags(spark, sf).withColumn(
        "seen", F.when(F.col("frames") > 3, F.array(F.lit("alcohol"), F.lit("dog"))).otherwise(F.col("tags")))
    out = answers.tag_set_diff(asked, "tags", "seen")
    return out.select("request_id", joined("missing").alias("missing"), joined("extra").alias("extra"))


@query
def tag_groups(spark, sf):
    from creativeaudit.constants import SECTIONS

    slugs = [s for _, _, members in SECTIONS for s in members]
    listed = F.array(*[F.lit(s) for s in slugs])
    named = I.catalog(spark, sf).withColumn("slug", F.when(
        F.col("sort_order") < 20, F.get(listed, F.col("sort_order"))).otherwise(F.col("slug"))).dropDuplicates(["slug"])
    out = answers.tag_groups(named.withColumn("status", F.lit("active")))
    return out.groupBy("section_no", "section", "restricted").agg(F.count(F.lit(1)).alias("n_tags"))


def _score_by_length(creative_id: int, items: list[dict], tags: list[str]) -> list[dict]:
    if any(len(f["text"]) % 23 == 0 for f in items):
        raise ValueError("frame cannot be read")
    return [{"frame_index": f["frame_index"], "tag": t, "present": None if n == 2 else n == 0, "score": n / 4,
             "top_phrase": f["role"], "decided_by": "vlm"}
            for f in items for o, t in enumerate(tags) for n in [(len(f["text"]) + o) % 4]]


@query
def score_batch(spark, sf):
    out = scoring.score_batch(I.frames_sent(spark, sf).select("creative_id", "frame_index", "text", "role"),
                              list(I.ASKED_TAGS), _score_by_length, parallelism=8)
    return out.select("creative_id", "frame_index", "tag", "present", "score", "error")


# ------------------------------------------------------------- catalog


@query
def slugify(spark, sf):
    p = I.table(spark, sf, "part").select("p_partkey", F.concat(
        F.lit("  "), F.initcap("p_name"), F.lit(" & "), "p_brand", F.lit("!! ")).alias("label"))
    return catalog.slugify(p).select("p_partkey", "slug", "usable")


@query
def validate_tags(spark, sf):
    p = I.table(spark, sf, "part")
    base = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey"))
    proposals = p.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "create").otherwise("update").alias("op"),
        base.alias("target"),
        F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("9"), base)).when(F.col("p_size") % 5 == 0, F.upper(base))
        .otherwise(F.concat(base, F.lit("_new"))).alias("slug"),
        F.when(F.col("p_size") % 11 == 0, "   ").otherwise(F.col("p_name")).alias("label"), F.col("p_type").alias("description"))
    # Half of the proposals meet a catalog with room, the others one at its usual cap, which it is above.
    roomy = catalog.validate_tags(proposals.filter("id % 2 = 0"), I.catalog(spark, sf), cap=10_000_000)
    full = catalog.validate_tags(proposals.filter("id % 2 = 1"), I.catalog(spark, sf))
    return roomy.unionByName(full).select("id", "slug", "accepted", "reject_reason")


@query
def thin_names(spark, sf):
    return catalog.thin_names(I.catalog(spark, sf))


@query
def catalog_lines(spark, sf):
    return catalog.catalog_lines(I.order_catalogs(spark, sf), ["catalog_id"])


@query
def packs_version(spark, sf):
    return catalog.packs_version(I.order_catalogs(spark, sf), "model-1", "prompt-1", ["catalog_id"])


@query
def catalog_stats(spark, sf):
    return catalog.catalog_stats(I.order_catalogs(spark, sf), ["catalog_id"])


@query
def catalog_listing(spark, sf):
    return catalog.catalog_listing(I.catalog(spark, sf), I.part_thresholds(spark, sf), I.LIVE)


@query
def catalog_changes(spark, sf):
    snapshot, log = I.change_log(spark, sf)
    _, rejected = changes.catalog_changes(snapshot, log, cap=4, by="catalog_id")
    return rejected.select("catalog_id", "seq", "op", "slug", "reject_reason")


@query
def catalog_snapshot(spark, sf):
    snapshot, log = I.change_log(spark, sf)
    after, _ = changes.catalog_changes(snapshot, log, cap=4, by="catalog_id")
    return after.select("catalog_id", "slug", "label", "description", "status", "sort_order", "updated_by", stamp("updated_at").alias("updated_at"))


# ------------------------------------------------------------- intake


@query
def media_inventory(spark, sf):
    return intake.media_inventory(I.media(spark, sf), max_image_bytes=20_000, max_video_bytes=6_000)


@query
def sniff_media(spark, sf):
    return intake.sniff_media(I.media(spark, sf)).groupBy("kind", "mime").agg(F.count(F.lit(1)).alias("n"))


@query
def intake_gate(spark, sf):
    d = I.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") == "en", "image").otherwise("video").alias("kind"),
        (F.col("n_chars") - F.col("n_chars") % 10).alias("n_bytes"), ((F.col("n_chars") % 900) / 10.0).alias("duration_s"),
        (F.col("n_chars") % 4).cast("int").alias("n_frames"))
    return intake.intake_gate(d, max_image_bytes=4_000, max_video_bytes=9_000).select("doc_id", "reject_code")


@query
def content_dedupe(spark, sf):
    d = I.table(spark, sf, "documents").select(
        F.sha2(F.col("text").cast("binary"), 256).alias("media_hash"), F.col("doc_id").alias("id"),
        F.col("doc_id").alias("submitted_at"))
    return intake.content_dedupe(d).select("media_hash", "first_id", "n_copies")


@query
def url_guard(spark, sf):
    out = intake.url_guard(I.fetch_urls(spark, sf), addresses="addresses")
    return out.select("page_id", "scheme", "host", "allowed", "reject_code")


@query
def request_intake(spark, sf):
    d = I.table(spark, sf, "documents")
    enc = F.replace(F.base64(F.col("text").cast("binary")), F.lit("\r\n"), F.lit(""))
    text = F.col("source")
    body = (F.when(text < "src13", F.to_json(F.struct(enc.alias("media_base64"), F.lit("alcohol, vaping ,, alcohol").alias("tags"))))
            .when(text < "src16", F.to_json(F.struct(F.concat(F.lit("data:image/png;base64,"), enc).alias("image_base64"),
                                                     F.array(F.lit(" dog "), F.lit("dog")).alias("tags"))))
            .when(text < "src2", F.to_json(F.struct(F.lit(" ").alias("media_base64"), F.lit(" http://a.example/x ").alias("image_url"), F.lit("dog").alias("tags"))))
            .when(text < "src4", F.to_json(F.struct(F.concat(enc, F.lit("*")).alias("media_base64"), F.lit("dog").alias("tags"))))
            .when(text < "src6", F.to_json(F.struct(enc.alias("media_base64"), F.lit(" , ").alias("tags"))))
            .when(text < "src8", F.to_json(F.struct(F.lit("dog").alias("tags")))).otherwise(F.lit("[not an object")))
    out = request_src.request_intake(d.select(F.col("doc_id").alias("request_id"), body.alias("body_json")))
    return out.select("request_id", joined("tags").alias("tags"), F.sha2("media", 256).alias("media_hash"), "media_url", "reject_code")


@query
def normalise_tags(spark, sf):
    out = _requests_with_tags(spark, sf)
    return out.select("request_id", joined("tags").alias("tags"), "reject_code")


@query
def client_identity(spark, sf):
    a = I.access(spark, sf)
    return a.select("event_id", X.client_identity(F.col("peer"), F.col("xff"), 0).alias("hops0"),
                    X.client_identity(F.col("peer"), F.col("xff"), 1).alias("hops1"),
                    X.client_identity(F.col("peer"), F.col("xff"), 5).alias("hops5"))


@query
def tag_key(spark, sf):
    return _requests_with_tags(spark, sf).groupBy(joined(X.tag_key(F.col("tags"))).alias("tag_key")).agg(
        F.count(F.lit(1)).alias("requests"))


@query
def rejects(spark, sf):
    # One pass in the order of the service: key, rate limit of valid keys, intake, tags. The first code counts.
    asked = _requests_with_tags(spark, sf).withColumnRenamed("reject_code", "intake_code").withColumn("ts", F.col("created_at"))
    live = I.keys(spark, sf).filter("revoked_at IS NULL").select(F.col("id").alias("api_key_id"), F.col("rate_limit_per_min").alias("limit"))
    judged = usage.rate_limit_fixed(asked, live, DAY_S)
    judged = answers.unknown_tag_gate(judged, I.tags(spark))
    judged = judged.select("request_id", F.when(~F.col("limit_known"), "INVALID_KEY").alias("key_code"),
                           F.when(~F.col("admitted"), "RATE_LIMITED").alias("rate_code"), "intake_code",
                           F.when(~F.col("accepted"), "UNKNOWN_TAG").alias("tag_code"))
    out = intake.first_reject(judged, "key_code", "rate_code", "intake_code", "tag_code")
    return out.select("request_id", "code", "status")


# ------------------------------------------------------------- frames


@query
def frame_thin(spark, sf):
    return frames.frame_thin(I.frames(spark, sf)).select("creative_id", "frame_id")


@query
def frame_select(spark, sf):
    found = I.frames(spark, sf)
    # Some creatives gave no frame at all.
    silent = found.filter("frame_id % 90 = 0").select((-F.col("frame_id") - 1).alias("creative_id"))
    out = frames.frame_select(found, max_mad=MAD, creatives=found.select("creative_id").unionByName(silent))
    return out.select("creative_id", "frame_id", "considered", "reject_code")


@query
def near_duplicate_frames(spark, sf):
    return frames.near_duplicate_frames(I.frames(spark, sf), max_mad=MAD).withColumn("mad", F.round("mad", 6))


@query
def frame_fallback_merge(spark, sf):
    every = I.frames(spark, sf).select("creative_id", "frame_id", "timestamp_s", (F.get("signature", F.lit(0)) > 0.2).alias("key"))
    keyframes = every.filter("key").drop("key")
    return frames.frame_fallback_merge(keyframes, every.drop("key")).select("creative_id", "frame_id")


@query
def payload_dedupe(spark, sf):
    c = I.frames_sent(spark, sf).select(
        "creative_id", F.col("frame_index").alias("frame_id"), (F.col("frame_index") * 0.5).alias("timestamp_s"),
        F.sha2(F.concat("role", "text").cast("binary"), 256).alias("payload_hash"))
    return frames.payload_dedupe(c).select("creative_id", "frame_id", "frame_index")


# ------------------------------------------------------------- audit


@query
def cache_lookup(spark, sf):
    rows = _requests_with_tags(spark, sf)
    stored = rows.filter(F.col("created_at") < F.lit("2024-01-20").cast("timestamp"))
    fresh = rows.filter(F.col("created_at") >= F.lit("2024-01-20").cast("timestamp")).drop("cached", "packs_version")
    return audit.cache_lookup(fresh, stored, I.LIVE).select("request_id", "hit_request_id", "cached")


@query
def audit_rows(spark, sf):
    out = _stored(spark, sf)
    return out.select("request_id", "image_hash", joined("tags_requested").alias("tags_requested"),
                      F.size("results").alias("n_rows"), joined(F.transform("results", lambda r: F.concat_ws(
                          ":", r["frame_index"].cast("string"), r["tag"], F.coalesce(r["present"].cast("string"), F.lit("null")),
                          F.round(r["score"] * 20).cast("int").cast("string"), r["top_phrase"])), "|").alias("rows"),
                      "packs_version", "latency_ms", "cached", F.col("created_date").cast("string").alias("created_date"))


@query
def audit_by_key(spark, sf):
    known = I.keys(spark, sf).filter("revoked_at IS NULL")
    return audit.audit_by_key(I.requests(spark, sf), known)


@query
def integrity_checks(spark, sf):
    names = ["orders", "customer", "lineitem", "labels", "documents", "part", "region", "nation"]
    return audit.integrity_checks(
        {n: I.table(spark, sf, n) for n in names},
        unique=[("orders", ["o_orderkey"]), ("customer", ["c_custkey"]), ("lineitem", ["l_orderkey", "l_linenumber"]),
                ("labels", ["doc_id"]), ("documents", ["text"])],
        not_null=[("lineitem", ["l_quantity", "l_shipdate"]), ("customer", ["c_name"])],
        foreign=[("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"),
                 ("labels", "doc_id", "documents", "doc_id"), ("documents", "doc_id", "labels", "doc_id")],
        singleton=["region"])


# ------------------------------------------------------------- usage


def _arrivals(spark: SparkSession, sf: str) -> DataFrame:
    return I.requests(spark, sf).select("request_id", "api_key_id", F.col("created_at").alias("ts"))


@query
def usage_counters(spark, sf):
    out = usage.usage_counters(_arrivals(spark, sf))
    return out.select("api_key_id", stamp("window_start").alias("window_start"), "count")


@query
def usage_today(spark, sf):
    return usage.usage_today(usage.usage_counters(_arrivals(spark, sf)), NOW)


@query
def analyses_today(spark, sf):
    return usage.analyses_today(I.requests(spark, sf), NOW)


@query
def quota_units(spark, sf):
    out = usage.quota_units(I.requests(spark, sf))
    return out.select("api_key_id", stamp("window_start").alias("window_start"), "units")


@query
def quota_ledger(spark, sf):
    charges = usage.quota_charges(I.requests(spark, sf))
    return usage.quota_ledger(charges, I.limits(spark, sf), DAY_S).select("request_id", "part", "running_units", "limit_known", "remaining")


def _fixed_window(spark: SparkSession, sf: str) -> DataFrame:
    return usage.rate_limit_fixed(_arrivals(spark, sf), I.limits(spark, sf), DAY_S)


@query
def rate_limit_fixed(spark, sf):
    return _fixed_window(spark, sf).select("request_id", "n", "limit_known", "admitted", "remaining", "retry_after_s")


@query
def sliding_admission(spark, sf):
    return ordered.sliding_admission(I.hits_from(I.table(spark, sf, "events")), 2, 10 * HOUR_S).select("identity", "id", "admitted")


@query
def login_lockout(spark, sf):
    e = I.table(spark, sf, "events")
    attempts = I.hits_from(e).withColumn("success", F.lit(False))
    attempts = e.select(F.col("user_id").alias("identity"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"),
                        (F.col("event_type") == "purchase").alias("success"))
    return ordered.login_lockout(attempts, 4, 3 * DAY_S).select("identity", "id", "locked")


def _authenticated(spark: SparkSession, sf: str) -> DataFrame:
    presented = I.requests(spark, sf).withColumn(
        "key_hash", F.sha2(F.concat(F.lit("key"), F.col("api_key_id")).cast("binary"), 256))
    return usage.active_keys(presented, I.keys(spark, sf))


@query
def active_keys(spark, sf):
    return _authenticated(spark, sf).select("request_id", "key_id", "name", "reject_code")


@query
def usage_rows_masked(spark, sf):
    today = usage.usage_today(usage.usage_counters(_arrivals(spark, sf)), NOW)
    return usage.usage_rows_masked(I.keys(spark, sf), today)


@query
def keys_listing(spark, sf):
    return usage.keys_listing(I.keys(spark, sf)).select("id", "name", "masked", "revoked", stamp("created_at").alias("created_at"))


@query
def key_revocations(spark, sf):
    revoked = I.requests(spark, sf).filter("tags_csv = 'junk_food' AND frames = 6").select(
        F.col("api_key_id").alias("id"), F.col("created_at").alias("at"))
    return usage.key_revocations(I.keys(spark, sf), revoked).select("id", stamp("revoked_at").alias("revoked_at"))


@query
def prune_usage(spark, sf):
    kept, _ = usage.prune_usage(usage.usage_counters(_arrivals(spark, sf)), NOW)
    return kept.select("api_key_id", stamp("window_start").alias("window_start"), "count")


@query
def prune_usage_deleted(spark, sf):
    return usage.prune_usage(usage.usage_counters(_arrivals(spark, sf)), NOW)[1]


@query
def counters_stored(spark, sf):
    """A stored table to which two days are added, and from which what is older than a day is pruned."""
    path = fresh_path(spark, "counters")
    rows = I.requests(spark, sf).select("request_id", "api_key_id", F.col("created_at").alias("ts"))
    counters.create_counters(usage.usage_counters(rows.filter("request_id % 3 <> 0")), path)
    counters.upsert(usage.usage_counters(rows.filter("request_id % 3 = 0 AND ts >= '2024-01-19' AND ts < '2024-01-21'")), path)
    counters.prune(spark, path, NOW)
    return counters.read_counters(spark, path).select("api_key_id", stamp("window_start").alias("window_start"), "count")


# ------------------------------------------------------------- evaluation


@query
def eval_discover(spark, sf):
    return media_src.eval_discover(I.eval_paths(spark, sf))


@query
def smoke_limit(spark, sf):
    return evalgate.smoke_limit(media_src.eval_discover(I.eval_paths(spark, sf)), 25)


@query
def banked_scores(spark, sf):
    s = I.scored(spark, sf)
    docs = s.select(F.to_json(F.create_map("arm", F.create_map("path", F.struct(
        "path", "owner", "label", "bands", "evidence", "latency_ms")))).alias("json"))
    return score_src.banked_scores(docs).select(
        "arm", "path", "owner", "label", "latency_ms", F.try_element_at("bands", F.lit("alcohol")).alias("alcohol_band"),
        F.try_element_at("evidence", F.col("owner")).alias("own_evidence"))


@query
def phrase_stats(spark, sf):
    c = I.frames_sent(spark, sf)
    side = lambda role: F.collect_list(F.when(F.col("role") == role, F.col("text")))
    docs = c.groupBy("creative_id").agg(side("user").alias("positives"), side("assistant").alias("negatives")).select(
        F.to_json(F.struct(F.array(F.struct(
            F.concat(F.lit("tag_"), "creative_id").alias("slug"), F.lit("x").alias("label"), "positives", "negatives")).alias("tags"))).alias("json"))
    return score_src.phrase_stats(docs)


@query
def cross_fire(spark, sf):
    out = evalgate.cross_fire(I.scored(spark, sf), I.active_tags(spark))
    return out.select("arm", F.coalesce("tag", F.lit("(all)")).alias("tag"), "false_blocks")


@query
def recall_by_tag(spark, sf):
    return evalgate.recall_by_tag(I.scored(spark, sf), I.active_tags(spark)).withColumn("recall", F.round("recall", 6))


@query
def mean_recall(spark, sf):
    return evalgate.mean_recall(evalgate.recall_by_tag(I.scored(spark, sf), I.active_tags(spark)))


@query
def uncertain_positive_rate(spark, sf):
    s = I.scored(spark, sf)
    return evalgate.uncertain_positive_rate(s, evalgate.recall_by_tag(s, I.active_tags(spark)))


@query
def latency_percentiles(spark, sf):
    items = I.table(spark, sf, "documents").select(F.col("source").alias("arm"), F.col("n_chars").alias("latency_ms"))
    return evalgate.latency_percentiles(items)


GATE = ["arm", "images", "tags", "cross_tag_false_blocks", "mean_recall", "uncertain_positive_rate", "p50", "p95", "max"]


@query
def gate_report(spark, sf):
    return evalgate.gate_report(I.scored(spark, sf), I.active_tags(spark)).select(*GATE)


def _comparison(spark: SparkSession, sf: str) -> DataFrame:
    report = evalgate.gate_report(I.scored(spark, sf), I.active_tags(spark)).select(*GATE)
    return evalgate.gate_compare_join(report.filter("arm = 'baseline'"), report.filter("arm = 'candidate'"))


@query
def gate_compare_join(spark, sf):
    return _comparison(spark, sf)


@query
def gate_verdict(spark, sf):
    return evalgate.gate_verdict(_comparison(spark, sf))


@query
def gate_report_merge(spark, sf):
    s = I.scored(spark, sf)
    report = evalgate.gate_report(s, I.active_tags(spark)).select("arm", "images", "cross_tag_false_blocks")
    existing = report.withColumn("images", F.lit(-1).cast("bigint"))
    return evalgate.gate_report_merge(existing, report.filter("arm = 'candidate'"))


@query
def label_disagreements(spark, sf):
    out = evalgate.label_disagreements(I.scored(spark, sf))
    return out


@query
def eval_coverage(spark, sf):
    golden = I.scored(spark, sf).filter("bands[owner] = 'present' AND latency_ms > 12000").select(F.col("owner").alias("slug"))
    return evalgate.eval_coverage(media_src.eval_discover(I.eval_paths(spark, sf)), golden)


@query
def worst_cross_tags(spark, sf):
    return evalgate.worst_cross_tags(evalgate.cross_fire(I.scored(spark, sf), I.active_tags(spark)))


@query
def tags_without_positives(spark, sf):
    return evalgate.tags_without_positives(I.scored(spark, sf), I.active_tags(spark))


@query
def arms_union(spark, sf):
    s = I.scored(spark, sf).withColumn("source", F.element_at("evidence", F.col("owner"))).drop("evidence")
    both = evalgate.arms_union(s.filter("arm = 'baseline'").drop("source"), s.filter("arm = 'candidate'"))
    return both.select("arm", "source", F.explode("bands").alias("tag", "band")).groupBy("arm", "source", "band").agg(
        F.count(F.lit(1)).alias("n"))


@query
def resume_todo(spark, sf):
    found = media_src.eval_discover(I.eval_paths(spark, sf))
    done = found.filter("owner <> 'vaping' OR NOT label").select("path", F.when(
        F.col("owner") == "alcohol", "baseline").otherwise("candidate").alias("arm"))
    return evalgate.resume_todo(found, done, "candidate")


# ------------------------------------------------------------- streams


def _slices(rows: DataFrame, by: str, n: int, last: str = "false") -> list[DataFrame]:
    """``rows`` cut into ``n`` even ranges of ``by``, the earliest first; rows without it are in the last of them.

    Rows for which ``last`` (SQL) holds are a further slice at the end.
    """
    usual = rows.filter(~F.expr(last))
    lo, hi = usual.agg(F.min(F.expr(by)), F.max(F.expr(by))).first()
    edges = [] if lo is None else [lo + (hi - lo) / n * (i + 1) for i in range(n - 1)]
    nth = F.lit(n - 1)
    for i in reversed(range(len(edges))):
        nth = F.when(F.expr(by) < F.lit(edges[i]), F.lit(i)).otherwise(nth)
    usual = usual.withColumn("_nth", nth)
    out = [usual.filter(F.col("_nth") == i).drop("_nth") for i in range(n)]
    return out if last == "false" else [*out, rows.filter(F.expr(last))]


def _feed(spark: SparkSession, name: str, slices: list[DataFrame], *steps: Callable[[DataFrame], object]) -> None:
    """Each slice, in all its partitions, becomes one micro-batch of a stream; ``steps`` start what reads it, one after the other."""
    source = fresh_path(spark, f"source-{name}")
    for part in slices:
        part.write.mode("append").parquet(source)
        for step in steps:
            step(spark.readStream.schema(slices[0].schema).parquet(source)).awaitTermination()


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    base = fresh_path(spark, name)
    return f"{base}/out", f"{base}/state"


@query
def stream_usage(spark, sf):
    out, state = _paths(spark, "usage")
    _feed(spark, "events", _slices(I.table(spark, sf, "events"), "ts", 3), lambda events: streams.stream_usage(
        I.requests_from(events).select("api_key_id", F.col("created_at").alias("ts")), out, state))
    latest = streams.read_latest(spark, out, ["api_key_id", "window_start"])
    return latest.select("api_key_id", stamp("window_start").alias("window_start"), "count")


@query
def stream_late(spark, sf):
    """Units in time, and the late charges, together all that was charged."""
    out, state = _paths(spark, "quota")
    split, split_state = _paths(spark, "charges")
    charges = usage.quota_charges(I.requests(spark, sf)).schema
    # The requests of the first morning arrive weeks later, after the watermark has passed them.
    slices = _slices(I.table(spark, sf, "events"), "ts", 3, "ts < TIMESTAMP_NTZ '2024-01-01 06:00:00'")
    _feed(spark, "events", slices,
          lambda events: arrivals.split_late(usage.quota_charges(I.requests_from(events)), split, split_state),
          lambda _: streams.stream_units(arrivals.in_time(spark, split, charges), out, state))
    kept = streams.read_latest(spark, out, ["api_key_id", "window_start"]).withColumn("late", F.lit(False))
    late = arrivals.late_rows(spark, split, charges).groupBy("api_key_id", usage.window_start(F.col("ts")).alias("window_start")).agg(
        F.sum("units").alias("units")).withColumn("late", F.lit(True))
    return kept.unionByName(late).select("api_key_id", stamp("window_start").alias("window_start"), "units", "late")


@query
def stream_collapse(spark, sf):
    out, state = _paths(spark, "collapse")
    _feed(spark, "conversations", _slices(I.table(spark, sf, "conversations"), "conv_id", 3), lambda turns: streams.stream_collapse(
        I.raw_from(turns).withColumn("ts", F.timestamp_seconds(F.col("creative_id") * 60 + F.col("frame_index"))),
        out, state, thresholds=I.thresholds, live=I.LIVE))
    return streams.read_collapsed(spark, out).select(
        "creative_id", "tag", "frame_index", "present", "score", "confidence", "band", "calibrated_effective")


@query
def stream_admission(spark, sf):
    """Hits that come up to three hours out of order, some weeks late."""
    out, state = _paths(spark, "admission")
    split, split_state = _paths(spark, "hits")
    events = I.table(spark, sf, "events")
    hits = I.hits_from(events).schema
    slices = _slices(events, "ts + make_interval(0, 0, 0, 0, CAST(event_id % 4 AS INT))", 3, "event_id % 97 = 5 AND ts < TIMESTAMP_NTZ '2024-01-20'")
    # Nobody's hit, years later, lets the watermark pass all others.
    end = events.limit(1).select(*[F.col(c) if c != "user_id" else F.lit(None).cast("long").alias(c) for c in events.columns]).withColumn(
        "ts", F.expr("ts + INTERVAL 10 YEARS"))
    _feed(spark, "events", [*slices, end],
          lambda rows: arrivals.split_late(I.hits_from(rows), split, split_state, delay="4 hours"),
          lambda _: streams.stream_admission(arrivals.in_time(spark, split, hits), out, state, limit=2, span_s=10 * HOUR_S, delay="4 hours"))
    return streams.read_admission(spark, out, split, hits).select("identity", "id", "admitted", "reject_code")


@query
def stream_cache(spark, sf):
    """Entries serve for three days; some requests come weeks late and are not served."""
    out, state = _paths(spark, "cache")
    split, split_state = _paths(spark, "requests")
    asked = lambda events: intake.normalise_tags(I.requests_from(events)).drop("cached")
    events = I.table(spark, sf, "events")
    _feed(spark, "events", _slices(events, "ts", 3, "event_id % 89 = 7 AND ts < TIMESTAMP_NTZ '2024-01-20'"),
          lambda rows: arrivals.split_late(asked(rows), split, split_state, at="created_at"),
          lambda _: streams.stream_cache(arrivals.in_time(spark, split, asked(events).schema), out, state, horizon_s=3 * DAY_S, delay="1 day"))
    return streams.read_cache(spark, out, split, asked(events).schema)


@query
def stream_gate(spark, sf):
    out, state = _paths(spark, "gate")
    _feed(spark, "events", _slices(I.table(spark, sf, "events"), "ts", 3), lambda events: streams.stream_gate(
        intake.normalise_tags(I.requests_from(events)), I.tags(spark), out, state))
    return streams.read_flag(spark, out, "accepted").select("request_id", joined("unknown").alias("unknown"), "accepted")


# ------------------------------------------------------------- end to end


@query
def analyze(spark, sf):
    """Every request, answered or rejected. Some creatives have no answers left, some lack a tag on a frame."""
    rows = I.requests(spark, sf).drop("cached", "packs_version")
    past = _requests_with_tags(spark, sf).filter((F.col("created_at") < F.lit("2024-01-20").cast("timestamp")) & (F.col("packs_version") == I.LIVE))
    everything = I.raw_answers(spark, sf)
    stored = audit.audit_rows(past.filter("creative_id % 3 <> 0"), everything.withColumn("top_phrase", F.lit("stored")), I.LIVE).withColumnRenamed("tags_requested", "tags")
    raw = everything.filter("creative_id % 11 <> 0 AND NOT (creative_id % 7 = 3 AND tag = 'vaping' AND frame_index % 2 = 1)")
    answered, rejected = analyze_requests(rows, I.tags(spark), stored, raw, I.thresholds(spark), I.LIVE)
    out = answered.select("request_id", "tag", "frame_index", "band", "score", "confidence", "top_phrase", "calibrated_effective", "cached",
                          F.lit(None).cast("string").alias("reject_code"))
    return out.unionByName(rejected, allowMissingColumns=True)
