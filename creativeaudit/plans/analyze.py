"""From logged requests to verdicts in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creativeaudit.operators import answers, audit, intake, verdicts

CARRY = ["frame_index", "present", "score", "confidence", "band", "top_phrase", "calibrated_effective"]


def _collapsed(raw: DataFrame, thresholds: DataFrame, live: str, key: str) -> DataFrame:
    judged = verdicts.effective_calibrated(verdicts.threshold_join(verdicts.decide(raw), thresholds), live)
    return verdicts.collapse_verdicts(judged, keys=(key, "tag"), carry=CARRY)


def fully_answered(raw: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """(creative_id, tag) answered on every frame of the creative. Without ``frames``, those that ``raw`` has count."""
    sent = (raw if frames is None else frames).groupBy("creative_id").agg(F.count_distinct("frame_index").alias("n_frames"))
    per_tag = raw.groupBy("creative_id", "tag").agg(F.count_distinct("frame_index").alias("n"))
    return per_tag.join(sent, "creative_id").filter("n = n_frames").select("creative_id", "tag")


def analyze_requests(requests: DataFrame, catalog: DataFrame, stored: DataFrame, raw: DataFrame,
                     thresholds: DataFrame, live: str, frames: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts per request and tag, rejected requests); each request is in exactly one of them.

    Cheap gates run first. A request that the cache answers gets verdicts from
    the stored raw results, judged by today's rule; its creative need not be in
    ``raw``. Any other one needs an answer of its creative for each tag on
    every frame, or else it ends as INFERENCE_FAILED.

    ``requests``: request_id (unique), creative_id, image_hash, tags_csv.
    ``stored``: the audit table with results, used as cache. ``raw``: answers
    per creative, frame and tag. ``frames``: creative_id, frame_index as sent.
    Creatives and stored analyses are collapsed once, before they meet the
    requests that ask for them.
    """
    gated = answers.unknown_tag_gate(intake.normalise_tags(requests), catalog)
    gated = gated.withColumn("reject_code", F.coalesce("reject_code", F.when(~F.col("accepted"), "UNKNOWN_TAG")))
    passed = gated.filter(F.col("reject_code").isNull())
    looked_up = audit.cache_lookup(passed, stored, live)

    asked = looked_up.select("request_id", "creative_id", "hit_request_id", "cached", F.explode("tags").alias("tag"))
    hits = audit.newest_analysis(stored.filter(F.col("packs_version") == live)).select("hit_request_id", F.inline("results"))
    from_store = asked.filter("cached").join(_collapsed(hits, thresholds, live, "hit_request_id"), ["hit_request_id", "tag"])
    answered = _collapsed(raw, thresholds, live, "creative_id").join(fully_answered(raw, frames), ["creative_id", "tag"])
    fresh = asked.filter("NOT cached").join(answered, ["creative_id", "tag"])
    columns = ["request_id", "creative_id", "tag", "cached", *CARRY]
    found = from_store.select(columns).unionByName(fresh.select(columns))

    got = found.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    outcome = looked_up.select("request_id", F.size("tags").alias("wanted")).join(got, "request_id", "left")
    complete = F.col("wanted") == F.coalesce("n", F.lit(0))
    failed = outcome.filter(~complete).select("request_id", F.lit("INFERENCE_FAILED").alias("reject_code"))
    refused = gated.filter(F.col("reject_code").isNotNull()).select("request_id", "reject_code")
    return found.join(failed, "request_id", "left_anti"), refused.unionByName(failed)
