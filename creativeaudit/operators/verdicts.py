"""From raw answers to verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creativeaudit import constants as C
from creativeaudit.functions import verdict as V
from creativeaudit.operators.sizing import small_side


def decide(raw: DataFrame, high: float = C.CONFIDENCE_HIGH,
           medium: float = C.CONFIDENCE_MEDIUM) -> DataFrame:
    """Confidence, band and decided_by for each raw answer."""
    return (raw
            .withColumn("confidence", V.confidence(F.col("present"), F.col("score"), high, medium))
            .withColumn("band", V.band(F.col("present")))
            .withColumn("decided_by", F.lit(C.DECIDED_BY)))


def threshold_join(raw: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Attach calibration state; a tag without a row was never measured.

    A handful of tags share all rows, so shuffling by tag would pile them onto
    a few tasks; the threshold table travels instead as long as it is small.
    """
    t = thresholds.select(F.col("slug").alias("tag"), "calibrated", "packs_version_seen",
                          "precision", "recall")
    joined = raw.join(small_side(t), "tag", "left")
    return joined.withColumn("calibrated", F.coalesce("calibrated", F.lit(False)))


def effective_calibrated(df: DataFrame, live: str | Column | None) -> DataFrame:
    """Is the tag's calibration present and still current?"""
    live_col = live if isinstance(live, Column) else F.lit(live).cast("string")
    return df.withColumn(
        "calibrated_effective",
        V.effective_calibrated(F.col("calibrated"), F.col("packs_version_seen"), live_col))


def collapse_verdicts(verdicts: DataFrame, keys: Sequence[str] = ("creative_id", "tag"),
                      position: str = "frame_index",
                      carry: Sequence[str] | None = None) -> DataFrame:
    """A1: one verdict per creative and tag.

    Band decides before score, and on a full tie the earliest frame wins. The
    winner's columns travel together. ``max_by`` combines on the map side, so a
    creative holding a large share of the rows sends one partial row per task.
    """
    carry = [c for c in verdicts.columns if c not in keys] if carry is None else list(carry)
    order = F.struct(V.band_rank(F.col("band")).alias("r"), F.col("score").alias("s"),
                     (-F.col(position)).alias("p"))
    out = verdicts.groupBy(*keys).agg(
        F.max_by(F.struct(*carry), order).alias("w"),
        F.min(position).alias("first_position"))
    return out.select(*keys, "w.*", "first_position")


def band_counts(collapsed: DataFrame, by: str = "creative_id") -> DataFrame:
    """A2: verdicts per band."""
    return collapsed.groupBy(by).agg(
        *[F.count_if(F.col("band") == b).alias(b) for b in ("present", "uncertain", "absent")])


def frame_coverage(raw: DataFrame, considered: DataFrame) -> DataFrame:
    """A3: frames answered against distinct frames found.

    Counts come from the raw answers, so a cached answer reports what was
    really looked at. ``considered``: creative_id, considered.
    """
    seen = (raw.select("creative_id", F.coalesce("frame_index", F.lit(0)).alias("f"))
            .groupBy("creative_id").agg(F.countDistinct("f").alias("n")))
    out = considered.join(seen, "creative_id", "left")
    analyzed = F.greatest(F.lit(1).cast("bigint"), F.coalesce("n", F.lit(0)))
    return (out.withColumn("analyzed", analyzed)
            .withColumn("considered", F.greatest(F.col("considered").cast("bigint"), F.col("analyzed")))
            .withColumn("partial", F.col("considered") > F.col("analyzed"))
            .select("creative_id", "analyzed", "considered", "partial"))


def uncalibrated_tags(collapsed: DataFrame, by: str = "creative_id") -> DataFrame:
    """A4: tags of a creative whose verdict is not backed by a current measurement.

    A creative has at most one verdict per catalog tag, which bounds the list.
    Creatives without such tags give no row.
    """
    rows = collapsed.filter(~F.col("calibrated_effective"))
    ordered = F.array_sort(F.collect_list(F.struct("first_position", "tag")))
    return rows.groupBy(by).agg(F.transform(ordered, lambda s: s["tag"]).alias("tags"))


def verdict_json(verdicts: DataFrame, by: str = "creative_id") -> DataFrame:
    """The response body of each creative.

    ``crop`` and ``sigmoid`` are always present and null; ``frame`` and
    ``media`` appear only for video, ``uncalibrated_tags`` only when not empty.
    Needs: kind, frame_index, timestamp_s, top_phrase, duration_s, analyzed,
    considered next to the verdict columns.
    """
    keep_nulls = {"ignoreNullFields": "false"}
    nothing = [F.lit(None).cast("array<double>").alias("crop"), F.lit(None).cast("double").alias("sigmoid")]
    frame = F.struct(F.col("frame_index").alias("index"), F.col("timestamp_s"))
    still_evidence = F.struct(F.col("top_phrase"), *nothing)
    video_evidence = F.struct(F.col("top_phrase"), *nothing, frame.alias("frame"))

    def body(evidence: Column) -> Column:
        return F.to_json(F.struct("tag", "present", "score", "confidence", "decided_by",
                                  F.col("calibrated_effective").alias("calibrated"),
                                  evidence.alias("evidence")), keep_nulls)

    one = F.when(F.col("kind") == "video", body(video_evidence)).otherwise(body(still_evidence))
    item = F.struct("first_position", "tag", one.alias("json"),
                    F.col("calibrated_effective").alias("ok"))
    grouped = verdicts.groupBy(by).agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        F.first("kind").alias("kind"), F.max("duration_s").alias("duration_s"),
        F.max("analyzed").alias("analyzed"), F.max("considered").alias("considered"))
    results = F.concat(F.lit('"results":['),
                       F.array_join(F.transform("items", lambda i: i["json"]), ","), F.lit("]"))
    stale = F.transform(F.filter("items", lambda i: ~i["ok"]), lambda i: i["tag"])
    extra = F.when(F.size(stale) > 0, F.concat(F.lit(',"uncalibrated_tags":'), F.to_json(stale)))
    media = F.when(F.col("kind") == "video", F.concat(F.lit(',"media":'), F.to_json(F.struct(
        "kind", "duration_s", F.col("analyzed").alias("frames_analyzed"),
        F.col("considered").alias("frames_considered")), keep_nulls)))
    blank = F.lit("")
    text = F.concat(F.lit("{"), results, F.coalesce(extra, blank), F.coalesce(media, blank), F.lit("}"))
    return grouped.select(by, text.alias("body_json"))


#: What stands before the results of a response, in this order.
HEADER = ("request_id", "image_hash", "image_bytes", "model", "packs_version", "decision_version", "cached", "latency_ms")


def response_json(requests: DataFrame, verdicts: DataFrame, by: str = "request_id") -> DataFrame:
    """The whole response of each request: its header, then the body of ``verdict_json``.

    ``requests`` has the columns of HEADER, null ones are written as null. A request without verdicts gets no response.
    """
    head = F.to_json(F.struct(*HEADER), {"ignoreNullFields": "false"})
    joined = requests.select(by, head.alias("head")).join(verdict_json(verdicts, by), by)
    return joined.select(by, F.concat(F.expr("left(head, length(head) - 1)"), F.lit(","), F.expr("substring(body_json, 2)")).alias("response_json"))


def decision_version(thresholds: DataFrame, rule: str, scorer_rule: str = "") -> DataFrame:
    """Fingerprint of the rule and of every field of every threshold row.

    Rows are hashed, then the hashes of each of 4096 buckets, then those, so
    no task ever holds more than a small share of the table.
    """
    seed = "|".join([rule, str(C.CONFIDENCE_HIGH), str(C.CONFIDENCE_MEDIUM), str(C.MAX_FRAMES),
                     str(C.MIN_FRAME_GAP_S), str(C.SAME_PICTURE_MAX_MAD)] + ([scorer_rule] if scorer_rule else []))
    fallback = "fallback:=false:~:~:~"
    row = F.concat_ws(":", V.token(F.col("slug")), V.token(F.col("calibrated")),
                      V.token(F.col("packs_version_seen")), V.number_token(F.col("precision")),
                      V.number_token(F.col("recall")))
    digest = F.sha2(row, 256)
    buckets = (thresholds.select(digest.alias("d")).groupBy(F.substring("d", 1, 3).alias("b"))
               .agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("h")))
    whole = buckets.agg(F.array_join(F.sort_array(F.collect_list(
        F.concat("b", "h"))), "").alias("all"))
    text = F.concat(F.lit(seed + "|"), F.coalesce("all", F.lit("")), F.lit("|" + fallback))
    return whole.select(F.substring(F.sha2(text, 256), 1, 12).alias("decision_version"))


def verdict_display(collapsed: DataFrame) -> DataFrame:
    """O2: verdicts of each creative grouped by band, best score first.

    Numbered within (creative, band): at most one row per catalog tag.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("creative_id", "band").orderBy(
        F.col("score").desc(), F.col("first_position"), F.col("tag"))
    return collapsed.select("creative_id", "band", "tag", "score",
                            F.row_number().over(w).alias("position"))


def review_queue(collapsed: DataFrame) -> DataFrame:
    """Creatives a human has to look at, neediest first.

    Ordered by number of uncertain verdicts, then by how many low-confidence
    answers there are. The sort is Spark's range-partitioned one.
    """
    per = collapsed.groupBy("creative_id").agg(
        F.count_if(F.col("band") == "uncertain").alias("n_uncertain"),
        F.count_if(F.col("confidence") == "low").alias("n_low"),
        F.array_join(F.array_sort(F.collect_list(
            F.when(F.col("band") == "uncertain", F.col("tag")))), ",").alias("tags"))
    return (per.filter("n_uncertain > 0")
            .orderBy(F.desc("n_uncertain"), F.desc("n_low"), "creative_id"))


def redecide(audit: DataFrame, thresholds: DataFrame, live: str) -> DataFrame:
    """Apply today's rule to stored raw answers and show what it changes.

    ``audit``: request_id, results (array of raw rows), previous (map tag ->
    band at the time). The winner of each tag is picked by A1, so both have one
    order; the verdicts at the time meet it afterwards, one row per tag.
    """
    flat = audit.select("request_id", F.inline("results")).select("request_id", "tag", "frame_index", "present", "score")
    winners = collapse_verdicts(decide(flat), keys=("request_id", "tag"), carry=["band", "confidence"])
    now = effective_calibrated(threshold_join(winners, thresholds), live)
    old = audit.select("request_id", F.explode("previous").alias("tag", "old_band"))
    both = now.join(old, ["request_id", "tag"], "left")
    return both.select("request_id", "tag", "old_band", F.col("band").alias("new_band"), "confidence", "calibrated_effective",
                       (~F.col("old_band").eqNullSafe(F.col("band"))).alias("flipped"))
