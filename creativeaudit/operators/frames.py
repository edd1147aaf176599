"""Choosing which frames of a creative are worth scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creativeaudit import constants as C
from creativeaudit.functions.numbering import running
from creativeaudit.operators.ordered import MAX_ROWS, mark_frames

SLICE_S = 10


def _slice(ts: str) -> Column:
    return F.floor(F.col(ts) / SLICE_S).cast("bigint")


def spread_positions(total: Column, count: int) -> Column:
    """``count`` positions spread over 0..total-1, first and last included, halves to even."""
    if count < 2:
        return F.array(F.lit(0).cast("bigint"))
    step = (total - 1).cast("double") / (count - 1)
    picked = F.transform(F.sequence(F.lit(0), F.lit(count - 1)),
                         lambda i: F.bround(i * step, 0).cast("bigint"))
    return F.when(total <= count, F.sequence(F.lit(0).cast("bigint"), total - 1)).otherwise(
        F.array_distinct(picked))


def _spread(frames: DataFrame, count: int) -> DataFrame:
    numbered = running(frames, ["creative_id"], [F.col("timestamp_s"), F.col("frame_id")],
                       _slice("timestamp_s"), name="_nth", total="_total")
    chosen = F.array_contains(spread_positions(F.col("_total"), count), F.col("_nth") - 1)
    return numbered.filter(chosen).drop("_nth", "_total")


def frame_thin(frames: DataFrame, limit: int = C.MAX_FRAMES) -> DataFrame:
    """At most ``limit`` frames per creative, evenly spread, both ends kept."""
    return _spread(frames, limit)


def frame_select(frames: DataFrame, gap_s: float = C.MIN_FRAME_GAP_S,
                 max_mad: float = C.SAME_PICTURE_MAX_MAD, limit: int = C.MAX_FRAMES,
                 max_rows: int = MAX_ROWS, creatives: DataFrame | None = None) -> DataFrame:
    """Distinct frames in time order, capped by W4.

    ``considered`` counts the distinct frames before the cap, so partial
    coverage can be told from full coverage. ``creatives`` (creative_id) names
    what frames were sought in: one without any has a row with reject_code
    INVALID_VIDEO, which is NULL otherwise.
    """
    marked = mark_frames(frames, gap_s, max_mad, max_rows).filter("kept").drop("kept", "same_as", "mad")
    numbered = running(marked, ["creative_id"], [F.col("timestamp_s"), F.col("frame_id")],
                       _slice("timestamp_s"), name="_nth", total="considered")
    chosen = F.array_contains(spread_positions(F.col("considered"), limit), F.col("_nth") - 1)
    out = numbered.filter(chosen).drop("_nth").withColumn("reject_code", F.lit(None).cast("string"))
    if creatives is None:
        return out
    empty = creatives.select("creative_id").distinct().join(frames.select("creative_id").distinct(), "creative_id", "left_anti")
    empty = empty.select("creative_id", F.lit(0).cast("bigint").alias("considered"), F.lit("INVALID_VIDEO").alias("reject_code"))
    return out.unionByName(empty, allowMissingColumns=True)


def near_duplicate_frames(frames: DataFrame, max_mad: float = C.SAME_PICTURE_MAX_MAD,
                          max_rows: int = MAX_ROWS) -> DataFrame:
    """Frames that show the same picture as an earlier kept frame of their creative.

    One row per repeated frame, linked to the first kept frame it resembles;
    not every pair of a group, whose number grows with its square.
    """
    marked = mark_frames(frames, 0.0, max_mad, max_rows)
    return marked.filter(F.col("same_as").isNotNull()).select("creative_id", "same_as", "frame_id", "mad")


def frame_fallback_merge(keyframes: DataFrame, all_frames: DataFrame,
                         count: int = C.MAX_FRAMES) -> DataFrame:
    """Creatives with fewer than two keyframes get evenly spread frames as well.

    A spread frame at the millisecond of a keyframe is not taken again. Works
    on any duration, also an undeclared one.
    """
    keys = keyframes.groupBy("creative_id").agg(F.count(F.lit(1)).alias("n"))
    enough = keys.filter("n >= 2").select("creative_id")
    poor = all_frames.join(enough, "creative_id", "left_anti").select(*all_frames.columns)
    millis = F.round(F.col("timestamp_s") * 1000).cast("bigint")
    taken = keyframes.select("creative_id", millis.alias("_ms")).distinct()
    extra = _spread(poor, count).withColumn("_ms", millis).join(
        taken, ["creative_id", "_ms"], "left_anti").drop("_ms")
    return keyframes.unionByName(extra.select(*keyframes.columns))


def payload_dedupe(frames: DataFrame) -> DataFrame:
    """One frame per payload within a creative, survivors numbered from 0.

    ``frames``: creative_id, frame_id, timestamp_s, payload_hash. The first
    frame of each payload is found by a combining aggregate.
    """
    first = frames.groupBy("creative_id", "payload_hash").agg(
        F.min(F.struct("timestamp_s", "frame_id")).alias("f"))
    kept = first.select("creative_id", "payload_hash", "f.timestamp_s", "f.frame_id")
    numbered = running(kept, ["creative_id"], [F.col("timestamp_s"), F.col("frame_id")],
                       _slice("timestamp_s"), name="_nth")
    return numbered.withColumn("frame_index", F.col("_nth") - 1).drop("_nth")
