"""Keys, counters, quotas and fixed-window limits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creativeaudit import constants as C
from creativeaudit.functions.numbering import floor_seconds, running
from creativeaudit.operators.sizing import small_side


def _instant(now: datetime | str) -> Column:
    return F.lit(str(now)).cast("timestamp")


def window_start(ts: Column, seconds: int = C.KEY_WINDOW_S) -> Column:
    return F.timestamp_seconds(floor_seconds(ts, seconds))


def usage_counters(requests: DataFrame, window_s: int = C.KEY_WINDOW_S) -> DataFrame:
    """Requests per key and window."""
    return requests.groupBy("api_key_id", window_start(F.col("ts"), window_s).alias("window_start")).agg(
        F.count(F.lit(1)).alias("count"))


def upsert_counters(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Insert-or-add as union and re-aggregation."""
    return stored.unionByName(fresh).groupBy("api_key_id", "window_start").agg(
        F.sum("count").alias("count"))


def usage_today(counters: DataFrame, now: datetime | str) -> DataFrame:
    """A5: units since UTC midnight for every key that has counters; 0 if none today."""
    today = F.col("window_start") >= F.date_trunc("day", _instant(now))
    return counters.groupBy("api_key_id").agg(
        F.coalesce(F.sum(F.when(today, F.col("count"))), F.lit(0)).cast("bigint").alias("requests"))


def analyses_today(audit: DataFrame, now: datetime | str) -> DataFrame:
    """Analyses, cache hits and mean latency since UTC midnight, per key."""
    today = audit.filter(F.col("created_at") >= F.date_trunc("day", _instant(now)))
    # The mean as an exact decimal, so that halves round away from zero.
    mean = F.round(F.avg(F.col("latency_ms").cast("decimal(18,0)")), 0)
    return today.groupBy("api_key_id").agg(
        F.count(F.lit(1)).alias("analyses"), F.count_if("cached").alias("cache_hits"),
        F.coalesce(mean, F.lit(0)).cast("bigint").alias("avg_latency_ms"))


def quota_charges(audit: DataFrame) -> DataFrame:
    """The charges behind A8: one unit on arrival; a fresh video owes frames-1 more when it ends.

    ``audit``: request_id, api_key_id, created_at, latency_ms, cached, frames.
    """
    done = F.timestamp_micros(F.unix_micros("created_at") + F.col("latency_ms").cast("bigint") * 1000)
    extra = F.when(~F.col("cached") & (F.col("frames") > 1), F.col("frames") - 1).otherwise(0)
    charges = F.array(
        F.struct(F.lit(0).alias("part"), F.col("created_at").alias("ts"), F.lit(1).cast("bigint").alias("units")),
        F.struct(F.lit(1).alias("part"), done.alias("ts"), extra.cast("bigint").alias("units")))
    return audit.select("request_id", "api_key_id", F.inline(charges)).filter("units > 0")


def quota_units(audit: DataFrame, window_s: int = C.KEY_WINDOW_S) -> DataFrame:
    """Units owed per key and window."""
    return quota_charges(audit).groupBy(
        "api_key_id", window_start(F.col("ts"), window_s).alias("window_start")).agg(
        F.sum("units").alias("units"))


def _with_limit(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Every row with its key's limit; limit_known is false, and nothing is left, where the key has none."""
    out = rows.join(small_side(limits.select("api_key_id", "limit")), "api_key_id", "left")
    return out.withColumn("limit_known", F.col("limit").isNotNull())


def quota_ledger(charges: DataFrame, limits: DataFrame, window_s: int = C.KEY_WINDOW_S,
                 slice_s: int = 1) -> DataFrame:
    """Running units within each key's window and what is left after each charge.

    ``limits``: api_key_id, limit. A window is cut into slices of ``slice_s``
    seconds, so that a key's busy minute spreads over tasks.
    """
    rows = charges.withColumn("window_start", window_start(F.col("ts"), window_s))
    out = running(rows, ["api_key_id", "window_start"],
                  [F.col("ts"), F.col("request_id"), F.col("part")],
                  floor_seconds(F.col("ts"), slice_s), amount=F.col("units"), name="running_units")
    return _with_limit(out, limits).withColumn("remaining", F.greatest(
        F.lit(0).cast("bigint"), F.coalesce(F.col("limit"), F.lit(0)) - F.col("running_units")))


def rate_limit_fixed(requests: DataFrame, limits: DataFrame, window_s: int = C.KEY_WINDOW_S,
                     slice_s: int = 1) -> DataFrame:
    """Fixed windows per key. Every arrival counts, also one that is refused.

    ``requests``: request_id, api_key_id, ts. ``limits``: api_key_id, limit. A
    key without a limit is refused: limit_known is false.
    """
    rows = requests.withColumn("window_start", window_start(F.col("ts"), window_s))
    out = running(rows, ["api_key_id", "window_start"], [F.col("ts"), F.col("request_id")],
                  floor_seconds(F.col("ts"), slice_s))
    out = _with_limit(out, limits)
    allowed = F.coalesce(F.col("limit"), F.lit(0))
    left_us = F.unix_micros("window_start") + window_s * 1_000_000 - F.unix_micros("ts")
    return (out.withColumn("admitted", F.col("n") <= allowed)
            .withColumn("remaining", F.greatest(F.lit(0).cast("bigint"), allowed - F.col("n")))
            .withColumn("retry_after_s", F.greatest(F.lit(1).cast("bigint"), F.ceil(left_us / 1_000_000))))


def active_keys(requests: DataFrame, keys: DataFrame, on: str = "key_hash") -> DataFrame:
    """Requests with their key; unknown and revoked keys get the same code."""
    live = keys.filter(F.col("revoked_at").isNull()).select(
        on, F.col("id").alias("key_id"), "name", "rate_limit_per_min")
    out = requests.join(small_side(live), on, "left")
    return out.withColumn("reject_code", F.when(F.col("key_id").isNull(), "INVALID_KEY"))


def masked_key(prefix_chars: Column, fixed: str = "key_") -> Column:
    return F.concat(F.lit(fixed), F.substring(prefix_chars, 1, 8), F.lit("…"))


def usage_rows_masked(keys: DataFrame, usage: DataFrame | None = None, fixed: str = "key_") -> DataFrame:
    """Keys as shown to people; neither plaintext nor hash. ``usage``: A5 output."""
    out = keys.select("id", "name", masked_key(F.col("key_prefix"), fixed).alias("masked"),
                      "rate_limit_per_min")
    if usage is None:
        return out
    today = usage.select(F.col("api_key_id").alias("id"), "requests")
    return out.join(today, "id", "left").withColumn("requests", F.coalesce("requests", F.lit(0)))


def keys_listing(keys: DataFrame, fixed: str = "key_") -> DataFrame:
    """O3: masked keys, newest first."""
    return (keys.select("id", "name", masked_key(F.col("key_prefix"), fixed).alias("masked"),
                        "rate_limit_per_min", F.col("revoked_at").isNotNull().alias("revoked"), "created_at")
            .orderBy(F.desc("created_at"), "id"))


def key_revocations(keys: DataFrame, revocations: DataFrame) -> DataFrame:
    """Set revoked_at, never delete. ``revocations``: id, at; the newest one counts."""
    latest = revocations.groupBy("id").agg(F.max("at").alias("_at"))
    return keys.join(latest, "id", "left").withColumn(
        "revoked_at", F.coalesce("_at", "revoked_at")).drop("_at")


def prune_usage(counters: DataFrame, now: datetime | str, keep_days: int = 1) -> tuple[DataFrame, DataFrame]:
    """D3: (counters kept, one row with how many were dropped)."""
    edge = _instant(now) - F.expr(f"INTERVAL {int(keep_days)} DAYS")
    old = F.col("window_start") < edge
    return counters.filter(~old), counters.agg(F.count_if(old).alias("n_deleted"))
