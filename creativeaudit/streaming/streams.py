"""T1-T6. Each stream writes a table whose content equals its batch twin.

Sinks write one directory per micro-batch and overwrite it when the batch is
repeated after a failure, so every batch counts once. Readers take the newest
version of each key. ``path`` and ``checkpoint`` belong in the shared folder
of the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from creativeaudit import constants as C
from creativeaudit.functions import verdict as V
from creativeaudit.operators import answers, audit, usage
from creativeaudit.operators.ordered import sliding_step
from creativeaudit.operators.verdicts import collapse_verdicts, decide, effective_calibrated, threshold_join
from creativeaudit.streaming.arrivals import late_rows

DAY = "1 day"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _sink(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _start(stream: DataFrame, write, checkpoint: str, mode: str, trigger: dict | None) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


@contextmanager
def _rocksdb(spark: SparkSession):
    """State with timers and lifetimes needs this store; a stream keeps the one that it was started with."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version of each key in an update-mode sink."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), "batch")
    return rows.groupBy(*keys).agg(newest.alias("v")).select(*keys, "v.*")


def stream_usage(requests: DataFrame, path: str, checkpoint: str, *, window: str = "1 minute",
                 late: str = DAY, trigger: dict | None = None) -> StreamingQuery:
    """Requests per key and minute. State older than the watermark is dropped."""
    counts = (requests.withWatermark("ts", late)
              .groupBy("api_key_id", F.window("ts", window)).agg(F.count(F.lit(1)).alias("count"))
              .select("api_key_id", F.col("window.start").alias("window_start"), "count"))
    return _start(counts, _sink(path), checkpoint, "update", trigger)


def stream_units(charges: DataFrame, path: str, checkpoint: str, *, window: str = "1 minute",
                 late: str = DAY, trigger: dict | None = None) -> StreamingQuery:
    """Units per key and minute of ``usage.quota_charges``; top-ups are booked when the request ends.

    Charges older than a day behind the newest one are dropped by the
    watermark; ``dropped_late`` reports how many. Feed it with
    ``arrivals.in_time`` to have them as rows.
    """
    units = (charges.withWatermark("ts", late)
             .groupBy("api_key_id", F.window("ts", window)).agg(F.sum("units").alias("units"))
             .select("api_key_id", F.col("window.start").alias("window_start"), "units"))
    return _start(units, _sink(path), checkpoint, "update", trigger)


def stream_quota(audited: DataFrame, path: str, checkpoint: str, **how) -> StreamingQuery:
    """T6 from requests."""
    return stream_units(usage.quota_charges(audited), path, checkpoint, **how)


def dropped_late(query: StreamingQuery) -> int:
    """Rows a finished or running query has dropped for being too late."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def stream_collapse(raw: DataFrame, path: str, checkpoint: str, *, thresholds: Callable[[SparkSession], DataFrame] | None = None,
                    live: str | None = None, late: str = DAY, trigger: dict | None = None) -> StreamingQuery:
    """Decide frames as they arrive and collapse them per creative, tag and day.

    The day lets the watermark drop finished creatives from the state.
    ``raw`` carries an event time ``ts``. ``thresholds`` loads the calibration
    table; it is asked for every micro-batch, so that a verdict has the state
    of its tag at the time of its latest frame.
    """
    order = F.struct(V.band_rank(F.col("band")).alias("r"), F.col("score").alias("s"),
                     (-F.col("frame_index")).alias("p"))
    winner = F.max_by(F.struct("frame_index", "present", "score", "top_phrase", "confidence", "band"), order)
    daily = (decide(raw).withWatermark("ts", late)
             .groupBy("creative_id", "tag", F.window("ts", DAY))
             .agg(winner.alias("w"), F.min("frame_index").alias("first_seen"))
             .select("creative_id", "tag", F.col("window.start").alias("day"), "w.*", "first_seen"))

    def write(batch: DataFrame, batch_id: int) -> None:
        if thresholds is not None:
            joined = effective_calibrated(threshold_join(batch, thresholds(batch.sparkSession)), live)
            batch = joined.select(*batch.columns, "calibrated_effective")
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(daily, write, checkpoint, "update", trigger)


def read_collapsed(spark: SparkSession, path: str) -> DataFrame:
    """T2 result: collapse is associative, so the days' winners collapse once more."""
    days = read_latest(spark, path, ["creative_id", "tag", "day"])
    first = days.groupBy("creative_id", "tag").agg(F.min("first_seen").alias("first_position"))
    winners = collapse_verdicts(days.drop("first_seen", "day"))
    return winners.drop("first_position").join(first, ["creative_id", "tag"])


class _Admission(StatefulProcessor):
    """Hits wait until the watermark has passed them, and are judged in their order; then an idle identity is forgotten.

    A call serves all identities of a bucket, as each access to the state is a round trip to the JVM. Hits wait as blocks
    of ``COLUMNS``, one per batch of input; ``live`` has the identities and instants that still count.
    """

    COLUMNS = ("identity", "ts_us", "has_id", "id")

    def __init__(self, limit: int, span_us: int) -> None:
        self.span, self.step = span_us, sliding_step(limit, span_us)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "hits binary")
        self.live = handle.getValueState("live", "instants binary")

    def _wake(self, at_us: int) -> None:
        self.handle.registerTimer(at_us // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.waiting.appendValue((_packed([pdf[c].astype("int64") for c in self.COLUMNS]),))
            self._wake(int(pdf["ts_us"].min()))
        return iter(())

    def _judge(self, live: dict[int, list[int]], who: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether hits, sorted by identity and then in their order, are admitted; ``live`` goes on with them."""
        admitted = np.zeros(len(who), bool)
        bounds = [*np.flatnonzero(np.diff(who, prepend=who[:1] - 1)).tolist(), len(who)]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            identity = int(who[lo])
            made, live[identity] = self.step(live.get(identity, []), {"_at": at[lo:hi]})
            admitted[lo:hi] = made["admitted"]
        return admitted

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        hits = np.concatenate([_unpacked(None, 4), *(_unpacked(r[0], 4) for r in self.waiting.get())], axis=1)
        due, later = hits[:, hits[1] < now], hits[:, hits[1] >= now]
        due = due[:, np.lexsort(due[::-1])]
        live: dict[int, list[int]] = {}
        for identity, t in _unpacked(self.live.get()[0] if self.live.exists() else None, 2).T.tolist():
            live.setdefault(identity, []).append(t)
        admitted = self._judge(live, due[0], due[1])
        kept = [(identity, t) for identity, instants in live.items() for t in instants if t + self.span >= now]
        if due.size:
            self.waiting.put([(_packed(later),)]) if later.size else self.waiting.clear()
        self.live.update((_packed(np.array(kept, np.int64).T),)) if kept else self.live.clear()
        if later.size or kept:
            self._wake(int(later[1].min()) if later.size else max(t for _, t in kept) + self.span)
        if due.size:
            nobody = np.full(len(admitted), key[0] < 0)
            yield pd.DataFrame({"identity": pd.arrays.IntegerArray(due[0], nobody), "id": pd.arrays.IntegerArray(due[3], due[2] == 0), "admitted": admitted})

    def close(self) -> None:
        pass


def _packed(columns) -> bytes:
    return np.ascontiguousarray(columns, np.int64).tobytes()


def _unpacked(block: bytes | None, n_columns: int) -> np.ndarray:
    return np.frombuffer(block or b"", np.int64).reshape(n_columns, -1)


def stream_admission(hits: DataFrame, path: str, checkpoint: str, *, limit: int = C.IDENTITY_LIMIT,
                     span_s: float = C.IDENTITY_SPAN_S, delay: str = "1 minute", buckets: int = 2048,
                     trigger: dict | None = None) -> StreamingQuery:
    """The sliding limit in event time, over batches in any order.

    ``hits``: identity, id, ts; those that are not in time are to be split off
    before, see ``arrivals``. A hit is answered once the watermark, ``delay``
    behind the newest hit, has passed it; then all earlier ones are known, and
    the answers are those of W2. State of an identity: its hits that wait, and at
    most ``limit`` instants, dropped when they are older than the span. Hits without an identity
    are judged as those of one more.

    The state is kept by ``buckets`` of identities: a micro-batch makes as many calls at most, however
    many identities it has, and a call holds the waiting hits of one bucket. A stream keeps the number
    that it was started with, as it does with the number of its partitions.
    """
    rows = hits.withWatermark("ts", delay).select(
        F.col("identity").cast("long").alias("identity"), F.col("id").cast("long").alias("id"), "ts", F.unix_micros("ts").alias("ts_us"))
    # Nobody's hits have the bucket -1. A null would turn the integers of all rows around it into floats in pandas.
    rows = rows.withColumns({
        "bucket": F.when(F.col("identity").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("identity"), F.lit(buckets))),
        "identity": F.coalesce("identity", F.lit(0)),
        "has_id": F.col("id").isNotNull().cast("long"), "id": F.coalesce("id", F.lit(0))})
    judged = rows.groupBy("bucket").transformWithStateInPandas(
        _Admission(limit, int(span_s * 1_000_000)), "identity long, id long, admitted boolean", "append", "eventTime")
    with _rocksdb(hits.sparkSession):
        return _start(judged, _sink(path), checkpoint, "append", trigger)


def read_admission(spark: SparkSession, path: str, arrivals: str, schema) -> DataFrame:
    """T3 result: judged hits, and those that came too late with the code LATE."""
    judged = spark.read.parquet(path).select("identity", "id", "admitted", F.lit(None).cast("string").alias("reject_code"))
    late = late_rows(spark, arrivals, schema).select("identity", "id", F.lit(False).alias("admitted"), F.lit("LATE").alias("reject_code"))
    return judged.unionByName(late)


class _Sights(StatefulProcessor):
    """The instant at which a key's entry was made. It serves for a horizon and is then forgotten."""

    def __init__(self, horizon_us: int) -> None:
        self.horizon = horizon_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.made = handle.getValueState("made", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([p[["at", "request_id"]] for p in rows]).sort_values(["at", "request_id"])
        at = pdf["at"].to_numpy()
        cached = np.ones(len(at), bool)
        made = self.made.get()[0] if self.made.exists() else None
        i = 0 if made is None else int(np.searchsorted(at, made + self.horizon, "right"))
        while i < len(at):
            made, cached[i] = int(at[i]), False
            i = int(np.searchsorted(at, made + self.horizon, "right"))
        self.made.update((made,))
        self.handle.registerTimer((made + self.horizon) // 1000 + 1)
        yield pdf[["request_id"]].assign(cached=cached)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # What comes from now on is later than the watermark: an entry that ends before serves nobody.
        if self.made.exists() and self.made.get()[0] + self.horizon < timerValues.getCurrentWatermarkInMs() * 1000:
            self.made.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_cache(requests: DataFrame, path: str, checkpoint: str, *, horizon_s: float = 30 * 86400, delay: str = "1 minute",
                 trigger: dict | None = None) -> StreamingQuery:
    """T4: a request is a miss if its key has no entry, or one that was made more than ``horizon_s`` before it.

    A miss makes the entry. Batches are judged as they come, each in the order of
    (created_at, request_id). Requests that are not in time are to be split off
    before, see ``arrivals``. State is one instant per key and is dropped once the watermark, ``delay``
    behind the newest request, has passed its horizon; earlier answers are not read.
    """
    rows = audit.with_cache_key(requests.withWatermark("created_at", delay)).select(
        F.col("request_id").cast("long").alias("request_id"), "image_hash", "packs_version", "tag_key", "created_at", F.unix_micros("created_at").alias("at"))
    judged = rows.groupBy("image_hash", "packs_version", "tag_key").transformWithStateInPandas(
        _Sights(int(horizon_s * 1_000_000)), "request_id long, cached boolean", "append", "eventTime")
    with _rocksdb(requests.sparkSession):
        return _start(judged, _sink(path), checkpoint, "append", trigger)


def read_cache(spark: SparkSession, path: str, arrivals: str, schema) -> DataFrame:
    """T4 result: judged requests, and as misses those that came too late to be served."""
    late = late_rows(spark, arrivals, schema).select("request_id", F.lit(False).alias("cached"))
    return spark.read.parquet(path).select("request_id", "cached").unionByName(late)


def read_flag(spark: SparkSession, path: str, flag: str) -> DataFrame:
    """T5 result; a directory name carries the flag as text."""
    return spark.read.parquet(path).withColumn(flag, F.col(flag).cast("boolean"))


def stream_gate(requests: DataFrame, catalog: DataFrame, path: str, checkpoint: str, *,
                trigger: dict | None = None) -> StreamingQuery:
    """T5: accepted requests and whole-request rejections, side by side under ``path``."""
    def split(batch: DataFrame, batch_id: int) -> None:
        judged = answers.unknown_tag_gate(batch, catalog)
        judged.write.mode("overwrite").partitionBy("accepted").parquet(f"{path}/batch={batch_id}")

    return _start(requests, split, checkpoint, "append", trigger)
