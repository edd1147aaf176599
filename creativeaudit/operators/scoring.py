"""Running a pluggable scorer over creatives."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creativeaudit import constants as C
from creativeaudit.session import fresh_path

ANSWER = ("creative_id bigint, frame_index bigint, tag string, present boolean, score double, "
          "top_phrase string, decided_by string, latency_ms bigint, error string")


class ScorerBusy(Exception):
    """Raised by a scorer that wants to be asked again later."""


# scorer(creative_id, frames as list of dicts, tags) -> list of raw answer dicts
Scorer = Callable[[int, list[dict], list[str]], list[dict]]


def score_batch(frames: DataFrame, tags: list[str], scorer: Scorer, *,
                parallelism: int | None = None, retries: int = C.SCORER_RETRIES,
                backoff_s: float = C.SCORER_BACKOFF_S) -> DataFrame:
    """one call per creative with all its frames and tags.

    ``frames``: creative_id, frame_index and whatever the scorer reads. The
    sampler caps a creative at 6 frames, so one call stays small. A busy
    scorer is asked again; any other failure gives one row with ``error`` and
    no verdict. ``parallelism`` bounds the calls in flight; by default the
    cluster's cores do. Creatives are dealt out by their id, so that a repeated
    task asks about the same ones.
    """
    columns = [c for c in frames.columns if c != "creative_id"]
    calls = frames.groupBy("creative_id").agg(
        F.array_sort(F.collect_list(F.struct("frame_index", *[c for c in columns if c != "frame_index"]))).alias("frames"))

    def ask(creative_id: int, items: list[dict]) -> list[dict]:
        for attempt in range(retries):
            started = time.monotonic()
            try:
                rows = scorer(creative_id, items, tags)
                took = int((time.monotonic() - started) * 1000)
                return [{"latency_ms": took, **row} for row in rows]
            except ScorerBusy:
                time.sleep(backoff_s * (attempt + 1))
            except Exception as exc:  # any failure means no verdict for this creative
                return [{"error": f"{type(exc).__name__}: {exc}"}]
        return [{"error": f"scorer had no time in {retries} tries"}]

    names = [p.strip().split(" ")[0] for p in ANSWER.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for creative_id, items in zip(pdf["creative_id"], pdf["frames"]):
                as_dicts = [i.asDict() if hasattr(i, "asDict") else dict(i) for i in items]
                for row in ask(int(creative_id), as_dicts):
                    rows.append({"creative_id": int(creative_id), **row})
            out = pd.DataFrame(rows, columns=names)
            for text in ("tag", "top_phrase", "decided_by", "error"):
                out[text] = out[text].astype(object)
            out["frame_index"] = out["frame_index"].astype("Int64")
            out["latency_ms"] = out["latency_ms"].astype("Int64")
            out["present"] = out["present"].astype("boolean")
            yield out

    tasks = parallelism or frames.sparkSession.sparkContext.defaultParallelism
    return calls.repartition(tasks, "creative_id").mapInPandas(run, ANSWER)


def _finished(spark: SparkSession, path: str) -> DataFrame | None:
    """Creatives with verdicts under ``path``; None if nothing was written there. Any other fault of the read is raised."""
    try:
        return spark.read.schema(ANSWER).parquet(path).filter("error IS NULL").select("creative_id").distinct()
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def score_resumable(frames: DataFrame, tags: list[str], scorer: Scorer, path: str, *,
                    chunks: int = 16, **options) -> DataFrame:
    """F1 in chunks: each is written before the next starts, finished creatives are not asked again.

    Failed creatives are asked again by the next run. The frames are read once
    and kept by chunk in the shared folder.
    """
    spark = frames.sparkSession
    parts = fresh_path(spark, "frames-to-score")
    chunk_of = F.pmod(F.xxhash64("creative_id"), F.lit(chunks)).cast("int")
    frames.withColumn("_chunk", chunk_of).write.partitionBy("_chunk").parquet(parts)
    kept = spark.read.schema(frames.withColumn("_chunk", chunk_of).schema).parquet(parts)
    for chunk in range(chunks):
        todo = kept.filter(F.col("_chunk") == chunk).drop("_chunk")
        done = _finished(spark, path)
        if done is not None:
            todo = todo.join(done, "creative_id", "left_anti")
        score_batch(todo, tags, scorer, **options).write.mode("append").parquet(path)
    return spark.read.schema(ANSWER).parquet(path)
