"""Scoring the labelled set with one arm and judging it against another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creativeaudit.operators import evalgate, verdicts
from creativeaudit.operators.scoring import Scorer, score_batch


def score_arm(arm: str, discovered: DataFrame, frames: DataFrame, banked: DataFrame, tags: list[str],
              scorer: Scorer, **options) -> DataFrame:
    """New scores of ``arm``, one row per item, for items it has not scored yet.

    ``frames``: creative_id, path, frame_index and what the scorer reads. Items
    whose call failed give no row, so the next run asks for them again.
    """
    todo = evalgate.resume_todo(discovered, banked, arm)
    asked = frames.join(todo.select("path"), "path", "left_semi")
    answers = score_batch(asked.drop("path"), tags, scorer, **options).filter(F.col("error").isNull())
    collapsed = verdicts.collapse_verdicts(
        verdicts.decide(answers), carry=["frame_index", "present", "score", "band", "top_phrase", "latency_ms"])
    item = collapsed.groupBy("creative_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "band")))).alias("bands"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct("tag", F.coalesce("top_phrase", F.lit("")))))).alias("evidence"),
        F.max("latency_ms").alias("latency_ms"))
    names = asked.select("creative_id", "path").distinct()
    return (item.join(names, "creative_id").join(todo, "path")
            .select(F.lit(arm).alias("arm"), "path", "owner", "label", "bands", "evidence", "latency_ms"))


def judge(scored: DataFrame, slugs: DataFrame, before: str, after: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report per arm, metric comparison, PASS/MIXED/FAIL)."""
    report = evalgate.gate_report(scored, slugs)
    comparison = evalgate.gate_compare_join(
        report.filter(F.col("arm") == before), report.filter(F.col("arm") == after))
    return report, comparison, evalgate.gate_verdict(comparison)
