"""Banked scores, the phrase archive and gate reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORED = ("path string, owner string, label boolean, bands map<string,string>, "
          "evidence map<string,string>, latency_ms bigint")
BANK = f"map<string, map<string, struct<{', '.join(p.strip().replace(' ', ': ', 1) for p in SCORED.split(', '))}>>>"
ARCHIVE = "struct<tags: array<struct<slug: string, label: string, positives: array<string>, negatives: array<string>>>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files, one row each, in a column ``json``."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))


def banked_scores(documents: DataFrame) -> DataFrame:
    """Documents {arm: {path: scores}} to one row per arm and path."""
    arms = documents.select(F.explode(F.from_json("json", BANK)).alias("arm", "items"))
    return arms.select("arm", F.explode("items").alias("key", "s")).select(
        "arm", F.col("key").alias("path"), "s.owner", "s.label", "s.bands", "s.evidence",
        F.coalesce("s.latency_ms", F.lit(0)).alias("latency_ms"))


def phrase_stats(documents: DataFrame) -> DataFrame:
    """Number of positive and negative phrases of each archived tag."""
    tag = documents.select(F.explode(F.from_json("json", ARCHIVE)["tags"]).alias("t"))
    n = lambda c: F.sum(F.coalesce(F.array_size(c), F.lit(0)))
    return tag.groupBy(F.col("t.slug").alias("slug")).agg(
        n("t.positives").alias("n_positives"), n("t.negatives").alias("n_negatives"))


def write_report(merged: DataFrame, path: str) -> bool:
    """Store a merged report at a new path; an empty one is never written.

    The caller points readers at the new path afterwards, so a report being
    read is not overwritten.
    """
    if merged.isEmpty():
        return False
    merged.write.mode("errorifexists").parquet(path)
    return True
