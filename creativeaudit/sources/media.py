"""Media folders and labelled evaluation folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creativeaudit.constants import IMAGE_SUFFIXES


def read_media(spark: SparkSession, root: str) -> DataFrame:
    """S1 source: every file below ``root`` as path and content.

    Spark's file scan leaves out files of zero bytes; empty payloads are seen
    (and rejected) only when media arrive as a table.
    """
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
            .select("path", "content"))


def read_eval_paths(spark: SparkSession, root: str) -> DataFrame:
    """S2 source: paths only. Content is not selected, so files are listed, not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
            .select("path"))


def eval_discover(paths: DataFrame, limit: int | None = None) -> DataFrame:
    """<owner>/<pos|neg>/<file> as owner, label and path, positives first within an owner."""
    suffixes = "|".join(s.removeprefix(".") for s in IMAGE_SUFFIXES)
    pattern = rf"([^/]+)/(pos|neg)/[^/]+\.(?i:{suffixes})\z"
    found = paths.select(
        F.regexp_extract("path", pattern, 1).alias("owner"),
        (F.regexp_extract("path", pattern, 2) == "pos").alias("label"), "path").filter("owner <> ''")
    ordered = found.orderBy("owner", F.desc("label"), "path")
    return ordered.limit(limit) if limit else ordered
