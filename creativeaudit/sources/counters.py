"""A7 and D3 on a stored table of counters, one folder per day: only days that change are read or written."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creativeaudit.operators.usage import upsert_counters

COUNTERS = "api_key_id bigint, window_start timestamp, count bigint"


def _by_day(counters: DataFrame) -> DataFrame:
    return counters.withColumn("day", F.to_date("window_start"))


def _write(rows: DataFrame, path: str) -> None:
    """Replaces the days that occur in ``rows``; the others keep their files."""
    (rows.repartition("day", F.pmod(F.xxhash64("api_key_id"), F.lit(8))).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{COUNTERS}, day date").parquet(path)


def create_counters(counters: DataFrame, path: str) -> None:
    _write(_by_day(counters), path)


def upsert(fresh: DataFrame, path: str) -> None:
    """Insert-or-add. Only the days of ``fresh``, one row each on the driver, are read from the stored table.

    The write is staged and put in place when all of it is there, so an attempt that fails before leaves
    the table as it was. ``fresh`` is added once for every call.
    """
    fresh = _by_day(fresh)
    days = [r["day"] for r in fresh.select("day").distinct().collect()]
    touched = read_counters(fresh.sparkSession, path).filter(F.col("day").isin(days)).select(*fresh.columns)
    added = upsert_counters(touched.drop("day"), fresh.drop("day"))
    _write(_by_day(added), path)


def prune(spark: SparkSession, path: str, now: datetime, keep: str = "1 day") -> int:
    """D3: drops windows that began more than ``keep`` before ``now``; returns how many.

    Days that are over go as folders, and only their row counts (Parquet footers) are read. The
    day in which the edge lies is written anew.
    """
    edge = spark.range(1).select((F.lit(str(now)).cast("timestamp") - F.expr(f"INTERVAL {keep}")).alias("t")).first()["t"]
    stored = read_counters(spark, path)
    old = F.col("day") < F.lit(edge.date())
    gone = stored.filter(old).count()
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for r in stored.filter(old).select("day").distinct().collect():  # one row per day
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"day={r['day']}"), True)
    last = read_counters(spark, path).filter(F.col("day") == F.lit(edge.date()))
    n_old = last.filter(F.col("window_start") < F.lit(edge)).count()
    if n_old:
        kept = last.filter(F.col("window_start") >= F.lit(edge))
        if kept.isEmpty():
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"day={edge.date()}"), True)
        else:
            _write(kept, path)
    return gone + n_old
