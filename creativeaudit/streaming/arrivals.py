"""Rows that come too late, as rows.

A stateful operator drops what is older than its watermark and tells only how
many rows it were. Here a stream is split first: what comes ``delay`` or more
behind the newest event of all earlier micro-batches is written aside. What is
in time can be read as a stream again with a watermark of the same delay, which
then drops nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, IntegerType, StructType

CLOCK = "newest timestamp, n_late long"


def split_late(rows: DataFrame, path: str, checkpoint: str, *, at: str = "ts", delay: str = "1 day",
               trigger: dict | None = None) -> StreamingQuery:
    """Writes each micro-batch under ``path``, split by the flag ``late``, and the clock after it.

    The clock of a batch is the newest event time so far, cut to milliseconds
    as Spark's watermarks are; it is observed while the batch is written, so
    that a batch is read once. A batch whose clock is there was written whole
    and is not written again. Rows without an event time are late.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if clock(spark, path, batch_id) is not None:
            return
        before = clock(spark, path, batch_id - 1) if batch_id else None
        newest = before["newest"] if before else None
        edge = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.col(at).isNull() | F.coalesce(F.col(at) <= edge, F.lit(False))
        seen = Observation("arrivals")
        marked = batch.withColumn("late", late).observe(
            seen, F.max(F.date_trunc("millisecond", at)).alias("newest"), F.count_if("late").alias("n_late"))
        marked.write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/batch={batch_id}")
        newest = max((t for t in (newest, seen.get["newest"]) if t is not None), default=None)
        spark.createDataFrame([(newest, seen.get["n_late"])], CLOCK).write.mode("overwrite").parquet(f"{path}/clock/batch={batch_id}")

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def clock(spark: SparkSession, path: str, batch_id: int):
    """(newest, n_late) after a batch, None if it has not been written whole."""
    try:
        return spark.read.schema(CLOCK).parquet(f"{path}/clock/batch={batch_id}").first()
    except AnalysisException:
        return None


def in_time(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows in time, as a stream."""
    return spark.readStream.schema(schema).parquet(f"{path}/rows/batch=*/late=false")


def late_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The late rows so far; only their folders are read."""
    parts = StructType([*schema.fields]).add("batch", IntegerType()).add("late", BooleanType())
    return spark.read.schema(parts).option("basePath", f"{path}/rows").parquet(f"{path}/rows").filter("late").select(*schema.names)
