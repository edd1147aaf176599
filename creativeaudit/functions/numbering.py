"""Row numbers and running sums that do not put a whole key into one task.

A plain window over ``keys`` sends every row of a key to one task. Here each
key is cut into slices by ``slice_by``, an expression that never decreases
along the ordering (an hour of the timestamp, say). The window runs within
(key, slice), and what came before the slice is added from a small per-slice
table built with a map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def floor_seconds(ts: Column, seconds: int) -> Column:
    """Epoch second at which the ``seconds`` long window around ``ts`` starts."""
    at = F.unix_seconds(ts)
    return at - F.pmod(at, F.lit(seconds).cast("bigint"))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], slice_by: Column, *,
            amount: Column | None = None, name: str = "n", total: str | None = None) -> DataFrame:
    """Add ``name``: the running sum of ``amount`` (default: the row number) per key.

    ``order`` must be unique within a key, and keys must not be NULL. ``total`` names an optional column
    holding the key's whole sum.
    """
    one = F.lit(1).cast("bigint") if amount is None else amount
    df = df.withColumn("_slice", slice_by).withColumn("_one", one)
    by_key = Window.partitionBy(*keys).orderBy("_slice")
    slices = df.groupBy(*keys, "_slice").agg(F.sum("_one").alias("_in_slice"))
    slices = slices.withColumn(
        "_before", F.coalesce(F.sum("_in_slice").over(
            by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if total:
        slices = slices.withColumn(total, F.sum("_in_slice").over(Window.partitionBy(*keys)))
    within = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    left = df.withColumn("_here", F.sum("_one").over(within))
    # Same keys as the window, so the join adds no second shuffle of the rows.
    out = left.join(slices, [*keys, "_slice"], "left")
    out = out.withColumn(name, F.col("_here") + F.coalesce("_before", F.lit(0)))
    return out.drop("_slice", "_one", "_here", "_before", "_in_slice")
