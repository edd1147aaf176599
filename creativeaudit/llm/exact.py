"""Exact deduplication with a split of heavy hitters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creativeaudit.llm.common import SPACES, stored

#: Counters of each summary, and so the largest number of digests that are ever broadcast.
COUNTERS = 1024


def normalised(text: str = "text"):
    """The text without white space; null is empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, "")


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Misra-Gries: at most ``counters`` digests, among them every one above 2/counters of all rows.

    Each task keeps ``counters`` counts; when a new digest finds none free, all
    counts go down. A count is too low by at most rows/counters, so the sum of
    a digest's counts is at least rows/counters if it has twice that many rows,
    and no more than ``counters`` digests can have such a sum.
    """
    def summary(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            values = pa.compute.value_counts(batch.column(0))
            names = values.field("values").to_pylist()
            for name, n in zip(names, values.field("counts").to_pylist()):
                held[name] = held.get(name, 0) + n
            if len(held) > counters:  # takes off what the (counters + 1)-th largest has
                counts = np.fromiter(held.values(), np.int64, len(held))
                cut = int(np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1])
                held = {k: v - cut for k, v in held.items() if v > cut}
        if held:
            yield pa.RecordBatch.from_pydict(
                {"digest": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    total = digests.count()
    least = max(2, -(-total // counters))
    found = digests.select("digest").mapInArrow(summary, "digest string, n long")
    return found.groupBy("digest").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("digest")


def exact_duplicates(docs: DataFrame, counters: int = COUNTERS, doc_id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """One row per document: which one of its group of equal texts stays.

    Texts are equal when the same after all white space is taken out. Of equal
    ones the longest original stays, in code points, then the smallest id.
    Digests that Misra-Gries finds frequent are counted exactly, their winners
    (at most ``counters``) are broadcast and meet the rows where those are; all
    other digests are shuffled, and none of them is large.

    Null texts are empty and equal each other. Rows with one id are one
    document: they share its fate, and each counts in group_size. A null id
    comes after all others. No rows give no rows; further columns are ignored.

    Columns: doc_id, keep_id, group_size, kept, text_sha256.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.length(F.coalesce(F.col(text), F.lit(""))).alias("size"),
                       F.sha2(normalised(text).cast("binary"), 256).alias("digest"))
    base = stored(base, "digests")
    # Of equal sizes the largest complement is the smallest id; null is the least of all.
    best = F.max(F.struct("size", F.bitwise_not("doc_id").alias("back")))
    winner = [F.bitwise_not("best.back").alias("keep_id"), "group_size"]

    def winners(rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select("digest", *winner)

    heavy = stored(frequent_digests(base, counters), "frequent")
    verified = stored(winners(base.join(F.broadcast(heavy), "digest", "left_semi")), "winners")
    met = base.join(F.broadcast(verified), "digest", "left")
    light = met.filter("group_size IS NULL").select("doc_id", "digest")
    rest = base.join(F.broadcast(heavy), "digest", "left_anti")
    light = light.join(winners(rest), "digest")
    out = met.filter("group_size IS NOT NULL").select("doc_id", "digest", "keep_id", "group_size").unionByName(light)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.col("digest").alias("text_sha256"))
