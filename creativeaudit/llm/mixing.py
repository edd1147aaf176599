"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creativeaudit.llm.common import WORD, stored
from creativeaudit.operators.sizing import small_side

#: Bits of the hash that one histogram takes in; LEVELS of them take in all.
BITS, LEVELS = 12, 5


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Each source's share of all words by weight, at most ``most`` times its own size.

    ``sizes`` has a row per source. Sources in the order of their code points,
    null last, get the weights in turn. What a full source can't take goes to
    the others by weight, until none is above its bound: the sources fill in
    the order of most * size / weight, so one running sum finds the level at
    which the rest stand. Columns: source, source_size, target.
    """
    # A list of sources is a catalog: one row per source, whatever the number of documents.
    one = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("nth", F.row_number().over(one) - 1)
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.col("nth") % len(weights)).cast("double")
    ranked = ranked.select("source", "source_size", weight.alias("weight"),
                           (F.col("source_size") * F.lit(most)).alias("bound"))
    everything = Window.partitionBy()
    fill = Window.orderBy((F.col("bound") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    x = ranked.select("*", F.sum("source_size").over(everything).alias("all"),
                      F.coalesce(F.sum("bound").over(before), F.lit(0.0)).alias("full"),
                      F.sum("weight").over(onward).alias("open"))
    # Rows are in the order in which they fill: full ones come first, the rest stand at one level.
    level = (F.col("all") - F.col("full")) / F.col("open")
    over = level * F.col("weight") > F.col("bound")
    x = x.withColumn("level", level).withColumn("over", over)
    final = F.min(F.when(~F.col("over"), F.struct(F.col("full"), F.col("level")))).over(everything)["level"]
    return x.select("source", "source_size", F.when(F.col("over"), F.col("bound")).otherwise(
        F.least(F.col("bound"), final * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, doc_id: str = "doc_id",
        text: str = "text", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """How many times the mix takes each document, so that sources meet their targets.

    A source that needs f times its size takes every document floor(f) times
    and once more those whose hash lies under a threshold. The thresholds are
    found from histograms: words by source and leading hash bits, then, within
    the one bucket that holds the boundary, by the next bits, five levels in
    all. Documents are then filtered by comparing hashes; nothing is sorted.
    A boundary document goes in when that brings the sum nearer to the target.

    Null texts have size 0; the null source is a source of its own, the last.
    Rows with one id and equal texts share a hash and are taken together. No
    rows give no rows. Columns: doc_id, size, source_size, target, taken,
    copies, source and those in ``carry``.
    """
    # Text and id both enter the hash, so that a repeated id with other text is another document.
    named = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    key = F.conv(F.substring(F.md5(named.cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"),
                       key.alias("h"), *carry)
    base = stored(base, "sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, most).select(
        "*", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).alias("whole"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # At the bound nothing is left over but rounding.
    plan = plan.withColumn("rest", F.greatest(F.col("rest"), F.lit(0.0)))
    plan = stored(plan.select("source", "source_size", "target", "whole", "rest",
                              F.lit(0).cast("long").alias("prefix")), "targets")
    for level in range(LEVELS):
        plan = stored(_refined(base, plan, level), "thresholds")
    # The last histogram's bucket is one hash; it goes in if more than half of it is wanted.
    t = plan.select(F.col("source").alias("t_source"), "source_size", "target", "whole", "prefix", "rest")
    boundary = base.join(small_side(t), F.col("source").eqNullSafe(F.col("t_source")))
    at = _lead(F.col("h"), LEVELS)
    last = (boundary.filter(at == F.col("prefix")).groupBy("t_source").agg(F.sum("size").alias("last"))
            .select(F.col("t_source").alias("l_source"), "last"))
    t = t.join(last, F.col("t_source").eqNullSafe(F.col("l_source")), "left").drop("l_source")
    rows = base.join(small_side(t), F.col("source").eqNullSafe(F.col("t_source")))
    extra = (at < F.col("prefix")) | ((at == F.col("prefix")) & (F.col("rest") * 2 > F.coalesce(F.col("last"), F.lit(0))))
    copies = (F.col("whole") + F.when(extra, 1).otherwise(0)).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"),
                       copies.alias("copies"), "source", *carry)


def _lead(h: Column, levels: int) -> Column:
    """The first bits of the hash that ``levels`` histograms take in, as a number that isn't negative."""
    return F.shiftright(h, BITS * (LEVELS - levels))


def _refined(base: DataFrame, plan: DataFrame, level: int) -> DataFrame:
    """The bucket of the next bits in which each source's budget runs out, and what is left of it there."""
    p = plan.select(F.col("source").alias("p_source"), "rest", "prefix")
    inside = base.join(small_side(p), F.col("source").eqNullSafe(F.col("p_source")))
    if level:
        inside = inside.filter(_lead(F.col("h"), level) == F.col("prefix"))
    histogram = inside.groupBy("p_source", _lead(F.col("h"), level + 1).alias("bucket")).agg(
        F.sum("size").alias("words"), F.max("rest").alias("rest"))
    by_source = Window.partitionBy("p_source").orderBy("bucket")
    upto = histogram.select("*", F.sum("words").over(by_source).alias("upto"))
    # The first bucket whose running sum is above the budget; a budget that covers all ends after the last one.
    found = upto.groupBy("p_source").agg(
        F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", (F.col("rest") - (F.col("upto") - F.col("words"))).alias("left")))).alias("at"),
        F.max("bucket").alias("end"), F.max("upto").alias("sum"))
    found = found.select("p_source", F.coalesce("at.bucket", F.col("end") + 1).alias("next"),
                         F.coalesce("at.left", F.lit(0.0)).alias("left"))
    return plan.join(found, F.col("source").eqNullSafe(F.col("p_source")), "left").select(
        "source", "source_size", "target", "whole",
        F.coalesce("left", F.lit(0.0)).alias("rest"),
        F.coalesce("next", F.shiftleft(F.col("prefix"), BITS)).alias("prefix"))
