"""Scoring the scorer against labelled media.

Input is one row per arm and item: arm, path, owner, label, bands (tag ->
band), evidence (tag -> text), latency_ms. Item measures need no exploding,
tag measures explode only what fired, and everything combines before it is
shuffled by arm and tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creativeaudit import constants as C
from creativeaudit.functions.rounding import round_rate
from creativeaudit.operators.sizing import small_side
from creativeaudit.session import checkpoint


def _own_band():
    """The band an item got for the tag it is filed under."""
    return F.try_element_at("bands", F.col("owner"))


def _in_catalog(rows: DataFrame, slugs: DataFrame, column: str) -> DataFrame:
    known = small_side(slugs.select(F.col("slug").alias(column)).distinct())
    return rows.join(known, column, "left_semi")


def _fired():
    """Tags of other owners that fired on an item."""
    return F.map_keys(F.map_filter("bands", lambda tag, band: (band == "present") & (tag != F.col("owner"))))


def _count_fires(rows: DataFrame, slugs: DataFrame) -> DataFrame:
    return _in_catalog(rows, slugs, "tag").groupBy("arm", "tag").agg(F.sum("n").alias("false_blocks"))


def cross_fire(scored: DataFrame, slugs: DataFrame) -> DataFrame:
    """Items of other owners on which a tag fired; a row without tag is the arm's total.

    Tags that never fired are absent, the total is always there.
    """
    # Each item also counts 0 under no tag, so that every arm has a total; one scan serves both.
    tags = F.concat(F.array(F.lit(None).cast("string")), _fired())
    counted = scored.select("arm", F.explode(tags).alias("tag")).groupBy("arm", "tag").agg(
        F.count("tag").alias("n"))
    known = slugs.select(F.col("slug").alias("tag")).distinct().withColumn("known", F.lit(True))
    known_n = F.when(F.col("known"), F.col("n")).otherwise(0)
    no_tag = F.lit(None).cast("string")
    both = F.array(F.struct(no_tag.alias("tag"), known_n.alias("n")), F.struct("tag", known_n.alias("n")))
    own_row = F.when(F.col("known"), both).otherwise(F.slice(both, 1, 1))
    rows = counted.join(small_side(known), "tag", "left").select("arm", F.inline(own_row))
    return rows.groupBy("arm", "tag").agg(F.sum("n").alias("false_blocks"))


def _count_recalls(rows: DataFrame, slugs: DataFrame) -> DataFrame:
    def total(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    own = F.col("label")
    out = _in_catalog(rows, slugs, "tag").groupBy("arm", "tag").agg(
        total(own).alias("positives"), total(own & (F.col("band") == "present")).alias("tp"),
        total(own & (F.col("band") == "uncertain")).alias("unsure"))
    return out.withColumn("recall", F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(0.0))


def recall_by_tag(scored: DataFrame, slugs: DataFrame) -> DataFrame:
    """A10: detections among each owner's positives. Uncertain is not a detection.

    One row per arm and catalog tag that owns items; recall is 0 without positives.
    """
    return _count_recalls(scored.select("arm", F.col("owner").alias("tag"), "label", _own_band().alias("band"),
                                        F.lit(1).cast("bigint").alias("n")), slugs)


def mean_recall(recalls: DataFrame) -> DataFrame:
    """Unweighted mean over tags that have positives. Input: recall_by_tag."""
    measured = F.when(F.col("positives") > 0, F.col("recall"))
    return recalls.groupBy("arm").agg(
        F.coalesce(round_rate(F.avg(measured), 4), F.lit(0.0)).alias("mean_recall"))


def uncertain_positive_rate(scored: DataFrame, recalls: DataFrame) -> DataFrame:
    """Unsure answers of catalog tags over all positives, foreign owners included."""
    positives = scored.groupBy("arm").agg(F.count_if("label").alias("n"))
    unsure = recalls.groupBy("arm").agg(F.sum("unsure").alias("u"))
    return positives.join(unsure, "arm", "left").select(
        "arm", _rate(F.col("u"), F.col("n")).alias("uncertain_positive_rate"))


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(round_rate(F.try_divide(part, whole), 3), F.lit(0.0))


def _percentiles(counts: DataFrame, quantiles: tuple[float, ...]) -> DataFrame:
    """Nearest rank over a small table of (arm, latency_ms, n)."""
    upto = Window.partitionBy("arm").orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0)
    real = counts.withColumn("n", F.when(F.coalesce(F.col("latency_ms"), F.lit(0)) != 0, F.col("n")).otherwise(0))
    ranked = (real.withColumn("upto", F.sum("n").over(upto))
              .withColumn("all", F.sum("n").over(Window.partitionBy("arm"))))

    def nearest(q: float) -> Column:
        rank = F.least(F.col("all") - 1, F.floor(F.col("all") * F.lit(float(q))))
        hit = F.min(F.when((F.col("n") > 0) & (F.col("upto") > rank), F.col("latency_ms")))
        return F.coalesce(hit, F.lit(0)).cast("bigint").alias(f"p{round(q * 100)}")

    largest = F.max(F.when(F.col("n") > 0, F.col("latency_ms")))
    return ranked.groupBy("arm").agg(
        *[nearest(q) for q in quantiles], F.coalesce(largest, F.lit(0)).cast("bigint").alias("max"))


def latency_percentiles(scored: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Nearest-rank percentiles over non-zero latencies, per arm.

    Latencies are counted per distinct millisecond first; the running count
    then walks that small table, never the items.
    """
    return _percentiles(scored.groupBy("arm", "latency_ms").agg(F.count(F.lit(1)).alias("n")), quantiles)


def tags_without_positives(scored: DataFrame, slugs: DataFrame) -> DataFrame:
    """Catalog tags nobody has positive media for."""
    owners = scored.filter("label").select(F.col("owner").alias("tag")).distinct()
    return slugs.select(F.col("slug").alias("tag")).distinct().join(owners, "tag", "left_anti").orderBy("tag")


def _tally(scored: DataFrame) -> DataFrame:
    """Everything a report needs, counted in one pass over the items and one shuffle.

    Each item gives its owner's verdict, its latency and the tags that fired.
    The counts are few (tags, bands, distinct milliseconds) and are read
    several times, so they are stored.
    """
    none = F.lit(None)

    def fact(kind: str, key: Column, label: Column, band: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"),
                        label.cast("boolean").alias("label"), band.cast("string").alias("band"))

    facts = F.concat(F.array(fact("own", F.col("owner"), F.col("label"), _own_band()),
                             fact("ms", F.col("latency_ms"), none, none)),
                     F.transform(_fired(), lambda tag: fact("fire", tag, none, none)))
    counted = scored.select("arm", F.inline(facts)).groupBy("arm", "kind", "key", "label", "band").agg(
        F.count(F.lit(1)).alias("n"))
    return checkpoint(counted)


def gate_report(scored: DataFrame, slugs: DataFrame) -> DataFrame:
    """One row per arm with both gate numbers and what explains them.

    The slugs of one catalog, of any size, serve as one array: the report's
    lists and maps are by tag as well. Reads the items once, when the plan is
    built.
    """
    known = slugs.agg(F.array_sort(F.collect_set("slug")).alias("s")).scalar()
    tally = _tally(scored)
    own = tally.filter("kind = 'own'").withColumnRenamed("key", "tag")
    size = own.groupBy("arm").agg(F.sum("n").alias("images"), F.sum(F.when(F.col("label"), F.col("n")).otherwise(0)).alias("positives"))
    measured = F.col("positives") > 0
    recalls = _count_recalls(own, slugs).groupBy("arm").agg(
        F.coalesce(round_rate(F.avg(F.when(measured, F.col("recall"))), 4), F.lit(0.0)).alias("mean_recall"),
        F.sum("unsure").alias("unsure"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(
            measured, F.struct("tag", round_rate(F.col("recall"), 3).alias("recall")))))).alias("recall_by_tag"))
    fires = _count_fires(tally.filter("kind = 'fire'").withColumnRenamed("key", "tag"), slugs).groupBy("arm").agg(
        F.sum("false_blocks").alias("cross_tag_false_blocks"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "false_blocks")))).alias("cross_tag_by_tag"))
    waits = _percentiles(tally.filter("kind = 'ms'").select("arm", F.col("key").cast("bigint").alias("latency_ms"), "n"), (0.5, 0.95))
    out = size.join(recalls, "arm", "left").join(fires, "arm", "left").join(waits, "arm", "left")
    no_map = F.create_map().cast("map<string,bigint>")
    recall_map = F.coalesce("recall_by_tag", F.create_map().cast("map<string,double>"))
    return out.select(
        "arm", "images", F.size(known).cast("bigint").alias("tags"),
        F.coalesce("cross_tag_false_blocks", F.lit(0)).alias("cross_tag_false_blocks"),
        F.coalesce("mean_recall", F.lit(0.0)).alias("mean_recall"),
        F.coalesce("cross_tag_by_tag", no_map).alias("cross_tag_by_tag"), recall_map.alias("recall_by_tag"),
        F.array_except(known, F.map_keys(recall_map)).alias("tags_without_positives"),
        _rate(F.coalesce("unsure", F.lit(0)), F.col("positives")).alias("uncertain_positive_rate"), "p50", "p95", "max")


METRICS = ("cross_tag_false_blocks", "mean_recall", "uncertain_positive_rate", "p95")


def gate_compare_join(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each metric of two one-row reports side by side."""
    def unpivot(report: DataFrame, name: str) -> DataFrame:
        entries = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in METRICS]
        return report.select(F.inline(F.array(*entries)))

    both = unpivot(before, "before").join(unpivot(after, "after"), "metric", "full_outer")
    return both.withColumn("change", F.round(F.col("after") - F.col("before"), 4))


def gate_verdict(comparison: DataFrame) -> DataFrame:
    """PASS, MIXED or FAIL from both axes at once."""
    def pick(metric: str, column: str):
        return F.max(F.when(F.col("metric") == metric, F.col(column)))

    one = comparison.agg(
        pick("cross_tag_false_blocks", "before").alias("fb0"), pick("cross_tag_false_blocks", "after").alias("fb1"),
        pick("mean_recall", "before").alias("r0"), pick("mean_recall", "after").alias("r1"))
    fewer, held, better = F.expr("fb1 < fb0"), F.expr("r1 >= r0"), F.expr("r1 > r0")
    return one.select(
        F.when(fewer & held, "PASS").when(fewer | better, "MIXED").otherwise("FAIL").alias("verdict"),
        F.when(fewer & held, "fewer false blocks, recall held")
        .when(fewer, "fewer false blocks, recall fell")
        .when(better, "recall rose, false blocks did not fall")
        .otherwise("no better on either axis").alias("reason"))


def label_disagreements(scored: DataFrame) -> DataFrame:
    """Items whose own-tag verdict contradicts their label; uncertain never does."""
    band = _own_band()
    problem = (F.when(F.col("label") & (band == "absent"), C.POSITIVE_BUT_ABSENT)
               .when(~F.col("label") & (band == "present"), C.NEGATIVE_BUT_PRESENT))
    seen = F.coalesce(F.try_element_at("evidence", F.col("owner")), F.lit(""))
    return scored.select("arm", "path", F.col("owner").alias("tag"), problem.alias("problem"),
                         seen.alias("evidence")).filter(F.col("problem").isNotNull())


def eval_coverage(discovered: DataFrame, golden: DataFrame) -> DataFrame:
    """Tags with evaluation media but no golden item."""
    return (discovered.select(F.col("owner").alias("slug")).distinct()
            .join(golden.select("slug").distinct(), "slug", "left_anti").orderBy("slug"))


def worst_cross_tags(cross: DataFrame) -> DataFrame:
    """Tags by false blocks, worst first. One row per catalog tag reaches the sort."""
    rows = cross.filter(F.col("tag").isNotNull())
    w = Window.partitionBy("arm").orderBy(F.desc("false_blocks"), "tag")
    return rows.select("arm", "tag", "false_blocks", F.row_number().over(w).alias("position"))


def arms_union(*arms: DataFrame) -> DataFrame:
    """Stack the scores of several arms; absent columns become NULL."""
    out = arms[0]
    for arm in arms[1:]:
        out = out.unionByName(arm, allowMissingColumns=True)
    return out


def resume_todo(discovered: DataFrame, done: DataFrame, arm: str) -> DataFrame:
    """U4: items this arm has not scored yet."""
    scored = done.filter(F.col("arm") == arm).select("path").distinct()
    return discovered.join(scored, "path", "left_anti").select("owner", "label", "path")


def smoke_limit(discovered: DataFrame, n: int) -> DataFrame:
    """The first n items in discovery order."""
    return discovered.orderBy("owner", F.desc("label"), "path").limit(n)


def gate_report_merge(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New arms replace their own rows, other arms stay."""
    kept = existing.join(new.select("arm").distinct(), "arm", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
