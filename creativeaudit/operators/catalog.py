"""The tag catalog: validation, listing, fingerprint, changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creativeaudit import constants as C
from creativeaudit.functions import text as T
from creativeaudit.functions import verdict as V


def slugify(df: DataFrame, column: str = "label") -> DataFrame:
    """Derived slug, and whether it can serve as one."""
    return (df.withColumn("slug", T.slugify(F.col(column)))
            .withColumn("usable", T.is_slug(F.col("slug"))))


def _clean(proposals: DataFrame) -> DataFrame:
    empty = F.lit("")
    return (proposals
            .withColumn("slug", T.fold_case(T.trim_space(F.coalesce("slug", empty))))
            .withColumn("label", T.trim_space(F.coalesce("label", empty)))
            .withColumn("description", T.trim_space(F.coalesce("description", empty))))


def validate_tags(proposals: DataFrame, catalog: DataFrame, cap: int = C.CATALOG_CAP) -> DataFrame:
    """Judge each proposal on its own against the catalog.

    ``proposals``: id, op ('create' or 'update'), target (slug of the row an
    update is for), slug, label, description.
    """
    active = catalog.agg(F.count_if(F.col("status") == "active").alias("n")).scalar()
    rows = _clean(proposals).withColumn("target", T.fold_case(T.trim_space(F.coalesce("target", F.lit("")))))
    looked_up = F.when(F.col("op") == "update", F.col("target")).otherwise(F.col("slug"))
    known = catalog.select(F.col("slug").alias("_known"), F.col("status").alias("_status"))
    rows = rows.withColumn("_lookup", looked_up).join(
        known, F.col("_lookup") == F.col("_known"), "left")
    exists, create = F.col("_known").isNotNull(), F.col("op") == "create"
    reason = (
        F.when(~create & ~exists, "no such tag")
        .when(~T.is_slug(F.col("slug")), "bad slug")
        .when(create & exists & (F.col("_status") == "retired"), "slug retired")
        .when(create & exists, "slug in use")
        .when(create & (active >= cap), "catalog full")
        .when(~create & (F.col("slug") != F.col("target")), "slug cannot change")
        .when(F.col("label") == "", "label required"))
    return (rows.withColumn("reject_reason", reason)
            .withColumn("accepted", F.col("reject_reason").isNull())
            .drop("_lookup", "_known", "_status"))


def thin_names(catalog: DataFrame, min_len: int = C.SHORT_LABEL) -> DataFrame:
    """Labels too short to say what to look for. Advice, never a refusal."""
    label = T.trim_space(F.col("label"))
    return catalog.filter(F.length(label) < min_len).select(
        "slug", label.alias("label"), F.lit("the name is short").alias("warning"))


def _active_lines(catalog: DataFrame, line: Column, by: Sequence[str]) -> DataFrame:
    """All lines of a catalog sorted by slug; the cap on active tags bounds the list."""
    rows = catalog.filter(F.col("status") == "active").select(*by, "slug", line.alias("line"))
    lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("slug", "line"))).alias("l"))
    return lists.withColumn("lines", F.transform("l", lambda s: s["line"])).drop("l")


def catalog_lines(catalog: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The category list put to the scorer, one line per active tag.

    ``by`` names the columns that tell catalogs apart when there are many.
    """
    line = F.concat(F.lit("- "), "slug", F.lit(": "), T.trim_space(F.coalesce("label", F.lit(""))))
    return _active_lines(catalog, line, by).withColumn("lines", F.array_join("lines", "\n"))


def packs_version(catalog: DataFrame, model: str, prompt_version: str,
                  by: Sequence[str] = ()) -> DataFrame:
    """12 hex digits that move when the model, the prompt or an active name moves."""
    line = F.concat("slug", F.lit("="), T.trim_space(F.coalesce("label", F.lit(""))))
    out = _active_lines(catalog, line, by)
    text = F.concat_ws("|", F.lit(f"{model}|{prompt_version}"), F.col("lines"))
    return out.select(*by, F.substring(F.sha2(text, 256), 1, 12).alias("packs_version"))


def catalog_stats(catalog: DataFrame, by: Sequence[str] = (), cap: int = C.CATALOG_CAP) -> DataFrame:
    """Sizes, room left under the cap, and the next sort position."""
    active = F.count_if(F.col("status") == "active")
    return catalog.groupBy(*by).agg(
        active.alias("active"), F.count_if(F.col("status") == "retired").alias("retired"),
        F.greatest(F.lit(0).cast("bigint"), F.lit(cap) - active).alias("headroom"),
        (F.coalesce(F.max("sort_order"), F.lit(0)) + 1).cast("bigint").alias("next_sort_order"))


def catalog_listing(catalog: DataFrame, thresholds: DataFrame, live: str | None,
                    include_retired: bool = False) -> DataFrame:
    """O1: tags in display order with their effective calibration."""
    rows = catalog if include_retired else catalog.filter(F.col("status") == "active")
    t = thresholds.select("slug", "calibrated", "packs_version_seen")
    rows = rows.join(t, "slug", "left")
    calibrated = V.effective_calibrated(
        F.col("calibrated"), F.col("packs_version_seen"), F.lit(live).cast("string"))
    return (rows.select("slug", "label", "description", "status", "sort_order",
                        calibrated.alias("calibrated"))
            .orderBy("sort_order", "slug"))
