"""Answered requests: audit rows, cache lookups, integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creativeaudit.functions.text import tag_key


def with_cache_key(df: DataFrame) -> DataFrame:
    """The sorted tag list, as one string that can be joined on."""
    return df.withColumn("tag_key", F.array_join(tag_key(F.col("tags")), "\u0001"))


def newest_analysis(audit: DataFrame) -> DataFrame:
    """Newest analysis per cache key, with its results if there are any. Combines on the map side; ties go to the larger id."""
    keyed = with_cache_key(audit.filter(F.col("packs_version").isNotNull()))
    order = F.struct("created_at", "request_id")
    results = [F.max_by("results", order).alias("results")] if "results" in audit.columns else []
    return keyed.groupBy("image_hash", "packs_version", "tag_key").agg(
        F.max(order)["request_id"].alias("hit_request_id"), *results)


def cache_lookup(requests: DataFrame, audit: DataFrame, packs_version: str) -> DataFrame:
    """The stored analysis each request can be answered from, if any, with its raw results.

    ``requests``: request_id, image_hash, tags. Only audit rows of the live
    version are read. The audit side has one row per key, so a hot creative
    can only skew the request side, which AQE splits.
    """
    live = audit.filter(F.col("packs_version") == packs_version)
    hits = newest_analysis(live).drop("packs_version")
    out = with_cache_key(requests).join(hits, ["image_hash", "tag_key"], "left")
    return out.withColumn("cached", F.col("hit_request_id").isNotNull())


def audit_rows(requests: DataFrame, raw: DataFrame, packs_version: str) -> DataFrame:
    """One row per answered request, hits included, holding every frame's raw rows.

    ``requests``: request_id, api_key_id, creative_id, image_hash, tags,
    latency_ms, cached, created_at. ``raw``: creative_id, tag, present, score,
    top_phrase, decided_by, frame_index. Raw rows are packed once per creative
    (at most 6 frames by 100 tags) before they meet the requests.
    """
    item = F.struct("frame_index", "tag", "present", "score", "top_phrase", "decided_by")
    packed = raw.groupBy("creative_id").agg(F.array_sort(F.collect_list(item)).alias("results"))
    joined = requests.join(packed, "creative_id")
    asked = F.filter("results", lambda r: F.array_contains(F.col("tags"), r["tag"]))
    return joined.select(
        "request_id", "api_key_id", "image_hash", tag_key(F.col("tags")).alias("tags_requested"),
        asked.alias("results"), F.lit(packs_version).alias("packs_version"), "latency_ms", "cached",
        "created_at", F.to_date("created_at").alias("created_date"))


def write_audit(rows: DataFrame, path: str, files_per_day: int | None = None) -> None:
    """Append to the audit table, one directory per day.

    ``files_per_day`` gathers each day into that many files when a batch spans
    many days and tasks; hashing the request keeps a busy day in even parts.
    """
    if files_per_day:
        rows = rows.repartition("created_date", F.pmod(F.xxhash64("request_id"), F.lit(files_per_day)))
    rows.write.mode("append").partitionBy("created_date").parquet(path)


def audit_by_key(audit: DataFrame, keys: DataFrame) -> DataFrame:
    """Analyses per key. Rows whose key is gone or absent share the NULL bucket.

    Counted before the join, so the join sees one row per key.
    """
    counts = audit.groupBy("api_key_id").agg(
        F.count(F.lit(1)).alias("analyses"), F.count_if("cached").alias("cache_hits"))
    named = counts.join(keys.select(F.col("id").alias("key_id"), "name"),
                        F.col("api_key_id") == F.col("key_id"), "left")
    return named.groupBy("key_id", "name").agg(
        F.sum("analyses").alias("analyses"), F.sum("cache_hits").alias("cache_hits"))


def _key(cols: Sequence[str]) -> Column:
    """Values as one text; long ones as their digest."""
    text = F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)]))
    return F.when(F.octet_length(text) > 64, F.sha2(text, 256)).otherwise(text)


def integrity_checks(tables: dict[str, DataFrame], *,
                     unique: Sequence[tuple[str, Sequence[str]]] = (),
                     not_null: Sequence[tuple[str, Sequence[str]]] = (),
                     foreign: Sequence[tuple[str, str, str, str]] = (),
                     singleton: Sequence[str] = ()) -> DataFrame:
    """One row per constraint with the number of offending rows or keys.

    Each table is scanned once. A row gives one fact (constraint, key, whether it stands on the parent's side)
    for each constraint that it is under; all facts are counted by key in one shuffle, combined before it, so that a
    value held by a third of the rows travels once per task. What offends is read off the counts.
    """
    rules: list[tuple[str, str, str]] = []  # table, name, kind
    facts: dict[str, list[Column]] = {}

    def add(table: str, name: str, kind: str, key: Column, when: Column | None = None, parent: str | None = None, parent_key: Column | None = None) -> None:
        def fact(k: Column, held: bool, where: Column | None) -> Column:
            one = F.struct(F.lit(len(rules)).alias("rule"), k.alias("key"), F.lit(held).alias("held"))
            return one if where is None else F.when(where, one)

        facts.setdefault(table, []).append(fact(key, False, when))
        if parent is not None:
            facts.setdefault(parent, []).append(fact(parent_key, True, None))
        rules.append((table, name, kind))

    for table, cols in unique:
        add(table, "unique " + ",".join(cols), "keys", _key(cols))
    for table, cols in not_null:
        for col in cols:
            add(table, f"not null {col}", "rows", F.lit(""), F.col(col).isNull())
    for table, col, parent, parent_col in foreign:
        add(table, f"foreign {col} -> {parent}.{parent_col}", "orphans", _key([col]), F.col(col).isNotNull(), parent, _key([parent_col]))
    for table in singleton:
        add(table, "single row", "more than one", F.lit(""))
    rows = None
    for table, found in facts.items():
        part = tables[table].select(F.inline(F.filter(F.array(*found), lambda f: f.isNotNull())))
        rows = part if rows is None else rows.unionByName(part)
    per = rows.groupBy("rule", "key").agg(F.count_if(~F.col("held")).alias("n"), F.bool_or("held").alias("held"))
    names = per.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rules)], "rule int, table_name string, constraint_name string, kind string")
    offends = (F.when(F.col("kind") == "keys", (F.col("n") > 1).cast("bigint")).when(F.col("kind") == "rows", F.col("n"))
               .when(F.col("kind") == "orphans", F.when(~F.col("held"), F.col("n"))).otherwise(F.greatest(F.lit(0), F.col("n") - 1)))
    counted = per.join(F.broadcast(names.select("rule", "kind")), "rule").groupBy("rule").agg(F.sum(offends).alias("n"))  # a row per rule
    return names.join(F.broadcast(counted), "rule", "left").select(
        "table_name", "constraint_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("violations"))
