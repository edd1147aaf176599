"""Requests against the catalog, and replies against what was asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creativeaudit import constants as C
from creativeaudit.operators.sizing import fits


def active_slugs(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("status") == "active").select("slug")


def unknown_tag_gate(requests: DataFrame, catalog: DataFrame,
                     inline_up_to: int = C.CATALOG_CAP) -> DataFrame:
    """One unknown tag rejects the whole request.

    Adds ``unknown`` (in request order, each once) and ``accepted``. A catalog
    within the cap is inlined as one array and costs no shuffle; a larger one
    is joined, which gives the same answer. ``requests``: request_id, tags, ...
    """
    known = active_slugs(catalog)
    if fits(known, inline_up_to):
        as_array = known.agg(F.sort_array(F.collect_set("slug")).alias("known")).scalar()
        out = requests.withColumn("unknown", F.array_except("tags", as_array))
    else:
        # What is unknown depends on the list of tags alone, so each different list is looked up once.
        lists = requests.select("tags").distinct().filter(F.col("tags").isNotNull())
        asked = lists.select("tags", F.posexplode("tags").alias("pos", "slug"))
        missing = asked.join(known.distinct(), "slug", "left_anti")
        found = missing.groupBy("tags").agg(F.array_distinct(F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "slug"))), lambda s: s["slug"])).alias("unknown"))
        out = requests.join(found, "tags", "left").select(*requests.columns, F.when(
            F.col("tags").isNotNull(), F.coalesce("unknown", F.array().cast("array<string>"))).alias("unknown"))
    return out.withColumn("accepted", F.size("unknown") == 0)


def known_tags(catalog: DataFrame) -> DataFrame:
    """The ``known`` list of a rejection, one row per active tag, sorted."""
    return active_slugs(catalog).distinct().orderBy("slug")


def fixture_scorer(frames: DataFrame, fixture: DataFrame) -> DataFrame:
    """Deterministic scorer answering from a table of (hash, slug, present).

    ``frames``: creative_id, frame_index, hash, tags. An explicit NULL and a
    missing entry both score 0.0 but say so in different words.
    """
    asked = frames.select("creative_id", "frame_index", "hash", F.explode("tags").alias("tag"))
    f = fixture.select("hash", F.col("slug").alias("tag"), "present", F.lit(True).alias("listed"))
    said = F.when(F.col("present").isNull(), "None").when(F.col("present"), "True").otherwise("False")
    return asked.join(f, ["hash", "tag"], "left").select(
        "creative_id", "frame_index", "tag", "present",
        F.when(F.col("present").isNull(), 0.0).otherwise(1.0).alias("score"),
        F.when(F.col("listed"), F.concat(F.lit(C.FIXTURE_SAYS), said)).otherwise(C.FIXTURE_SILENT).alias("top_phrase"),
        F.lit(C.DECIDED_BY).alias("decided_by"))


def tag_set_diff(df: DataFrame, wanted: str = "wanted", seen: str = "seen") -> DataFrame:
    """Both differences of two tag sets, sorted."""
    return (df.withColumn("missing", F.array_sort(F.array_except(wanted, seen)))
            .withColumn("extra", F.array_sort(F.array_except(seen, wanted))))


def reply_completeness(frames: DataFrame, wanted: DataFrame, answers: DataFrame) -> DataFrame:
    """Every frame and every wanted tag answered, nothing else, or the creative fails.

    ``frames``: creative_id, frame_index as sent. ``wanted``: creative_id, tags.
    ``answers``: creative_id, frame_index, reply_frame (ordinal of the frame in
    the reply), slug. When a frame index is answered twice the last one counts.
    Lists are bounded: a creative's answers come from one reply document.
    """
    empty = F.array().cast("array<string>")
    answer = F.struct(F.col("reply_frame").alias("nth"), "slug")
    rows = frames.select("creative_id", "frame_index", F.lit(True).alias("sent"),
                         F.lit(None).cast("int").alias("reply_frame"), F.lit(None).cast("string").alias("slug"))
    rows = rows.unionByName(answers.select("creative_id", "frame_index", F.lit(False).alias("sent"),
                                           F.col("reply_frame").cast("int").alias("reply_frame"), "slug"))
    grid = rows.groupBy("creative_id", "frame_index").agg(
        F.bool_or("sent").alias("sent"),
        F.collect_set(F.when(F.col("reply_frame").isNotNull(), answer)).alias("answers"))
    last = F.array_max(F.transform("answers", lambda a: a["nth"]))
    seen = F.transform(F.filter("answers", lambda a: (a["nth"] == last) & a["slug"].isNotNull()), lambda a: a["slug"])
    grid = grid.select("creative_id", "frame_index", "sent", seen.alias("seen"),
                       F.size(F.array_distinct(F.transform("answers", lambda a: a["nth"]))).alias("reply_frames"))
    grid = grid.join(wanted.select("creative_id", F.col("tags").alias("wanted")), "creative_id", "left")
    grid = tag_set_diff(grid.withColumn("wanted", F.when(F.col("sent"), F.col("wanted")).otherwise(empty)))
    label = lambda tags: F.transform(
        tags, lambda t: F.concat(F.col("frame_index").cast("string"), F.lit(":"), t))
    # A reply for a frame never sent is not read, but its count must not differ.
    unexpected = F.when(F.col("sent"), label(F.col("extra"))).otherwise(empty)
    out = grid.groupBy("creative_id").agg(
        F.array_sort(F.flatten(F.collect_list(label(F.col("missing"))))).alias("missing"),
        F.array_sort(F.flatten(F.collect_list(unexpected))).alias("unexpected"),
        F.count_if(F.col("sent")).alias("frames_sent"),
        F.sum("reply_frames").alias("frames_answered"))
    complete = ((F.size("missing") == 0) & (F.size("unexpected") == 0)
                & (F.col("frames_sent") == F.col("frames_answered")))
    return out.withColumn("complete", complete)


def tristate_strict(replies: DataFrame) -> DataFrame:
    """P10: parse model replies without coercing anything.

    ``replies``: creative_id, reply_json. One row per frame and tag; ``error``
    says what is wrong with the answer. A missing key and an explicit null are
    told apart, which a typed JSON read cannot do. A document that is not JSON
    or has no frame list gives a single error row.
    """
    doc = replies.select("creative_id", F.try_parse_json("reply_json").alias("doc"))
    doc = doc.withColumn("frames", F.expr("try_variant_get(doc, '$.frames', 'array<variant>')"))
    frames = doc.select("creative_id", F.col("frames").isNull().alias("broken"),
                        F.posexplode_outer("frames").alias("reply_frame", "frame"))
    frames = frames.withColumn("frame_index", F.expr("try_variant_get(frame, '$.index', 'bigint')"))
    frames = frames.withColumn("index_type", F.expr(
        "schema_of_variant(variant_get(frame, '$.index', 'variant'))"))
    frames = frames.withColumn("tags", F.expr("try_variant_get(frame, '$.tags', 'array<variant>')"))
    rows = frames.select("creative_id", "broken", "reply_frame", "frame_index", "index_type",
                         F.col("tags").isNull().alias("no_tags"), F.explode_outer("tags").alias("t"))

    def kind(field: str) -> str:
        return f"schema_of_variant(variant_get(t, '$.{field}', 'variant'))"

    number = "('BIGINT', 'DOUBLE', 'FLOAT') "
    rows = rows.select(
        "*",
        F.expr("try_variant_get(t, '$.slug', 'string')").alias("slug"),
        F.expr("try_variant_get(t, '$.present', 'boolean')").alias("_present"),
        F.expr("try_variant_get(t, '$.confidence', 'double')").alias("confidence"),
        F.expr("try_variant_get(t, '$.evidence', 'string')").alias("evidence"),
        F.expr(kind("slug")).alias("slug_type"), F.expr(kind("present")).alias("present_type"),
        F.expr(f"{kind('confidence')} IN {number} OR {kind('confidence')} LIKE 'DECIMAL%'").alias("is_number"),
        F.expr(kind("evidence")).alias("evidence_type"))
    error = (
        F.when(F.col("broken"), "reply is not a frame list")
        .when(F.col("reply_frame").isNotNull() & ~F.coalesce(F.col("index_type") == "BIGINT", F.lit(False)),
              "frame index missing or not an integer")
        .when(F.col("reply_frame").isNotNull() & F.col("no_tags"), "frame has no tag list")
        .when(F.col("t").isNull(), F.lit(None))
        .when(~F.coalesce(F.col("slug_type") == "STRING", F.lit(False)), "slug missing or not text")
        .when(F.col("present_type").isNull(), "present missing")
        .when(~F.col("present_type").isin("BOOLEAN", "VOID"), "present is not true, false or null")
        .when(~F.coalesce(F.col("is_number"), F.lit(False)), "confidence missing or not a number")
        .when(~F.col("confidence").between(0.0, 1.0), "confidence outside 0..1")
        .when(~F.coalesce(F.col("evidence_type") == "STRING", F.lit(False)), "evidence missing or not text"))
    return rows.select(
        "creative_id", "reply_frame", "frame_index", "slug",
        F.when(F.col("present_type") == "BOOLEAN", F.col("_present")).alias("present"),
        F.when(F.col("is_number"), F.col("confidence")).alias("confidence"), "evidence",
        error.alias("error"))


def tag_groups(catalog: DataFrame) -> DataFrame:
    """Active tags under their display sections; unlisted ones go last, under Other."""
    entries = F.array(*[
        F.struct(F.lit(slug).alias("slug"), F.lit(title).alias("section"), F.lit(restricted).alias("restricted"),
                 F.lit(s).alias("section_no"), F.lit(p).alias("place"))
        for s, (title, restricted, slugs) in enumerate(C.SECTIONS) for p, slug in enumerate(slugs)])
    sections = catalog.sparkSession.range(1).select(F.inline(entries))
    rows = catalog.filter(F.col("status") == "active").join(F.broadcast(sections), "slug", "left")
    rows = (rows.withColumn("section_no", F.coalesce("section_no", F.lit(len(C.SECTIONS))))
            .withColumn("section", F.coalesce("section", F.lit(C.OTHER_SECTION)))
            .withColumn("restricted", F.coalesce("restricted", F.lit(False)))
            .withColumn("position", F.coalesce(F.col("place"), F.col("sort_order"))))
    return (rows.select("section_no", "section", "restricted", "slug", "position")
            .orderBy("section_no", "position", "slug"))
