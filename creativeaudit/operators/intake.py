"""What arrives: media bytes, tag lists, URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creativeaudit import constants as C
from creativeaudit.functions import media as M
from creativeaudit.functions import net as N
from creativeaudit.functions import text as T


def normalise_tags(df: DataFrame, column: str = "tags_csv") -> DataFrame:
    """Clean tag list plus NO_TAGS when nothing is left."""
    raw = F.col(column)
    is_array = df.schema[column].dataType.typeName() == "array"
    cleaned = T.clean_tags(raw) if is_array else T.tags_from_csv(raw)
    tags = F.coalesce(cleaned, F.array().cast("array<string>"))
    return df.withColumn("tags", tags).withColumn(
        "reject_code", F.when(F.size("tags") == 0, "NO_TAGS"))


def sniff_media(df: DataFrame, column: str = "content") -> DataFrame:
    """Kind and MIME from the bytes."""
    return (df.withColumn("kind", M.media_kind(F.col(column)))
            .withColumn("mime", F.when(F.col("kind") == "image", M.image_mime(F.col(column)))))


def intake_gate(df: DataFrame, **limits) -> DataFrame:
    """Reject code per item. Needs kind, n_bytes, duration_s, n_frames; uses mime if there."""
    mime = F.col("mime") if "mime" in df.columns else None
    return df.withColumn("reject_code", M.reject_code(
        F.col("kind"), F.col("n_bytes"), F.col("duration_s"), F.col("n_frames"), mime, **limits))


def media_inventory(media: DataFrame, **limits) -> DataFrame:
    """Hash of the original bytes, size, kind, MIME and reject code per item.

    ``media``: path, content. One narrow pass over the scan; no shuffle.
    """
    sized = sniff_media(media).select(
        "path", F.sha2("content", 256).alias("media_hash"),
        F.octet_length("content").cast("bigint").alias("n_bytes"), "kind", "mime",
        F.lit(None).cast("double").alias("duration_s"), F.lit(None).cast("int").alias("n_frames"))
    return intake_gate(sized, **limits).drop("duration_s", "n_frames")


def content_dedupe(items: DataFrame) -> DataFrame:
    """One row per content hash with its first submission and number of copies.

    ``items``: media_hash, submitted_at, id. Both aggregates combine before
    the shuffle, so a file copied a billion times costs one row per task.
    """
    first = F.min(F.struct("submitted_at", "id"))
    return items.groupBy("media_hash").agg(
        first["id"].alias("first_id"), first["submitted_at"].alias("first_at"),
        F.count(F.lit(1)).alias("n_copies"))


def url_guard(df: DataFrame, url: str = "url", addresses: str | None = None) -> DataFrame:
    """P5: may this URL be fetched? ``addresses`` holds what the host resolved to."""
    allowed = N.url_allowed(F.col(url), F.col(addresses) if addresses else None)
    return (df.withColumn("scheme", N.url_scheme(F.col(url)))
            .withColumn("host", N.url_host(F.col(url)))
            .withColumn("allowed", allowed)
            .withColumn("reject_code", F.when(~F.col("allowed"), "INVALID_IMAGE_URL")))


def rejects(*rejected: DataFrame) -> DataFrame:
    """All rejected rows with their response status. Each input: request_id, reject_code."""
    rows = None
    for df in rejected:
        part = df.filter(F.col("reject_code").isNotNull()).select("request_id", "reject_code")
        rows = part if rows is None else rows.unionByName(part)
    status = F.lit(500)
    for code, http in C.ERROR_STATUS.items():
        status = F.when(F.col("reject_code") == code, http).otherwise(status)
    return rows.select("request_id", F.col("reject_code").alias("code"), status.alias("status"))


def first_reject(df: DataFrame, *codes: str) -> DataFrame:
    """Each rejected request once, with the first of ``codes`` (columns, most urgent first) that isn't NULL."""
    return rejects(df.withColumn("reject_code", F.coalesce(*codes)))


def reject_counts(reject_rows: DataFrame) -> DataFrame:
    """Rejects per code."""
    return reject_rows.groupBy("code", "status").agg(F.count(F.lit(1)).alias("n"))
