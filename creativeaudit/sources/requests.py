"""Logged request bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creativeaudit.functions.text import clean_tags, tags_from_csv, trim_space

MEDIA_FIELDS = ("media_base64", "image_base64")
URL_FIELDS = ("media_url", "image_url")


def _string_field(name: str) -> Column:
    # Only a JSON string counts; a number or an object under the name is skipped.
    value = F.expr(f"try_variant_get(body, '$.{name}', 'string')")
    is_text = F.expr(f"schema_of_variant(variant_get(body, '$.{name}', 'variant'))") == "STRING"
    return F.when(is_text & (trim_space(value) != ""), value)


def request_intake(requests: DataFrame) -> DataFrame:
    """S3: bodies to media bytes or URL plus tags; the first field filled in decides.

    ``requests``: request_id, body_json.
    """
    body = requests.select("request_id", F.try_parse_json("body_json").alias("body"))
    kind = F.expr("schema_of_variant(body)")
    tags_kind = F.expr("schema_of_variant(variant_get(body, '$.tags', 'variant'))")
    # List items count by their text; null and booleans have a text of their own.
    items = F.expr("""transform(try_variant_get(body, '$.tags', 'array<variant>'), v -> CASE schema_of_variant(v)
        WHEN 'VOID' THEN 'None' WHEN 'BOOLEAN' THEN initcap(CAST(v AS STRING)) ELSE try_variant_get(v, '$', 'string') END)""")
    text = F.expr("try_variant_get(body, '$.tags', 'string')")
    tags = (F.when(tags_kind == "STRING", tags_from_csv(text))
            .when(tags_kind.startswith("ARRAY"), clean_tags(items)))
    encoded = F.coalesce(*[_string_field(f) for f in MEDIA_FIELDS])
    url = trim_space(F.coalesce(*[_string_field(f) for f in URL_FIELDS]))
    rows = body.select(
        "request_id", kind.startswith("OBJECT").alias("is_object"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
        encoded.alias("encoded"), F.when(encoded.isNull(), url).alias("media_url"))
    # Anything up to the first comma is a data: prefix.
    payload = trim_space(F.regexp_replace("encoded", r"^[^,]*,", ""))
    # try_to_binary lets inner white space and missing padding pass.
    well_formed = (F.length(payload) % 4 == 0) & ~payload.rlike(r"(?U)[\s\x1c-\x1f]")
    rows = rows.withColumn("media", F.when(well_formed, F.try_to_binary(payload, F.lit("base64"))))
    code = (F.when(~F.coalesce("is_object", F.lit(False)), "BAD_REQUEST")
            .when(F.size("tags") == 0, "NO_TAGS")
            .when(F.col("encoded").isNotNull() & F.col("media").isNull(), "INVALID_IMAGE")
            .when(F.col("encoded").isNull() & F.col("media_url").isNull(), "NO_IMAGE"))
    return rows.select("request_id", "tags", "media", "media_url", code.alias("reject_code"))
