"""The decision rule, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creativeaudit import constants as C


def band(present: Column) -> Column:
    """NULL is its own answer and is never read as false."""
    return F.when(present.isNull(), "uncertain").when(present, "present").otherwise("absent")


def band_rank(band_col: Column) -> Column:
    rank = F.lit(None).cast("int")
    for name, value in C.BAND_PRECEDENCE.items():
        rank = F.when(band_col == name, value).otherwise(rank)
    return F.coalesce(rank, F.lit(0))


def confidence(present: Column, score: Column, high: float = C.CONFIDENCE_HIGH,
               medium: float = C.CONFIDENCE_MEDIUM) -> Column:
    """An uncertain answer has no margin, whatever its score."""
    return (F.when(present.isNull(), "low").when(score >= high, "high")
            .when(score >= medium, "medium").otherwise("low"))


def effective_calibrated(calibrated: Column, seen: Column, live: Column) -> Column:
    """A measurement made under another catalog version is stale."""
    unknown = F.coalesce(live, F.lit("")) == ""
    unseen = F.coalesce(seen, F.lit("")) == ""
    return (F.when(~F.coalesce(calibrated, F.lit(False)), False)
            .when(unknown | unseen, True).otherwise(seen == live))


def token(c: Column) -> Column:
    """A value as fingerprint text; NULL and '' stay different."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~"))


def number_token(c: Column) -> Column:
    """A float as fingerprint text: the one that reads back as the same double, so that any edit shows."""
    return token(c.cast("double").cast("string"))
