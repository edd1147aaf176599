"""Rounding of published rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF = 40


def _exact(x: Column) -> Column:
    """x * 2^80 as a whole number: two halves of 40 bits hold all bits of a double from 2^-27 on."""
    high = F.floor(x * float(2 ** HALF))
    low = F.floor((x * float(2 ** HALF) - high) * float(2 ** HALF))
    return high.cast("decimal(14,0)") * F.lit(2 ** HALF).cast("decimal(13,0)") + low.cast("decimal(14,0)")


def round_rate(x: Column, digits: int) -> Column:
    """A rate from 0 to 1, rounded to ``digits`` (4 at most) decimals by its exact binary value.

    3/80 is slightly below 0.0375 as a double and becomes 0.037 at three
    digits. Exact halves, such as 5/16, go to the even digit.
    """
    ten = 10 ** digits
    scaled = _exact(x) * F.lit(2 * ten).cast("decimal(6,0)")
    unit = F.lit(str(2 ** (2 * HALF))).cast("decimal(25,0)")
    near = F.floor(x * float(ten))
    # The product may have been rounded up to the next whole number.
    k = F.when((2 * near).cast("decimal(6,0)") * unit > scaled, near - 1).otherwise(near)
    half = (2 * k + 1).cast("decimal(6,0)") * unit
    return (F.when(scaled > half, k + 1).when(scaled < half, k).otherwise(k + k % 2) / F.lit(float(ten))).cast("double")
