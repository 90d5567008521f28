"""Decimal rounding of doubles that looks at the exact binary value, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_round(value: Column, digits: int) -> Column:
    """``value`` to ``digits`` decimals as correctly rounded arithmetic would give it.

    Spark's ``round`` works on the printed decimal, so 2.675 (really 2.67499999...) becomes 2.68.
    Here the value is compared with the midpoint (2k+1) / (2 * 10^digits) exactly: the factor is
    taken apart into powers of two and subtracted largest first, which loses no bit near the
    midpoint.
    """
    scale = 10**digits
    size = F.abs(value)
    whole = F.floor(size * float(scale))
    rest = (whole * 2 + 1).cast("double")
    factor = 2 * scale
    while factor & (factor - 1):
        power = 1 << (factor.bit_length() - 1)
        rest = rest - size * float(power)
        factor -= power
    side = size * float(factor) - rest
    up = (side > 0) | ((side == 0) & (whole % 2 == 1))
    magnitude = (whole + up.cast("long")) / F.lit(float(scale))
    return F.when(value < 0, -magnitude).otherwise(magnitude)
