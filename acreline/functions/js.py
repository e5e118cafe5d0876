"""Number and null semantics that the rules are written in: falsy values, half-up rounding, clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(c: Column) -> Column:
    """c, or NULL where it is 0."""
    return F.nullif(c, F.lit(0))


def filled(c: Column) -> Column:
    """c, or NULL where it is the empty string."""
    return F.nullif(c, F.lit(""))


def round_half_up(c: Column, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d, which rounds -2.5 to -2; BIGINT without digits."""
    if not digits:
        return F.floor(c + 0.5).cast("long")
    return F.floor(c * float(10**digits) + 0.5) / float(10**digits)


def percent(part: Column, whole: Column, digits: int = 0) -> Column:
    """100 * part / whole rounded half up, 0 where whole is 0 or NULL."""
    ratio = F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(part * F.lit(100.0) / whole)
    return round_half_up(ratio, digits)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^(-6 (x - 0.5)))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-6.0) * (x - 0.5)))


def upper_pick(values: Column, q: float) -> Column:
    """Element floor(n * q) of an ascending array, the last one at most; NULL for an empty one."""
    n = F.size(values)
    at = F.least(n - 1, F.floor(n * F.lit(q)).cast("int"))
    return F.when(n > 0, F.get(values, at))
