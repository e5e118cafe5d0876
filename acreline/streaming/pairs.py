"""Outer joins of two streams by key and distance in time, each with a watermark of its own.

A row of the left side comes out once: with each partner it meets, or alone once the right
side's clock says that none can come any more. State is dropped by the same bound, so it
holds the rows of one interval and of the time that late rows are waited for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within(left: DataFrame, right: DataFrame, keys: list[str], at: tuple[str, str], before: str, after: str, late: tuple[str, str]) -> DataFrame:
    """left with the columns of `right` whose time is from `before` before to `after` after the left row's time, or nulls.

    Column names of the two sides must differ but for `keys`.
    """
    one, two = left.withWatermark(at[0], late[0]), right.withWatermark(at[1], late[1])
    for k in keys:
        two = two.withColumnRenamed(k, f"__{k}")
    meets = [F.col(k) == F.col(f"__{k}") for k in keys]
    meets.append(F.expr(f"{at[1]} >= {at[0]} - INTERVAL {before} AND {at[1]} <= {at[0]} + INTERVAL {after}"))
    on = meets[0]
    for m in meets[1:]:
        on = on & m
    return one.join(two, on, "left").drop(*[f"__{k}" for k in keys])
