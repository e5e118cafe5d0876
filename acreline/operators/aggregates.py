"""Aggregations over the log and the properties: boards, spines, index picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreline.functions.js import percent


def is_(status: str) -> Column:
    return F.col("status") == status


def board(logs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Knocks, sales, conversion, active hours and doors an hour per key; distinct hours are summed up before the shuffle."""
    per = logs.groupBy(*keys).agg(
        F.count("*").alias("knocks"), F.count_if(is_("SOLD")).alias("sales"), F.countDistinct(F.date_trunc("hour", "ts")).alias("active_hours"),
    )
    return per.withColumns({"conversion": percent(F.col("sales"), F.col("knocks"), 1), "doors_per_hour": F.floor(F.col("knocks") / F.greatest(F.col("active_hours"), F.lit(1)) * 10 + 0.5) / 10})


def index_pick(rows: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    """Per key the value at position floor(n * q) of the ascending order, as `pick`.

    Equal values are counted first and positions come from running counts, so a key with
    many rows of few values costs one row a value.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    up_to = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    at = counts.withColumn("__to", F.sum("__n").over(up_to)).withColumn("__all", F.sum("__n").over(whole))
    wanted = F.least(F.floor(F.col("__all") * F.lit(q)), F.col("__all") - 1)
    return at.filter((F.col("__to") > wanted) & (F.col("__to") - F.col("__n") <= wanted)).select(*keys, F.col(value).alias("pick"))


#: Ranks within this share of all rows are told apart by a sketch; distinct values of a band that may be sorted in one task.
SKETCH, NARROW = 1e-5, 1_000_000


def overall_picks(rows: DataFrame, wanted: dict[str, tuple[Column, float]], share: float = SKETCH, narrow: int = NARROW) -> DataFrame:
    """One row with, under each name, the value at position floor(n * q) of its column's ascending order over all rows (null if it has none).

    A mergeable sketch of all columns gives each a low and a high value around its position,
    with a rank error below `share` of the rows whatever their distribution; the next pass
    counts what lies below and between. A band of more than `narrow` values is narrowed again
    in the same way, any other is counted value by value and holds the answer: three passes
    over up to some ten billion different values, and a few numbers a column at the driver.
    """
    values = rows.select(*[F.nanvl(c.cast("double"), F.lit(None)).alias(name) for name, (c, _) in wanted.items()])
    asked = {c: q for c, (_, q) in wanted.items()}
    bands: dict[str, tuple[float, float]] = {}
    place: dict[str, int] = {}
    below: dict[str, int] = {}
    between = lambda c: F.col(c).between(*bands[c])
    while asked:
        held = {c: F.when(between(c), F.col(c)) if c in bands else F.col(c) for c in asked}
        around = {c: F.percentile_approx(held[c], [max(0.0, q - 2 * share), min(1.0, q + 2 * share)], round(1 / share)) for c, q in asked.items()}
        seen = values.agg(*[F.count(held[c]).alias(f"n_{c}") for c in asked], *[around[c].alias(f"b_{c}") for c in asked]).first()
        asked = {c: q for c, q in asked.items() if seen[f"n_{c}"]}
        if not asked:
            break
        for c in asked:
            place.setdefault(c, min(int(seen[f"n_{c}"] * wanted[c][1]), seen[f"n_{c}"] - 1))
            bands[c] = tuple(seen[f"b_{c}"])
        counts = {f"u_{c}": F.count_if(F.col(c) < bands[c][0]) for c in asked} | {f"w_{c}": F.count_if(between(c)) for c in asked} | {f"d_{c}": F.approx_count_distinct(F.when(between(c), F.col(c))) for c in asked}
        seen = values.agg(*[x.alias(name) for name, x in counts.items()]).first()
        below |= {c: seen[f"u_{c}"] for c in asked}
        asked = {c: (place[c] - below[c] + 0.5) / seen[f"w_{c}"] for c in asked if seen[f"d_{c}"] > narrow}
    if not place:
        return rows.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(c) for c in wanted])
    some = F.array(*[F.struct(F.lit(c).alias("name"), F.when(between(c), F.col(c)).alias("v"), F.lit(place[c] - below[c]).alias("left")) for c in place])
    counted = values.select(F.inline(some)).filter("v IS NOT NULL").groupBy("name", "left", "v").agg(F.count("*").alias("k"))
    running = counted.withColumn("upto", F.sum("k").over(Window.partitionBy("name").orderBy("v")))  # some `narrow` rows each
    hit = running.filter("upto > left AND upto - k <= left")
    return hit.agg(*[F.max(F.when(F.col("name") == c, F.col("v"))).alias(c) for c in wanted])


def overall_pick(rows: DataFrame, value: str, q: float) -> DataFrame:
    """The value at position floor(n * q) of the ascending order of all rows, as `pick` (no row if there is none)."""
    return overall_picks(rows, {"pick": (F.col(value), q)}).filter("pick IS NOT NULL")


def daily(rows: DataFrame, ts: str, first: str, last: str, **measures: Column) -> DataFrame:
    """One row a calendar day from first to last, measures 0 where nothing happened."""
    days = rows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    per = rows.groupBy(F.to_date(ts).alias("day")).agg(*[c.alias(n) for n, c in measures.items()])
    return days.join(per, "day", "left").select("day", *[F.coalesce(n, F.lit(0)).alias(n) for n in measures])


def top(rows: DataFrame, key: str, n: int, value: str = "n") -> DataFrame:
    """The n most frequent keys, ties by key."""
    return rows.groupBy(key).agg(F.count("*").alias(value)).orderBy(F.desc(value), key).limit(n)
