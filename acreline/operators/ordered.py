"""Order-dependent operators: dedup, streaks, legs, spines, regressions, split scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreline.functions import geo


def keep_first(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by `order`."""
    names = rows.columns
    rank = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(rank)).filter("__rank = 1").select(*names)


def legs(stops: DataFrame, route: str = "route_id", pos: str = "pos") -> DataFrame:
    """Miles from each stop to the next on its route, and the miles so far."""
    along = Window.partitionBy(route).orderBy(pos)
    ahead = geo.haversine_miles(F.col("lat"), F.col("lng"), F.lead("lat").over(along), F.lead("lng").over(along))
    return stops.withColumn("leg", F.coalesce(ahead, F.lit(0.0))).withColumn("so_far", F.sum("leg").over(along.rowsBetween(Window.unboundedPreceding, -1)))


def streaks(rows: DataFrame, key: str, ts: str, today: str, cap: int = 365) -> DataFrame:
    """Per key the number of consecutive active days up to today, or to yesterday if today has none."""
    days = rows.select(key, F.to_date(ts).alias("day")).distinct().filter(F.col("day") <= F.lit(today).cast("date"))
    islands = days.withColumn("island", F.date_sub("day", F.row_number().over(Window.partitionBy(key).orderBy("day"))))
    runs = islands.groupBy(key, "island").agg(F.max("day").alias("last"), F.count("*").alias("n"))
    current = runs.filter(F.datediff(F.lit(today).cast("date"), "last") <= 1)
    return current.select(key, F.least(F.col("n"), F.lit(cap)).alias("streak"))


def trend(daily: DataFrame, value: str = "n") -> DataFrame:
    """(slope, intercept, label) of a daily series, days numbered from the first of 2024."""
    at = daily.withColumn("x", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("double"))
    fit = at.agg(F.regr_slope(F.col(value).cast("double"), F.col("x")).alias("slope"), F.regr_intercept(F.col(value).cast("double"), F.col("x")).alias("intercept"))
    return fit.withColumn("label", F.when(F.col("slope") > 0.1, "up").when(F.col("slope") < -0.1, "down").otherwise("flat"))


#: Shares at which a history is split: the accumulated sums, so that the last one stays under .7.
SPLITS = (0.3, 0.35, 0.39999999999999997, 0.44999999999999996, 0.49999999999999994, 0.5499999999999999, 0.6, 0.65)


def adwin(rows: DataFrame, key: str, order: Sequence[str], value: str, least: int = 60, half: int = 30, divergence: float = 0.15) -> DataFrame:
    """Per key where its history is cut: the split of largest difference of means, if over `divergence`.

    Prefix sums give all splits in one pass over the key's rows.
    """
    along = Window.partitionBy(key).orderBy(*order)
    whole = Window.partitionBy(key)
    sums = rows.select(key, F.row_number().over(along).alias("i"), F.sum(value).over(along).alias("s"), F.count("*").over(whole).alias("n"), F.sum(value).over(whole).alias("t"))
    at = sums.withColumn("share", F.explode(F.array(*[F.lit(s) for s in SPLITS]))).filter((F.col("n") >= least) & (F.col("i") == F.floor(F.col("n") * F.col("share"))))
    gap = F.abs(F.col("s") / F.col("i") - (F.col("t") - F.col("s")) / (F.col("n") - F.col("i")))
    usable = at.filter((F.col("i") >= half) & (F.col("n") - F.col("i") >= half)).withColumn("gap", F.round(gap, 9))
    best = usable.groupBy(key).agg(F.max_by(F.struct("i", "gap"), F.struct("gap", -F.col("i"))).alias("best"))
    return best.select(key, F.when(F.col("best.gap") > divergence, F.col("best.i")).otherwise(0).cast("int").alias("cut_at"), "best.gap")


def ghosts(rows: DataFrame) -> DataFrame:
    """House numbers missing between consecutive ones of one street and side."""
    own = rows.select("zip_code", "street_name", "house_number").distinct().withColumn("side", F.col("house_number") % 2)
    ahead = F.lead("house_number").over(Window.partitionBy("zip_code", "street_name", "side").orderBy("house_number"))
    gaps = own.withColumn("ahead", ahead).filter("ahead - house_number BETWEEN 4 AND 40")
    return gaps.select("zip_code", "street_name", F.explode(F.sequence(F.col("house_number") + 2, F.col("ahead") - 2, F.lit(2))).alias("house_number"))
