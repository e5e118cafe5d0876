"""The property score that orders doors on a route: one expression over a row, its cell's activity and its log counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreline.functions import geo

# Fixed values of the scoring rules.
STATUS_POINTS = {"ELIGIBLE": 60, "UNVERIFIED": 40, "CALLBACK": 100, "NO_ANSWER": 30, "NOT_MOVED_IN": 20, "DM_NOT_HOME": 50, "QUALIFIED": 80}
QUICK_POINTS = {"ELIGIBLE": 60, "CALLBACK": 100, "QUALIFIED": 80, "UNVERIFIED": 40, "NO_ANSWER": 30}
RECENCY_POINTS = ((3, 80), (6, 60), (12, 40))
ACTIVE = ("SOLD", "QUALIFIED", "UNVERIFIED")


def days_since(as_of: Column, c: Column) -> Column:
    return (F.unix_millis(as_of) - F.unix_millis(c)) / 86_400_000.0


def _points(status: Column, points: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, n in points.items():
        out = F.when(status == name, n).otherwise(out)
    return out


def recency(days: Column, month: float) -> Column:
    """Points of a sale by its age; undated ones and those over a year get the least."""
    out = F.lit(20)
    for months, n in reversed(RECENCY_POINTS):
        out = F.when(days / month <= months, n).otherwise(out)
    return out


def activity(rows: DataFrame) -> DataFrame:
    """(q, r, active): how many active properties lie in each hexagon or a neighbour of it; summed per hexagon first."""
    q, r = geo.hexagon(F.col("lat"), F.col("lng"))
    per = rows.filter(F.col("effective_status").isin(*ACTIVE)).groupBy(q.alias("q"), r.alias("r")).agg(F.count("*").alias("n"))
    return per.select("n", F.inline(geo.hexagon_ring(F.col("q"), F.col("r")))).groupBy("q", "r").agg(F.sum("n").alias("active"))


def contacts(logs: DataFrame) -> DataFrame:
    """address_hash, visits, unanswered."""
    return logs.groupBy("address_hash").agg(F.count("*").alias("visits"), F.count_if(F.col("status") == "NO_ANSWER").alias("unanswered"))


def property_scores(rows: DataFrame, logs: DataFrame, as_of: Column, weights: dict[str, float] | None = None) -> DataFrame:
    """rows with score. They have an id, effective_status and two hashes; logs, counted per hash, meet ids by either of them and then rows by id."""
    q, r = geo.hexagon(F.col("lat"), F.col("lng"))
    hashes = rows.select(F.col("id").alias("__id"), F.explode(F.array_distinct(F.array("address_hash", "legacy_hash"))).alias("address_hash"))
    seen = hashes.join(contacts(logs), "address_hash").groupBy("__id").agg(F.sum("visits").alias("visits"), F.sum("unanswered").alias("unanswered"))
    # few hexagons against many rows: the cell's count is joined first, rows move to their id once
    joined = rows.withColumns({"q": q, "r": r}).join(activity(rows), ["q", "r"], "left").join(seen, F.col("id") == F.col("__id"), "left")
    joined = joined.withColumns({"visits": F.coalesce("visits", F.lit(0)), "unanswered": F.coalesce("unanswered", F.lit(0))})
    status, price, kind = F.col("effective_status"), F.col("price"), F.lower("property_type")
    days = days_since(as_of, F.col("sold_date"))
    years = days / 365.0
    score = F.lit(100) + _points(status, STATUS_POINTS) + F.when(status == "SOLD", recency(days, 30.0)).otherwise(0)
    equity = price * (F.lit(1) + years * 0.03) * (F.lit(0.2) + F.least(F.lit(1.0), years / 30.0) * 0.8)
    owned = F.when(equity > 200_000, 60).when(equity > 100_000, 30).otherwise(0) + F.when(years < 1, -30).when(years > 7, 40).otherwise(0)
    score = score + F.when(F.col("sold_date").isNotNull() & (price != 0), owned).otherwise(0)
    score = score + F.when(kind.contains("single"), 20).when(kind.contains("condo") | kind.contains("town"), -10).when(kind.contains("multi"), 10).otherwise(0)
    score = score + F.least(F.coalesce("active", F.lit(0)) * 5, F.lit(50))
    visits, unanswered = F.col("visits"), F.col("unanswered")
    score = score + F.when(visits > 3, -60).when((visits == 1) & (unanswered == 1), 25).when((visits == 2) & (unanswered == 2), -10).otherwise(0)
    score = (score + F.when(price > 1_000_000, 30).otherwise(0)).cast("double")
    applies = {
        "age_gt_10": F.year(as_of) - F.col("year_built") > 10, "price_gt_300k": price > 300_000, "single_family": kind.contains("single"),
        "recent_sale": years <= 3, "high_value": price > 750_000, "large_lot": F.col("lot_size") > 10_890,
    }
    for name, w in (weights or {}).items():
        score = score * F.when(applies[name], w).otherwise(1.0)
    score = F.when(status == "HARD_NO", 0.0).otherwise(F.greatest(F.lit(0.0), F.floor(score + 0.5).cast("double")))
    return joined.select(*rows.columns, score.alias("score"))


def quick_scores(rows: DataFrame, as_of: Column) -> DataFrame:
    """rows with the short form of the score, of status, sale and price alone."""
    status = F.col("effective_status")
    sold = F.when((status == "SOLD") & F.col("sold_date").isNotNull(), recency(days_since(as_of, F.col("sold_date")), 30.44)).otherwise(0)
    base = F.when(status == "HARD_NO", 0).otherwise(F.lit(100) + _points(status, QUICK_POINTS))
    return rows.withColumn("score", (base + sold + F.when(F.col("price") > 1_000_000, 30).otherwise(0)).cast("double"))
