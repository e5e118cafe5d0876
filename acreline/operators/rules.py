"""Classification rules as expressions: listing scores in their four variants, confidence, effective status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreline.functions.dates import days_between, fractional_days
from acreline.functions.js import truthy


def _n(c: Column) -> Column:
    return c.cast("int")


def _points(*rules: tuple[int, Column]) -> Column:
    """Sum of the points of the rules that hold."""
    out = F.lit(0)
    for points, rule in rules:
        out = out + F.when(F.coalesce(rule, F.lit(False)), points).otherwise(0)
    return out


class Listing:
    """What the variants look at, as expressions over a listing row."""

    def __init__(self, as_of: Column) -> None:
        removed, listed, seen = F.col("removed"), F.col("listed"), F.col("last_seen")
        self.since_removed = days_between(as_of, removed)
        self.dom = F.coalesce(truthy(F.col("dom")), self.since_removed)
        self.duration = F.coalesce(days_between(removed, listed), self.dom)
        self.gap = fractional_days(removed, seen)
        self.history = F.col("n_history")


def chunk_v15(as_of: Column) -> tuple[Column, Column]:
    """(score, label): dropped up to 0, above it pending verification."""
    x = Listing(as_of)
    score = _points(
        (-3, x.dom > 150), (-2, (x.dom > 60) & (x.dom <= 150)), (-1, x.duration < 7), (-3, F.abs(x.gap) < 1), (-1, x.history >= 3),
        (3, x.dom < 30), (2, (x.duration > 0) & (x.duration < 45)), (1, x.gap >= 7), (1, x.history == 1),
    )
    return score, F.when(score <= -2, "REJECTED").when(score <= 0, "AMBIGUOUS").otherwise("MLS_PENDING_VERIFICATION")


def zip_v8(as_of: Column) -> tuple[Column, Column]:
    """(score, label) with penalties near the usual listing terms of 90, 180 and 365 days."""
    x = Listing(as_of)
    near = lambda c, d: F.abs(c - d) <= 3
    score = _points(
        *[(-3, near(x.dom, d)) for d in (90, 180, 365)], *[(-2, near(x.duration, d)) for d in (90, 180, 365)], (-3, x.dom > 150), (-2, (x.dom > 60) & (x.dom <= 150)),
        (-2, x.duration < 7), (-2, F.abs(x.gap) < 1), (-1, x.history >= 3), (3, x.dom.between(30, 45)), (2, (x.dom >= 14) & (x.dom < 30)), (1, x.gap >= 7), (1, x.history == 1),
    )
    label = F.when(x.since_removed > 90, "REJECTED").when(score <= -4, "REJECTED").when(score >= 3, "HEURISTIC_SOLD").otherwise("RECENT_OFF_MARKET")
    return score, label


def sale_confidence(price: Column, assessed: Column, corporate: Column) -> Column:
    return F.when(corporate, "medium").when((assessed > 0) & (price < assessed * 0.5), "medium").otherwise("high")


def effective_status(props: DataFrame, logs: DataFrame, as_of: Column) -> DataFrame:
    """id, effective: cool-down first, then the latest result of the property's doors, then its own status."""
    last = logs.groupBy("pid").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("last"))
    joined = props.join(last, props["id"] == last["pid"], "left")
    result, at = F.col("last.status"), F.col("last.ts")
    until = F.when(result == "NO_ANSWER", F.date_add(F.to_date(at), 14))
    effective = (
        F.when(until > F.to_date(as_of), "COOLDOWN").when(result.isNull(), F.when(F.col("status").isin("HARD_NO", "DO_NOT_KNOCK", "UNVERIFIED"), F.col("status")).otherwise("ELIGIBLE"))
        .when(result.isin("HARD_NO", "SOLD"), result).when(result == "NO_ANSWER", "ELIGIBLE").when(result == "CALLBACK", F.when(F.date_add(F.to_date(at), 1) <= F.to_date(as_of), "ELIGIBLE").otherwise("CALLBACK")).otherwise(result)
    )
    return joined.select("id", effective.alias("effective"))


def outcome(rental: Column, active: Column, occupied: Column, status: Column, recorded_days: Column) -> Column:
    """The verifier's answer, first rule that holds."""
    return (
        F.when(rental, "rejected").when(active, "rejected").when(~occupied, "rejected").when((status == "SOLD") & (recorded_days <= 90), "sold")
        .when(status.isin("PENDING", "EXPIRED", "WITHDRAWN"), "rejected").otherwise("not_sold")
    )


# Days at which listing contracts run out, and how near to one counts.
CONTRACT_DAYS, CONTRACT_SLACK, REJECTED_SCORE = (90, 180, 365), 3, -99


def research_score(dom: Column, duration: Column, gap: Column, entries: Column) -> Column:
    """Points for a sale; days on the market or between listing and removal near a contract's end reject at once."""
    ends = F.lit(False)
    for days in (dom, duration):
        for b in CONTRACT_DAYS:
            ends = ends | (F.abs(days - b) <= CONTRACT_SLACK)
    points = ((dom < 30, 3), (duration < 45, 2), (gap >= 7, 1), (entries == 1, 1), (dom > 150, -3), (gap == 0, -2), (duration < 7, -1), (entries >= 3, -1))
    return F.when(ends, REJECTED_SCORE).otherwise(sum((F.when(c, n).otherwise(0) for c, n in points), F.lit(0)))


def research_label(score: Column) -> Column:
    return F.when(score >= 3, "LIKELY_SOLD").when(score >= 1, "PROBABLY_SOLD").when(score >= -1, "AMBIGUOUS").when(score >= -3, "PROBABLY_EXPIRED").otherwise("LIKELY_EXPIRED_WITHDRAWN")
