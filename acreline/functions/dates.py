"""Day arithmetic relative to an explicit as-of instant (session time zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(later: Column, earlier: Column) -> Column:
    """Rounded days: floor(milliseconds / 86,400,000 + 0.5)."""
    ms = F.unix_millis(later.cast("timestamp")) - F.unix_millis(earlier.cast("timestamp"))
    return F.floor(ms / 86_400_000 + 0.5).cast("long")


def fractional_days(later: Column, earlier: Column) -> Column:
    return (F.unix_millis(later.cast("timestamp")) - F.unix_millis(earlier.cast("timestamp"))) / F.lit(86_400_000.0)


def months_ago(later: Column, earlier: Column, days: float = 30.0) -> Column:
    return fractional_days(later, earlier) / F.lit(days)


def years_ago(later: Column, earlier: Column, days: float = 365.25) -> Column:
    return fractional_days(later, earlier) / F.lit(days)


def cooldown_left(as_of: Column, last: Column, days: int) -> Column:
    """Whole days until `days` have passed since `last`, 0 at least."""
    return F.greatest(F.lit(0), F.ceil(F.lit(days) - fractional_days(as_of, last))).cast("long")


def next_eligible(status: Column, at: Column) -> Column:
    """When a door may be knocked again after this result."""
    return (
        F.when(status == "NO_ANSWER", F.date_add(F.to_date(at), 14))
        .when(status == "CALLBACK", F.date_add(F.to_date(at), 1))
        .when(status == "NOT_MOVED_IN", F.date_add(F.to_date(at), 30))
        .when(status == "DM_NOT_HOME", F.date_add(F.to_date(at), 3))
        .when(status == "QUALIFIED", F.trunc(F.add_months(F.to_date(at), 1), "MM"))
    )


def weekday(c: Column) -> Column:
    """0 (Sunday) to 6."""
    return (F.dayofweek(c) - 1).cast("int")


# How good an hour is for knocking.
WEEKDAY_HOURS = {6: 5, 7: 10, 8: 15, 9: 20, 10: 25, 11: 30, 12: 35, 13: 35, 14: 40, 15: 50, 16: 60, 17: 85, 18: 95, 19: 90, 20: 70, 21: 30}
SATURDAY_HOURS = {8: 40, 9: 70, 10: 85, 11: 90, 12: 75, 13: 60, 14: 55, 15: 60, 16: 70, 17: 75, 18: 65, 19: 50, 20: 30}
SUNDAY_HOURS = {8: 5, 9: 10, 10: 15, 11: 20, 12: 30, 13: 40, 14: 55, 15: 60, 16: 65, 17: 60, 18: 50, 19: 40, 20: 25}


def knock_score(at: Column) -> Column:
    """Base score of the hour, 0 outside the tables."""

    def pick(table: dict[int, int]) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.hour(at)], F.lit(0))

    return F.when(weekday(at) == 0, pick(SUNDAY_HOURS)).when(weekday(at) == 6, pick(SATURDAY_HOURS)).otherwise(pick(WEEKDAY_HOURS))


def knock_label(score: Column) -> Column:
    return F.when(score >= 85, "PRIME TIME").when(score >= 60, "GOOD").when(score >= 20, "LOW").otherwise("AVOID")


def time_score(at: Column, sold: Column, price: Column, as_of: Column) -> Column:
    """The hour's score, more for recent sales and for costly homes at mid-day, 100 at most."""
    age = F.floor(fractional_days(as_of, sold))
    recent = F.when(age < 30, 20).when(age < 90, 10).otherwise(0)
    midday = F.when((price > 500_000) & F.hour(at).between(10, 14), 10).otherwise(0)
    return F.least(F.lit(100), knock_score(at) + F.coalesce(recent, F.lit(0)) + midday)
