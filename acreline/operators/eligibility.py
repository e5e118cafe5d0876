"""Eligibility of doors for an industry, and appointments with the best of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreline.functions.dates import fractional_days

# Fixed values of the scoring rules: weights of age, value, size, lot, talks and recency by industry.
INDUSTRIES = {
    "solar": (0.15, 0.20, 0.10, 0.20, 0.20, 0.15),
    "roofing": (0.30, 0.15, 0.10, 0.10, 0.20, 0.15),
    "hvac": (0.30, 0.15, 0.15, 0.05, 0.20, 0.15),
    "windows": (0.35, 0.15, 0.10, 0.05, 0.20, 0.15),
    "pest_control": (0.10, 0.10, 0.10, 0.30, 0.25, 0.15),
    "landscaping": (0.05, 0.20, 0.05, 0.35, 0.20, 0.15),
    "security": (0.10, 0.25, 0.15, 0.10, 0.20, 0.20),
    "insurance": (0.15, 0.30, 0.15, 0.05, 0.20, 0.15),
    "telecom": (0.05, 0.10, 0.10, 0.05, 0.30, 0.40),
    "other": (0.15, 0.15, 0.10, 0.10, 0.25, 0.25),
}
#: What a hundred points of age, value, size and lot are; points by talks; points by months since the sale.
FULL = (50, 500_000, 3_000, 20_000)
TALKS = (("hard", 0), ("good", 95), ("back", 85), ("missed", 40))
RECENT = ((6, 95), (12, 80), (24, 60), (60, 40))
OPENS, CLOSES = 9, 18


def factors(rows: DataFrame, logs: DataFrame, as_of: Column) -> DataFrame:
    """rows with six factors of 0 to 100 (f0 .. f5) and `hard`, whether a visit ended in a hard no."""
    is_ = lambda *s: F.bool_or(F.col("status").isin(*s))
    talks = logs.groupBy(F.col("pid").alias("__pid")).agg(is_("HARD_NO").alias("hard"), is_("SOLD", "QUALIFIED").alias("good"), is_("CALLBACK").alias("back"), is_("NO_ANSWER").alias("missed"))
    joined = rows.join(talks, F.col("id") == F.col("__pid"), "left")
    amounts = (F.coalesce(F.year(as_of) - F.nullif(F.col("year_built"), F.lit(0)), F.lit(20)), *[F.coalesce(c, F.lit(0)) for c in ("price", "sqft", "lot_size")])
    shares = [F.least(F.lit(100.0), c / F.lit(float(full)) * 100) for c, full in zip(amounts, FULL, strict=True)]
    talked = F.lit(30)
    for name, points in reversed(TALKS):
        talked = F.when(F.col(name), points).otherwise(talked)
    months = fractional_days(as_of, F.col("sold_date")) / 30
    recent = F.lit(20)
    for most, points in reversed(RECENT):
        recent = F.when(months <= most, points).otherwise(recent)
    points = [*shares, F.when(F.col("__pid").isNull(), 20).otherwise(talked), F.when(F.col("sold_date").isNull(), 30).otherwise(recent)]
    return joined.select(*rows.columns, F.coalesce("hard", F.lit(False)).alias("hard"), *[c.cast("double").alias(f"f{i}") for i, c in enumerate(points)])


def scores(rows: DataFrame, logs: DataFrame, as_of: Column, industries: dict[str, tuple[float, ...]]) -> DataFrame:
    """rows with industry and score, 0 to 100, a row for each industry."""
    def score(weights: tuple[float, ...]) -> Column:
        total = sum((F.col(f"f{i}") * w for i, w in enumerate(weights)), F.lit(0.0))
        return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(total + 0.5).cast("int")))

    each = F.inline(F.array(*[F.struct(F.lit(n).alias("industry"), score(w).alias("score")) for n, w in industries.items()]))
    return factors(rows, logs, as_of).select(*rows.columns, "hard", each)


def schedule(rows: DataFrame, logs: DataFrame, reps: DataFrame, as_of: Column, industry: str, least: int, most: int, days: int, slots_a_day: int) -> DataFrame:
    """id, score, scheduled, rep of the best `most` doors of at least so many points, dealt over the slots of the next days but Sundays and over the reps.

    Doors and reps beyond `most` don't matter, so no more of either are numbered.
    """
    weights = {industry: INDUSTRIES.get(industry, INDUSTRIES["other"])}
    able = scores(rows, logs, as_of, weights).filter(~F.col("hard") & (F.coalesce("status", F.lit("")) != "DO_NOT_KNOCK") & (F.col("score") >= least))
    nth = lambda *c: (F.row_number().over(Window.orderBy(*c)) - 1).cast("long")
    best = able.select("id", "score").orderBy(F.desc("score"), "id").limit(most).withColumn("i", nth(F.desc("score"), "id"))
    step = (CLOSES - OPENS) // slots_a_day
    whole_days = F.filter(F.transform(F.sequence(F.lit(1), F.lit(days)), lambda d: F.date_add(F.to_date(as_of), d)), lambda d: F.dayofweek(d) != 1)
    hours = F.array(*[F.lit(OPENS + s * step) for s in range(slots_a_day)])
    slots = F.flatten(F.transform(whole_days, lambda d: F.transform(hours, lambda h: F.timestamp_add("HOUR", h, d.cast("timestamp")))))
    key = reps.columns[0]
    some = reps.orderBy(key).limit(most).withColumn("k", nth(key))
    n = reps.agg(F.count("*").alias("n"))
    placed = best.join(F.broadcast(n)).withColumns({"slots": slots, "k": F.col("i") % F.col("n")})  # one row
    return placed.join(some, "k", "left").select("id", "score", F.get("slots", (F.col("i") % F.size("slots")).cast("int")).alias("scheduled"), F.col(key).alias("rep"))
