"""Row predicates of candidate selection and route building."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreline.functions import geo

# States that don't publish sale prices, kinds of property that aren't homes.
NON_DISCLOSURE = ("AK", "ID", "KS", "LA", "MS", "MO", "MT", "NM", "ND", "TX", "UT", "WY")
BAD_TYPES = ("Commercial", "Industrial", "Vacant Land", "Agricultural")
TERMINAL = ("HARD_NO", "SOLD", "DO_NOT_KNOCK")


def candidates(
    props: DataFrame, owner: int | None = None, zips: Sequence[str] = (), since: str | None = None, box: tuple[float, float, float, float] | None = None
) -> DataFrame:
    """Active, placed, unrejected rows; each given parameter adds a predicate that reaches the scan. Undated rows pass `since`."""
    out = props.filter("route_active AND lat IS NOT NULL AND lng IS NOT NULL AND coalesce(status, '') <> 'REJECTED' AND coalesce(confidence, '') <> 'REJECTED'")
    if owner is not None:
        out = out.filter(F.col("owner_id") == owner)
    if zips:
        out = out.filter(F.col("zip_code").isin(*zips))
    if since:
        out = out.filter(F.col("sold_date").isNull() | (F.col("sold_date") >= F.lit(since).cast("timestamp")))
    if box:
        out = out.filter(geo.in_bounds(F.col("lat"), F.col("lng"), box))
    return out


def valid_sale(price: Column, assessed: Column, state: Column, kind: Column, sold: Column, least: float = 30_000, ratio: float = 0.25) -> Column:
    """Whether a deed is an arm's-length sale of a home; a price of NULL isn't held against it."""
    hidden = F.coalesce(F.upper(state).isin(*NON_DISCLOSURE), F.lit(False))
    cheap = F.coalesce(price < least, F.lit(False)) | F.coalesce((assessed > 0) & (price < assessed * ratio), F.lit(False)) | F.coalesce(assessed < 25_000, F.lit(False))
    token = F.coalesce((price > 0) & (price < 1_000), F.lit(False))
    bad = F.coalesce(kind.isin(*BAD_TYPES), F.lit(False))
    return sold.isNotNull() & ~F.when(hidden, token).otherwise(cheap) & ~bad


def rejection_reason(price: Column, assessed: Column, kind: Column, sold: Column) -> Column:
    """The first older rule a row breaks, NULL if none."""
    return (
        F.when(sold.isNull(), "no_sale_date").when(price < 10_000, "price_too_low").when((assessed > 0) & (price < assessed * 0.15), "below_assessed").when(kind.isin(*BAD_TYPES), "bad_type")
    )


#: Stages of route filtering, in order: name and predicate over a property row.
def stages(as_of: Column, months: int = 12) -> list[tuple[str, Column]]:
    kind = F.lower(F.col("property_type"))
    passes = lambda c: F.coalesce(c, F.lit(True))
    return [
        ("territory", F.col("zip_code") < "29630"),
        ("sold_date", passes(F.col("sold_date") >= F.add_months(as_of, -months)) & F.col("sold_date").isNotNull() | (F.col("status") == "MLS_PENDING")),
        ("commercial", passes(~kind.rlike("commercial|land"))),
        ("condo", passes(~kind.rlike("condo|town"))),
        ("rejected", (F.col("status") != "REJECTED") & (F.col("confidence") != "REJECTED")),
        ("inactive", F.col("route_active").eqNullSafe(True)),
        ("stale_mls", ~((F.col("sale_type") == "MLS") & F.coalesce(F.col("sold_date") < F.date_sub(as_of, 30), F.lit(True)))),
        ("confidence", F.col("confidence") != "low"),
        ("price", passes(F.col("price").between(50_000, 450_000))),
    ]


def funnel(rows: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(stage, name, n, dropped): rows left after each stage, counted in one pass."""
    so_far, marks = F.lit(True), []
    for name, predicate in steps:
        so_far = so_far & F.coalesce(predicate, F.lit(False))
        marks.append(F.sum(so_far.cast("long")).alias(name))
    one = rows.agg(F.count("*").alias("all_rows"), *marks)
    names = ["all_rows", *[n for n, _ in steps]]
    pairs = F.array(*[F.struct(F.lit(i).alias("stage"), F.lit(n).alias("name"), F.coalesce(F.col(n), F.lit(0)).alias("n"), F.coalesce(F.col(names[max(0, i - 1)]) - F.col(n), F.lit(0)).alias("dropped")) for i, n in enumerate(names)])
    return one.select(F.inline(pairs))
