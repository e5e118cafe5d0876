"""Lead scoring: decay, quality, heat, distress, propensity; Beta posteriors and channel weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreline.functions import geo
from acreline.functions.dates import fractional_days, years_ago
from acreline.functions.js import sigmoid
from acreline.operators import aggregates
from acreline.operators.joins import alias_join

# Fixed values of the scoring rules.
DECAY, SHIELD_YEARS, SHIELD_SCORE, UNDATED = 0.1155, 1.5, 0.02, 0.3
QUALITY = {"sfr": (0.50, 0.30, 0.20), "condo": (0.60, 0.40, 0.00), "multi": (0.40, 0.20, 0.40)}
HEAT_DECAY, HEAT_BOOST, HEAT_MILES, HEAT_DAYS = 0.005, 1.16, 0.10, 365
DISTRESS = (0.40, 0.35, 0.25)
WEIGHTS = {"ownership": 0.35, "pqi": 0.20, "heat": 0.25, "distress": 0.20}
PRIOR = (2.0, 18.0)
#: A feature's posterior mean against the global one moves the score by half the difference, by BOOST_MOST at most.
BOOST_SHARE, BOOST_MOST, GLOBAL_MEAN = 0.5, 0.05, 0.10
FEATURES = ("age_gt_10", "price_gt_300k", "single_family", "recent_sale", "high_value", "large_lot")
CLOSED = ("HARD_NO", "DO_NOT_KNOCK")
OUTCOME_WEIGHTS = {"SOLD": 1.0, "QUALIFIED": 0.6, "CALLBACK": 0.3, "NO_ANSWER": -0.1, "HARD_NO": -1.0}


def ownership(sold: Column, as_of: Column) -> Column:
    years = years_ago(as_of, sold)
    return F.when(sold.isNull(), UNDATED).when(years < SHIELD_YEARS, SHIELD_SCORE).otherwise(F.lit(1.0) - F.exp(years * -DECAY))


def kind_of(c: Column) -> Column:
    k = F.lower(F.coalesce(c, F.lit("")))
    return F.when(k.rlike("condo|town"), "condo").when(k.contains("multi"), "multi").otherwise("sfr")


def quality(props: DataFrame) -> DataFrame:
    """id, pqi: price (log), size and lot, each from its least to its 99 % value, weighted by kind.

    The bounds are one row, picked for all three at once from narrow bands around their positions, so no task sorts all values.
    """
    rows = props.withColumns({"lp": F.when(F.col("price") > 0, F.ln("price")), "one": F.lit(1)})
    low = rows.groupBy("one").agg(*[F.min(F.when(F.col(c) > 0, F.col(c))).alias(f"{c}_low") for c in ("lp", "sqft", "lot_size")])
    caps = aggregates.overall_picks(rows, {f"{c}_cap": (F.when(F.col(c) > 0, F.col(c)), 0.99) for c in ("lp", "sqft", "lot_size")})
    low = low.join(caps.withColumn("one", F.lit(1)), "one", "left")

    def scaled(c: str) -> Column:
        a, b, v = F.col(f"{c}_low"), F.col(f"{c}_cap"), F.col(c)
        inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.least(v, b) - a) / F.nullif(b - a, F.lit(0.0))))
        return F.when((v > 0) & (b > a), inside).otherwise(0.5)

    kind = kind_of(F.col("property_type"))
    weight = lambda i: F.when(kind == "condo", QUALITY["condo"][i]).when(kind == "multi", QUALITY["multi"][i]).otherwise(QUALITY["sfr"][i])
    pqi = sum((weight(i) * scaled(c) for i, c in enumerate(("lp", "sqft", "lot_size"))), F.lit(0.0))
    return rows.join(F.broadcast(low), "one").select(*props.columns, pqi.alias("pqi"))  # one row


def heat(props: DataFrame, as_of: Column) -> DataFrame:
    """props with heat: sales of a year in the own and neighbouring cells, fading by the day; one within 0.1 mile adds a boost.

    Sales are summed per cell and cells over their neighbours before a property meets them. A cell
    also tells in which of its sixteen parts something was sold, as places of one part are within
    0.1 mile. Only places in parts without a sale are held against single places of sales, on
    a grid not much wider than the 0.1 mile (up to 68 degrees of latitude).
    """
    row, col = geo.cell(F.col("lat"), F.col("lng"))
    age = fractional_days(as_of, F.col("sold_date"))
    sales = props.filter(F.col("sold_date").isNotNull()).withColumn("age", age).filter(f"age BETWEEN 0 AND {HEAT_DAYS}").select("lat", "lng", "age")
    quarter = lambda at, cell: F.greatest(F.lit(0), F.least(F.lit(3), F.floor((at - cell * geo.HEAT_CELL) / (geo.HEAT_CELL / 4)))).cast("int")
    part = quarter(F.col("lat"), row) * 4 + quarter(F.col("lng"), col)
    cells = sales.groupBy(row.alias("r"), col.alias("c")).agg(F.sum(F.exp(F.col("age") * -HEAT_DECAY)).alias("w"), F.bit_or(F.call_function("shiftleft", F.lit(1), part)).alias("parts"))
    spread = cells.select("w", "parts", F.col("r").alias("own_r"), F.col("c").alias("own_c"), F.inline(geo.ring(F.col("r"), F.col("c"))))
    own = F.when((F.col("r") == F.col("own_r")) & (F.col("c") == F.col("own_c")), F.col("parts")).otherwise(0)
    around = spread.groupBy("r", "c").agg(F.sum("w").alias("raw"), F.bit_or(own).alias("parts"))
    beside = F.coalesce(F.bit_get("parts", part), F.lit(0)) == 1
    fine = lambda: (F.floor(F.col("lat") / 0.0015).alias("r"), F.floor(F.col("lng") / 0.004).alias("c"))
    met = lambda rows: rows.withColumns({"r": row, "c": col}).join(around, ["r", "c"], "left").withColumn("beside", beside)
    # without any sale around there is none within 0.1 mile
    homes = met(props.select("lat", "lng")).filter("NOT beside AND raw IS NOT NULL").select("lat", "lng").distinct()
    homes = homes.select("lat", "lng", F.inline(geo.ring(*fine())))
    places = sales.select("lat", "lng").distinct().select(F.col("lat").alias("slat"), F.col("lng").alias("slng"), *fine())
    far = geo.haversine_miles(F.col("lat"), F.col("lng"), F.col("slat"), F.col("slng"))
    near = homes.join(places, ["r", "c"]).filter(far <= HEAT_MILES).select("lat", "lng").distinct().withColumn("near", F.lit(True))
    warm = F.lit(1.0) - F.exp(-F.col("raw"))
    joined = met(props).join(near, ["lat", "lng"], "left")
    value = F.coalesce(F.when(F.col("beside") | F.col("near"), F.least(F.lit(1.0), warm * HEAT_BOOST)).otherwise(warm), F.lit(0.0))
    return joined.select(*props.columns, value.alias("heat"))


def distress(props: DataFrame, as_of: Column) -> DataFrame:
    """props with distress: owner, age of the house, and distance of the price from its cell's upper median."""
    row, col = geo.cell(F.col("lat"), F.col("lng"))
    cells = props.withColumns({"r": row, "c": col})
    median = aggregates.index_pick(cells.filter("price > 0"), ["r", "c"], "price", 0.5)
    age = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.year(as_of) - F.col("year_built")) / 50.0)), F.lit(0.5))
    off = F.coalesce(F.least(F.lit(1.0), F.abs(F.col("price") - F.col("pick")) / F.nullif(F.col("pick"), F.lit(0.0))), F.lit(0.0))
    joined = cells.join(median, ["r", "c"], "left")
    return joined.select(*props.columns, (F.lit(DISTRESS[0]) * ownership(F.col("sold_date"), as_of) + F.lit(DISTRESS[1]) * age + F.lit(DISTRESS[2]) * off).alias("distress"))


def contact_penalty(logs: DataFrame) -> DataFrame:
    """pid, penalty by unanswered visits."""
    n = F.count_if(F.col("status") == "NO_ANSWER")
    return logs.groupBy("pid").agg(F.least(F.lit(0.5), F.lit(1.0) - F.exp(n * -0.3)).alias("penalty"))


def features(as_of: Column) -> dict[str, Column]:
    """The six features of a property; null where what they are told from is missing, empty or zero."""
    known = lambda c: F.nullif(F.col(c), F.lit(0))
    years = fractional_days(as_of, F.col("sold_date")) / 365
    return {
        "age_gt_10": F.year(as_of) - known("year_built") > 10, "price_gt_300k": known("price") > 300_000, "single_family": F.lower(F.nullif(F.col("property_type"), F.lit(""))).contains("single"),
        "recent_sale": years <= 3, "high_value": known("price") > 750_000, "large_lot": known("lot_size") > 10_890,
    }


def feature_posteriors(props: DataFrame, observations: DataFrame, as_of: Column) -> DataFrame:
    """One row: the posterior mean of each feature's properties (mean_<feature>) and of all (mean_all).

    observations (address_hash, w) meet properties by either hash; all seven means come from
    one aggregation.
    """
    some = props.select("address_hash", "legacy_hash", "price", "year_built", "property_type", "sold_date", "lot_size")
    seen = alias_join(observations, some)
    # a null feature counts for nothing
    chosen = {**features(as_of), "all": F.lit(True)}

    def mean(c: Column) -> Column:
        up, down = F.sum(F.when(c & (F.col("w") > 0), F.col("w")).otherwise(0.0)), F.sum(F.when(c & (F.col("w") < 0), -F.col("w")).otherwise(0.0))
        alpha, beta = F.coalesce(up, F.lit(0.0)) + PRIOR[0], F.coalesce(down, F.lit(0.0)) + PRIOR[1]
        return alpha / (alpha + beta)

    return seen.agg(*[mean(c).alias(f"mean_{name}") for name, c in chosen.items()])


def propensity(props: DataFrame, logs: DataFrame, as_of: Column, weights: dict[str, float] | None = None, learned: DataFrame | None = None) -> DataFrame:
    """id, propensity. The parts are columns of one flow of properties, which meets cells and logs but never itself.

    `learned` is the one row of feature_posteriors: each feature a property has adds its boost.
    Properties with an effective_status (if there is such a column) that closes them get 0.
    """
    w = weights or WEIGHTS
    status = ["effective_status"] if "effective_status" in props.columns else []
    some = props.select("id", "lat", "lng", "price", "sqft", "lot_size", "property_type", "year_built", "sold_date", *status)
    parts = distress(heat(quality(some), as_of), as_of).withColumns({"ownership": ownership(F.col("sold_date"), as_of), "pqi": F.when(F.col("pqi") == 0, 0.5).otherwise(F.col("pqi"))})
    raw = sum((F.col(c) * v for c, v in w.items()), F.lit(0.0))
    joined = parts.join(contact_penalty(logs), F.col("id") == F.col("pid"), "left")
    boost = F.lit(0.0)
    if learned is not None:
        joined = joined.join(F.broadcast(learned))  # one row
        for name, has in features(as_of).items():
            up = (F.col(f"mean_{name}") - F.coalesce("mean_all", F.lit(GLOBAL_MEAN))) * BOOST_SHARE
            boost = boost + F.when(has & F.col(f"mean_{name}").isNotNull(), F.greatest(F.lit(-BOOST_MOST), F.least(F.lit(BOOST_MOST), up))).otherwise(0.0)
    value = sigmoid(raw + boost - F.coalesce("penalty", F.lit(0.0)))
    closed = F.col("effective_status").isin(*CLOSED) if status else F.lit(False)
    return joined.select("id", F.when(closed, 0.0).otherwise(value).alias("propensity"))


def posteriors(observations: DataFrame, key: str) -> DataFrame:
    """Per key the Beta posterior of weighted outcomes: alpha, beta, mean, variance and the 95 % interval."""
    w = F.col("w")
    sums = observations.groupBy(key).agg((F.lit(PRIOR[0]) + F.sum(F.when(w > 0, w).otherwise(0.0))).alias("alpha"), (F.lit(PRIOR[1]) + F.sum(F.when(w < 0, -w).otherwise(0.0))).alias("beta"))
    a, b = F.col("alpha"), F.col("beta")
    out = sums.withColumns({"mean": a / (a + b), "variance": a * b / ((a + b) * (a + b) * (a + b + 1))})
    half = F.sqrt("variance") * 1.96
    return out.withColumns({"low": F.greatest(F.lit(0.0), F.col("mean") - half), "high": F.least(F.lit(1.0), F.col("mean") + half)})
