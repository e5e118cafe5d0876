"""Queries of the E family: aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.functions import geo
from acreline.functions.js import percent, round_half_up
from acreline.operators import aggregates, filters, joins
from acreline.operators.aggregates import is_
from acreline.plans.base import AS_OF, AS_OF_PROPS, Tables
from acreline.plans.catalog import query

WHEN = {n: f"TIMESTAMP '{AS_OF}' - INTERVAL {n} DAY" for n in (1, 7, 14, 30)}
SINCE = {n: f"ts >= timestamp'{AS_OF}' - INTERVAL {n} DAYS" for n in (1, 7, 14, 30)}


def pct(a: str, b: str, d: int = 0) -> str:
    inner = f"CASE WHEN coalesce({b}, 0) = 0 THEN 0e0 ELSE {a} * 100e0 / {b} END"
    return f"floor({inner} * {10**d}e0 + 0.5e0) / {10**d}e0" if d else f"CAST(floor({inner} + 0.5e0) AS BIGINT)"


@query("e01_workspace_counts", "SELECT owner_id, count(*) AS n, count(*) FILTER (route_active) AS active, count(DISTINCT zip_code) AS zips FROM props GROUP BY owner_id")
def e01(t: Tables) -> DataFrame:
    return t.props.groupBy("owner_id").agg(F.count("*").alias("n"), F.count_if("route_active").alias("active"), F.countDistinct("zip_code").alias("zips"))


@query("e02_stored_breakdown", """SELECT count(*) AS total, count(*) FILTER (status = 'SOLD') AS sold, count(*) FILTER (status = 'HEURISTIC_SOLD') AS heuristic,
  count(*) FILTER (confidence = 'verified') AS verified, count(*) FILTER (sale_type = 'MLS') AS mls FROM props""")
def e02(t: Tables) -> DataFrame:
    n = lambda p, a: F.count_if(F.expr(p)).alias(a)
    return t.props.agg(F.count("*").alias("total"), n("status = 'SOLD'", "sold"), n("status = 'HEURISTIC_SOLD'", "heuristic"), n("confidence = 'verified'", "verified"), n("sale_type = 'MLS'", "mls"))


@query("e03_freshness", "SELECT zip_code, count(*) AS n, max(sold_date) AS newest FROM props WHERE owner_id = 7 GROUP BY zip_code")
def e03(t: Tables) -> DataFrame:
    return t.props.filter("owner_id = 7").groupBy("zip_code").agg(F.count("*").alias("n"), F.max("sold_date").alias("newest"))


@query("e04_top_zips", "SELECT zip_code, count(*) AS n FROM props GROUP BY zip_code ORDER BY n DESC, zip_code LIMIT 10")
def e04(t: Tables) -> DataFrame:
    return aggregates.top(t.props, "zip_code", 10)


@query("e05_null_coverage", "SELECT count(sold_date) AS dated, count(assessed) AS assessed, count(property_type) AS typed, count(*) FILTER (price IS NULL) AS unpriced FROM props")
def e05(t: Tables) -> DataFrame:
    return t.props.agg(F.count("sold_date").alias("dated"), F.count("assessed").alias("assessed"), F.count("property_type").alias("typed"), F.count_if(F.col("price").isNull()).alias("unpriced"))


@query("e06_zips_in_box", "SELECT DISTINCT zip_code FROM props WHERE lat BETWEEN 34.55 AND 34.56 AND lng BETWEEN -82.6 AND -82.59 ORDER BY 1 LIMIT 100")
def e06(t: Tables) -> DataFrame:
    return t.props.filter(geo.in_bounds(F.col("lat"), F.col("lng"), (34.55, 34.56, -82.6, -82.59))).select("zip_code").distinct().orderBy("zip_code").limit(100)


@query("e08_latency", "SELECT round(avg(value), 4) AS mean, (SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM logs) x WHERE r = least(n - 1, floor(n * 0.95)) + 1) AS p95 FROM logs")
def e08(t: Tables) -> DataFrame:
    one = t.logs.withColumn("one", F.lit(1))
    return one.groupBy("one").agg(F.round(F.avg("value"), 4).alias("mean")).join(aggregates.overall_pick(one, "value", 0.95), F.lit(True)).select("mean", F.col("pick").alias("p95"))


@query("e09_price_summary", """SELECT state, count(*) AS n, min(price) AS low, max(price) AS high, round(avg(price), 2) AS mean, max(price) FILTER (r = floor(m / 2) + 1) AS median
FROM (SELECT state, price, row_number() OVER (PARTITION BY state ORDER BY price) AS r, count(*) OVER (PARTITION BY state) AS m FROM props) x GROUP BY state""")
def e09(t: Tables) -> DataFrame:
    per = t.props.groupBy("state").agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"), F.round(F.avg("price"), 2).alias("mean"))
    return per.join(aggregates.index_pick(t.props, ["state"], "price", 0.5), "state").select("state", "n", "low", "high", "mean", F.col("pick").alias("median"))


@query("e10_days_on_market", f"""SELECT count(dom) AS populated, min(dom) AS low, max(dom) AS high, CAST(floor(avg(dom) + 0.5) AS BIGINT) AS mean, count(*) FILTER (dom < 30) AS under30, count(*) FILTER (dom > 30) AS over30,
  {pct('count(*) FILTER (dom < 30)', 'count(dom)', 1)} AS share FROM listings""")
def e10(t: Tables) -> DataFrame:
    under = F.count_if(F.col("dom") < 30)
    return t.listings.agg(
        F.count("dom").alias("populated"), F.min("dom").alias("low"), F.max("dom").alias("high"), round_half_up(F.avg("dom")).alias("mean"), under.alias("under30"),
        F.count_if(F.col("dom") > 30).alias("over30"), percent(under, F.count("dom"), 1).alias("share"),
    )


CELL = "CAST(floor(lat / 0.004e0) AS BIGINT) AS r, CAST(floor(lng / 0.004e0) AS BIGINT) AS c"


@query("e11_cell_median", f"SELECT r, c, max(price) FILTER (k = floor(m / 2) + 1) AS median FROM (SELECT r, c, price, row_number() OVER (PARTITION BY r, c ORDER BY price) AS k, count(*) OVER (PARTITION BY r, c) AS m FROM (SELECT {CELL}, price FROM props) y) x GROUP BY r, c")
def e11(t: Tables) -> DataFrame:
    row, col = geo.cell(F.col("lat"), F.col("lng"))
    return aggregates.index_pick(t.props.select(row.alias("r"), col.alias("c"), "price"), ["r", "c"], "price", 0.5).withColumnRenamed("pick", "median")


@query("e12_neighbourhood", f"""WITH rings(a, b) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1), (1, 1), (-1, -1))
SELECT r + a AS r, c + b AS c, count(*) AS n FROM (SELECT {CELL} FROM props WHERE status = 'SOLD') s, rings GROUP BY 1, 2""")
def e12(t: Tables) -> DataFrame:
    row, col = geo.cell(F.col("lat"), F.col("lng"))
    per = t.props.filter(is_("SOLD")).groupBy(row.alias("r"), col.alias("c")).agg(F.count("*").alias("n"))
    return per.select("n", F.inline(geo.ring(F.col("r"), F.col("c")))).groupBy("r", "c").agg(F.sum("n").alias("n"))


@query("e13_route_density", f"""SELECT route_id, round(1 + least(0.2e0, max(n) / 10e0 * 0.2e0), 6) AS multiplier FROM (SELECT route_id, r, c, count(*) AS n FROM (SELECT s.route_id, {CELL} FROM stops s JOIN props p ON s.pid = p.id) y GROUP BY 1, 2, 3) x GROUP BY route_id""")
def e13(t: Tables) -> DataFrame:
    row, col = geo.cell(F.col("lat"), F.col("lng"))
    per = t.stops.join(t.props, F.col("pid") == F.col("id")).groupBy("route_id", row.alias("r"), col.alias("c")).agg(F.count("*").alias("n"))
    return per.groupBy("route_id").agg(F.round(F.least(F.lit(0.2), F.max("n") / 10.0 * 0.2) + 1, 6).alias("multiplier"))


@query("e14_heat_grid", f"SELECT r, c, count(*) AS n, round(sum(sqft), 3) AS total, round(avg(sqft), 3) AS mean, least(1e0, count(*) / 10e0) AS intensity, round((r + 0.5e0) * 0.004e0, 6) AS lat, round((c + 0.5e0) * 0.004e0, 6) AS lng FROM (SELECT {CELL}, sqft FROM props) x GROUP BY r, c")
def e14(t: Tables) -> DataFrame:
    row, col = geo.cell(F.col("lat"), F.col("lng"))
    per = t.props.groupBy(row.alias("r"), col.alias("c")).agg(F.count("*").alias("n"), F.round(F.sum("sqft"), 3).alias("total"), F.round(F.avg("sqft"), 3).alias("mean"))
    return per.withColumns({"intensity": F.least(F.lit(1.0), F.col("n") / 10.0), "lat": F.round((F.col("r") + 0.5) * 0.004, 6), "lng": F.round((F.col("c") + 0.5) * 0.004, 6)})


@query("e15_state_clusters", "SELECT coalesce(state, 'Unknown') AS state, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng, round(avg(price), 2) AS score FROM props GROUP BY 1")
def e15(t: Tables) -> DataFrame:
    return t.props.groupBy(F.coalesce("state", F.lit("Unknown")).alias("state")).agg(F.count("*").alias("n"), *[F.round(F.avg(c), d).alias(a) for c, d, a in (("lat", 6, "lat"), ("lng", 6, "lng"), ("price", 2, "score"))])


@query("e16_centroid", "SELECT s.route_id, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM stops s JOIN props p ON s.pid = p.id GROUP BY s.route_id")
def e16(t: Tables) -> DataFrame:
    return t.stops.join(t.props, F.col("pid") == F.col("id")).groupBy("route_id").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lng"), 6).alias("lng"))


@query("e17_kpi_cards", f"""SELECT count(*) AS total, count(*) FILTER (status IN ('SOLD', 'HARD_NO')) AS completed, count(*) FILTER (status = 'SOLD') AS sold, count(*) FILTER (status = 'NO_ANSWER') AS no_show,
  {pct("count(*) FILTER (status = 'SOLD')", "count(*) FILTER (status IN ('SOLD', 'HARD_NO'))")} AS conversion, {pct("count(*) FILTER (status = 'NO_ANSWER')", 'count(*)')} AS no_show_rate, round(avg(value), 4) AS score, count(DISTINCT rep) AS reps FROM logs""")
def e17(t: Tables) -> DataFrame:
    done, sold, missed = F.count_if(F.col("status").isin("SOLD", "HARD_NO")), F.count_if(is_("SOLD")), F.count_if(is_("NO_ANSWER"))
    return t.logs.agg(
        F.count("*").alias("total"), done.alias("completed"), sold.alias("sold"), missed.alias("no_show"), percent(sold, done).alias("conversion"),
        percent(missed, F.count("*")).alias("no_show_rate"), F.round(F.avg("value"), 4).alias("score"), F.countDistinct("rep").alias("reps"),
    )


@query("e18_industry_conversion", f"""SELECT industry, count(*) AS total, count(*) FILTER (status = 'SOLD') AS sold, count(*) FILTER (status = 'CALLBACK') AS follow_up, count(*) FILTER (status = 'HARD_NO') AS refused,
  {pct("count(*) FILTER (status = 'SOLD')", 'count(*)')} AS rate FROM logs JOIN members ON rep = member_id GROUP BY industry""")
def e18(t: Tables) -> DataFrame:
    sold = F.count_if(is_("SOLD"))
    per = t.logs.join(t.members, F.col("rep") == F.col("member_id")).groupBy("industry")
    return per.agg(F.count("*").alias("total"), sold.alias("sold"), F.count_if(is_("CALLBACK")).alias("follow_up"), F.count_if(is_("HARD_NO")).alias("refused"), percent(sold, F.count("*")).alias("rate")).orderBy(F.desc("total"))


@query("e19_rep_success", ", ".join(["SELECT rep, count(*) AS total"] + [f"""{pct(f"count(*) FILTER (status = '{s}')", 'count(*)', 1)} AS {a}""" for s, a in (("SOLD", "sold"), ("QUALIFIED", "qualified"), ("NO_ANSWER", "no_show"), ("HARD_NO", "refused"))]) + " FROM logs GROUP BY rep")
def e19(t: Tables) -> DataFrame:
    rates = [percent(F.count_if(is_(s)), F.count("*"), 1).alias(a) for s, a in (("SOLD", "sold"), ("QUALIFIED", "qualified"), ("NO_ANSWER", "no_show"), ("HARD_NO", "refused"))]
    return t.logs.groupBy("rep").agg(F.count("*").alias("total"), *rates)


@query("e20_route_efficiency", """SELECT s.route_id, least(100e0, count(l.event_id) * 100e0 / count(DISTINCT s.pos)) AS efficiency FROM stops s LEFT JOIN logs l ON s.address_hash = l.address_hash WHERE s.route_id < 12 GROUP BY s.route_id""")
def e20(t: Tables) -> DataFrame:
    hits = t.logs.groupBy("address_hash").agg(F.count("*").alias("n"))
    per = t.stops.filter("route_id < 12").join(hits, "address_hash", "left").groupBy("route_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.count("*").alias("houses"))
    return per.select("route_id", F.least(F.lit(100.0), F.col("n") * 100.0 / F.col("houses")).alias("efficiency"))


@query("e21_score_buckets", f"""WITH spine(bucket, low, high) AS (VALUES ('0-20', 0, 20), ('21-40', 21, 40), ('41-60', 41, 60), ('61-80', 61, 80), ('81-100', 81, 100))
SELECT bucket, count(event_id) AS total, {pct("count(*) FILTER (status = 'SOLD')", 'count(event_id)')} AS conversion FROM spine LEFT JOIN logs ON value BETWEEN low AND high GROUP BY bucket""")
def e21(t: Tables) -> DataFrame:
    bands = [(0, 20), (21, 40), (41, 60), (61, 80), (81, 100)]
    bucket = F.coalesce(*[F.when(F.col("value").between(a, b), f"{a}-{b}") for a, b in bands])
    spine = t.spark.createDataFrame([(f"{a}-{b}",) for a, b in bands], "bucket string")
    per = t.logs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(is_("SOLD")).alias("sold"))
    return spine.join(per, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("total"), percent(F.coalesce("sold", F.lit(0)), F.col("n")).alias("conversion"))


@query("e22_appointments", "SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS upcoming, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-15') AS today, count(*) FILTER (status = 'SOLD') AS completed, count(*) FILTER (status = 'HARD_NO') AS cancelled FROM logs")
def e22(t: Tables) -> DataFrame:
    return t.logs.agg(F.count_if(F.expr("ts >= timestamp'2024-01-15'")).alias("upcoming"), F.count_if(F.to_date("ts") == "2024-01-15").alias("today"), F.count_if(is_("SOLD")).alias("completed"), F.count_if(is_("HARD_NO")).alias("cancelled"))


@query("e23_outcomes", "SELECT status, count(*) AS n FROM logs GROUP BY status")
def e23(t: Tables) -> DataFrame:
    return t.logs.groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


LEADERBOARD = f"""SELECT m.member_id, m.name, coalesce(knocks, 0) AS knocks, coalesce(sales, 0) AS sales, coalesce(active_hours, 0) AS active_hours, {pct('coalesce(sales, 0)', 'knocks', 1)} AS conversion,
  coalesce(floor(knocks / greatest(active_hours, 1) * 10 + 0.5) / 10, 0) AS doors_per_hour FROM members m LEFT JOIN (SELECT rep, count(*) AS knocks, count(*) FILTER (status = 'SOLD') AS sales, count(DISTINCT date_trunc('hour', ts)) AS active_hours FROM logs GROUP BY rep) x ON m.member_id = x.rep"""


@query("e24_leaderboard", LEADERBOARD)
def e24(t: Tables) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = t.members.join(aggregates.board(t.logs, ["rep"]), F.col("member_id") == F.col("rep"), "left")
    return joined.select("member_id", "name", *map(zero, ("knocks", "sales", "active_hours")), F.coalesce("conversion", F.lit(0.0)).alias("conversion"), F.coalesce("doors_per_hour", F.lit(0.0)).alias("doors_per_hour")).orderBy(F.desc("sales"), F.desc("knocks"), "member_id")


@query("e25_zip_penetration", f"SELECT zip_code, count(DISTINCT l.pid) AS touched, count(DISTINCT p.id) AS doors, {pct('count(DISTINCT l.pid)', 'count(DISTINCT p.id)', 1)} AS penetration FROM props p LEFT JOIN logs l ON l.pid = p.id GROUP BY zip_code ORDER BY penetration DESC, zip_code LIMIT 5")
def e25(t: Tables) -> DataFrame:
    touched = t.logs.select("pid").distinct()
    per = t.props.join(touched, F.col("id") == F.col("pid"), "left").groupBy("zip_code").agg(F.count("pid").alias("touched"), F.count("*").alias("doors"))
    return per.withColumn("penetration", percent(F.col("touched"), F.col("doors"), 1)).orderBy(F.desc("penetration"), "zip_code").limit(5)


@query("e26_team_totals", "SELECT CAST(sum(knocks) AS BIGINT) AS knocks, CAST(sum(sales) AS BIGINT) AS sales, round(avg(knocks), 4) AS mean_knocks, count(*) AS reps FROM (SELECT rep, count(*)::BIGINT AS knocks, (count(*) FILTER (status = 'SOLD'))::BIGINT AS sales FROM logs GROUP BY rep) x")
def e26(t: Tables) -> DataFrame:
    per = aggregates.board(t.logs, ["rep"])
    return per.agg(F.sum("knocks").alias("knocks"), F.sum("sales").alias("sales"), F.round(F.avg("knocks"), 4).alias("mean_knocks"), F.count("*").alias("reps"))


@query("e27_status_confidence", "SELECT status, confidence, count(*) AS n FROM props GROUP BY 1, 2")
def e27(t: Tables) -> DataFrame:
    return t.props.groupBy("status", "confidence").agg(F.count("*").alias("n"))


@query("e28_overview", f"""SELECT this_week, last_week, {pct('(this_week - last_week)', 'last_week')} AS change, round(knocks / greatest(sales, 1), 4) AS knocks_per_sale FROM (
  SELECT count(*) FILTER (ts >= {WHEN[7]}) AS this_week, count(*) FILTER (ts >= {WHEN[14]} AND ts < {WHEN[7]}) AS last_week, count(*) AS knocks, count(*) FILTER (status = 'SOLD') AS sales FROM logs) x""")
def e28(t: Tables) -> DataFrame:
    one = t.logs.agg(F.count_if(F.expr(SINCE[7])).alias("this_week"), F.count_if(F.expr(f"{SINCE[14]} AND NOT {SINCE[7]}")).alias("last_week"), F.count("*").alias("knocks"), F.count_if(is_("SOLD")).alias("sales"))
    change = percent(F.col("this_week") - F.col("last_week"), F.col("last_week"))
    return one.select("this_week", "last_week", change.alias("change"), F.round(F.col("knocks") / F.greatest(F.col("sales"), F.lit(1)), 4).alias("knocks_per_sale"))


@query("e29_team_performance", f"SELECT rep, count(*) AS total, count(*) FILTER (ts >= {WHEN[7]}) AS weekly, count(*) FILTER (ts >= {WHEN[7]} AND status = 'SOLD') AS weekly_sales, count(*) FILTER (ts >= {WHEN[1]}) AS today, count(DISTINCT route_id) AS routes FROM logs GROUP BY rep")
def e29(t: Tables) -> DataFrame:
    n = lambda p, a: F.count_if(F.expr(p)).alias(a)
    return t.logs.groupBy("rep").agg(F.count("*").alias("total"), n(SINCE[7], "weekly"), n(f"{SINCE[7]} AND status = 'SOLD'", "weekly_sales"), n(SINCE[1], "today"), F.countDistinct("route_id").alias("routes"))


@query("e30_week_summary", f"""SELECT {pct("count(*) FILTER (status <> 'NO_ANSWER')", 'count(*)')} AS contact_rate, {pct("count(*) FILTER (status = 'SOLD')", 'count(*)')} AS conversion, count(*) FILTER (status = 'CALLBACK') AS callbacks, count(DISTINCT rep) AS reps,
  (SELECT round(sum(value), 2) FROM logs WHERE status = 'SOLD') AS revenue FROM logs WHERE ts >= {WHEN[7]}""")
def e30(t: Tables) -> DataFrame:
    week = F.expr(SINCE[7])
    n = F.count_if(week)
    return t.logs.agg(
        percent(F.count_if(week & ~is_("NO_ANSWER")), n).alias("contact_rate"), percent(F.count_if(week & is_("SOLD")), n).alias("conversion"), F.count_if(week & is_("CALLBACK")).alias("callbacks"),
        F.countDistinct(F.when(week, F.col("rep"))).alias("reps"), F.round(F.sum(F.when(is_("SOLD"), F.col("value"))), 2).alias("revenue"),
    )


@query("e31_revenue_weeks", f"SELECT w.week, coalesce(round(sum(value), 2), 0) AS revenue, count(value) AS deals FROM (SELECT unnest(range(12)) AS week) w LEFT JOIN (SELECT date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') // 7 AS week, value FROM logs WHERE status = 'SOLD') l USING (week) GROUP BY w.week")
def e31(t: Tables) -> DataFrame:
    per = t.logs.filter(is_("SOLD")).groupBy(F.expr("datediff(date'2024-01-31', to_date(ts)) div 7").alias("week")).agg(F.round(F.sum("value"), 2).alias("revenue"), F.count("value").alias("deals"))
    return t.spark.range(12).withColumnRenamed("id", "week").join(per, "week", "left").select("week", F.coalesce("revenue", F.lit(0.0)).alias("revenue"), F.coalesce("deals", F.lit(0)).alias("deals"))


@query("e32_rep_hours", "SELECT h.hour, count(event_id) AS n, count(*) FILTER (status = 'SOLD') AS sold FROM (SELECT unnest(range(8, 21)) AS hour) h LEFT JOIN logs l ON hour(ts) = h.hour AND rep = 8 GROUP BY h.hour")
def e32(t: Tables) -> DataFrame:
    per = t.logs.filter("rep = 8").groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"), F.count_if(is_("SOLD")).alias("sold"))
    return t.spark.range(8, 21).withColumnRenamed("id", "hour").join(per, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sold", F.lit(0)).alias("sold"))


@query("e33_rep_summary", "SELECT rep, count(DISTINCT CAST(ts AS DATE)) AS active_days, count(DISTINCT address_hash) AS doors, count(*) - count(DISTINCT address_hash) AS repeats, round(count(*) / count(DISTINCT CAST(ts AS DATE)), 4) AS per_day FROM logs GROUP BY rep")
def e33(t: Tables) -> DataFrame:
    days, doors = F.countDistinct(F.to_date("ts")), F.countDistinct("address_hash")
    return t.logs.groupBy("rep").agg(days.alias("active_days"), doors.alias("doors"), (F.count("*") - doors).alias("repeats"), F.round(F.count("*") / days, 4).alias("per_day"))


@query("e34_best_hour", """SELECT rep, hour FROM (SELECT rep, hour, row_number() OVER (PARTITION BY rep ORDER BY contact DESC, n DESC, hour) AS r FROM (SELECT rep, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, count(*) FILTER (status <> 'NO_ANSWER') / count(*) AS contact FROM logs GROUP BY 1, 2) x) y WHERE r = 1""")
def e34(t: Tables) -> DataFrame:
    per = t.logs.groupBy("rep", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), (F.count_if(~is_("NO_ANSWER")) / F.count("*")).alias("contact"))
    return per.groupBy("rep").agg(F.max_by("hour", F.struct("contact", "n", -F.col("hour"))).alias("hour"))


@query("e35_route_performance", f"""SELECT route_id, count(*) AS knocks, count(*) FILTER (status = 'SOLD') AS sales, {pct("count(*) FILTER (status = 'SOLD')", 'count(*)', 1)} AS conversion, {pct("count(*) FILTER (status = 'CALLBACK')", 'count(*)', 1)} AS callback_rate,
  {pct('count(DISTINCT pid)', '1500', 1)} AS completion FROM logs GROUP BY route_id""")
def e35(t: Tables) -> DataFrame:
    n = F.count("*")
    return t.logs.groupBy("route_id").agg(n.alias("knocks"), F.count_if(is_("SOLD")).alias("sales"), percent(F.count_if(is_("SOLD")), n, 1).alias("conversion"), percent(F.count_if(is_("CALLBACK")), n, 1).alias("callback_rate"), percent(F.countDistinct("pid"), F.lit(1500), 1).alias("completion"))


@query("e36_auto_assign", f"SELECT auto_assign, count(*) AS reps, round(avg(coalesce(knocks, 0)), 4) AS knocks, round(avg(coalesce(sales, 0)), 4) AS sales FROM ({LEADERBOARD}) b JOIN members USING (member_id) GROUP BY auto_assign")
def e36(t: Tables) -> DataFrame:
    per = t.members.join(aggregates.board(t.logs, ["rep"]), F.col("member_id") == F.col("rep"), "left")
    return per.groupBy("auto_assign").agg(F.count("*").alias("reps"), *[F.round(F.avg(F.coalesce(c, F.lit(0))), 4).alias(c) for c in ("knocks", "sales")])


@query("e37_route_progress", f"SELECT s.route_id, count(DISTINCT s.address_hash) AS total, count(DISTINCT l.address_hash) AS done, {pct('count(DISTINCT l.address_hash)', 'count(DISTINCT s.address_hash)')} AS progress FROM stops s LEFT JOIN logs l USING (address_hash) GROUP BY s.route_id")
def e37(t: Tables) -> DataFrame:
    knocked = t.logs.select("address_hash").distinct().withColumn("hit", F.lit(1))
    per = t.stops.select("route_id", "address_hash").distinct().join(knocked, "address_hash", "left").groupBy("route_id").agg(F.count("*").alias("total"), F.count("hit").alias("done"))
    return per.withColumn("progress", percent(F.col("done"), F.col("total")))


@query("e38_zip_drift", f"""SELECT zip_code, coalesce(ours, 0) AS ours, coalesce(theirs, 0) AS theirs, abs(coalesce(ours, 0) - coalesce(theirs, 0)) AS gap, {pct('abs(coalesce(ours, 0) - coalesce(theirs, 0))', 'theirs', 1)} AS drift, {pct('abs(coalesce(ours, 0) - coalesce(theirs, 0))', 'theirs', 1)} > 10 AS flagged
FROM (SELECT zip_code, count(*) AS ours FROM props WHERE route_active GROUP BY 1) a FULL JOIN (SELECT zip_code, count(*) AS theirs FROM props WHERE id % 3 <> 0 GROUP BY 1) b USING (zip_code)""")
def e38(t: Tables) -> DataFrame:
    ours, theirs = (t.props.filter(p).groupBy("zip_code").agg(F.count("*").alias(a)) for p, a in (("route_active", "ours"), ("id % 3 <> 0", "theirs")))
    both = ours.join(theirs, "zip_code", "full").select("zip_code", F.coalesce("ours", F.lit(0)).alias("ours"), F.coalesce("theirs", F.lit(0)).alias("theirs"))
    both = both.withColumn("gap", F.abs(F.col("ours") - F.col("theirs")))
    return both.withColumn("drift", percent(F.col("gap"), F.col("theirs"), 1)).withColumn("flagged", F.col("drift") > 10)


@query("e40_gap_funnel", "SELECT 'raw' AS stage, count(*) AS n FROM props UNION ALL SELECT 'eligible', count(*) FROM props WHERE status <> 'REJECTED' UNION ALL SELECT 'unique', count(DISTINCT house_number || street_name || zip_code) FROM props WHERE status <> 'REJECTED'")
def e40(t: Tables) -> DataFrame:
    one = t.props.agg(F.count("*").alias("raw"), F.count_if(F.expr("status <> 'REJECTED'")).alias("eligible"), F.countDistinct(F.expr("CASE WHEN status <> 'REJECTED' THEN house_number || street_name || zip_code END")).alias("unique"))
    return one.selectExpr("stack(3, 'raw', raw, 'eligible', eligible, 'unique', `unique`) AS (stage, n)")


@query("e41_type_summary", "SELECT property_type, count(*) AS n FROM props GROUP BY 1 ORDER BY n DESC, property_type NULLS FIRST LIMIT 12")
def e41(t: Tables) -> DataFrame:
    return aggregates.top(t.props, "property_type", 12)


STAGES = [
    "zip_code < '29630'", f"(coalesce(sold_date >= TIMESTAMP '{AS_OF_PROPS}' - INTERVAL 12 MONTH, true) AND sold_date IS NOT NULL) OR status = 'MLS_PENDING'", "coalesce(NOT regexp_matches(lower(property_type), 'commercial|land'), true)",
    "coalesce(NOT regexp_matches(lower(property_type), 'condo|town'), true)", "status <> 'REJECTED' AND confidence <> 'REJECTED'", "route_active", f"NOT (sale_type = 'MLS' AND coalesce(sold_date < TIMESTAMP '{AS_OF_PROPS}' - INTERVAL 30 DAY, true))",
    "confidence <> 'low'", "coalesce(price BETWEEN 50000 AND 450000, true)",
]
STAGE_NAMES = ["territory", "sold_date", "commercial", "condo", "rejected", "inactive", "stale_mls", "confidence", "price"]


@query("e42_filter_funnel", "SELECT CAST(0 AS INTEGER) AS stage, 'all_rows' AS name, count(*) AS n, CAST(0 AS BIGINT) AS dropped FROM props UNION ALL " + " UNION ALL ".join(
    f"SELECT CAST({i + 1} AS INTEGER), '{n}', count(*) FILTER ({' AND '.join(f'({s})' for s in STAGES[: i + 1])}), count(*) FILTER ({' AND '.join(f'({s})' for s in STAGES[:i]) or 'true'}) - count(*) FILTER ({' AND '.join(f'({s})' for s in STAGES[: i + 1])}) FROM props" for i, n in enumerate(STAGE_NAMES)))
def e42(t: Tables) -> DataFrame:
    return filters.funnel(t.props, filters.stages(F.lit(AS_OF_PROPS).cast("timestamp")))


@query("e43_coverage", "SELECT CAST(year(sold_date) AS INTEGER) AS sold_year, count(*) AS n, count(DISTINCT state) AS states, count(DISTINCT zip_code) AS zips FROM props GROUP BY 1")
def e43(t: Tables) -> DataFrame:
    return t.props.groupBy(F.year("sold_date").alias("sold_year")).agg(F.count("*").alias("n"), F.countDistinct("state").alias("states"), F.countDistinct("zip_code").alias("zips"))


@query("e44_available_zips", "SELECT zip_code, count(*) AS n FROM props WHERE route_active GROUP BY zip_code")
def e44(t: Tables) -> DataFrame:
    return t.props.filter("route_active").groupBy("zip_code").agg(F.count("*").alias("n"))


@query("e46_route_dates", "SELECT s.route_id, min(sold_date) AS first_sale, max(sold_date) AS last_sale FROM stops s JOIN props p ON s.pid = p.id GROUP BY s.route_id")
def e46(t: Tables) -> DataFrame:
    return t.stops.join(t.props, F.col("pid") == F.col("id")).groupBy("route_id").agg(F.min("sold_date").alias("first_sale"), F.max("sold_date").alias("last_sale"))


@query("e48_completion", f"SELECT s.route_id, count(*) FILTER (p.status = 'SOLD') AS done, count(*) FILTER (p.status <> 'SOLD') AS pending, {pct('''count(*) FILTER (p.status = 'SOLD')''', 'count(*)')} AS completion FROM stops s JOIN props p ON s.pid = p.id GROUP BY s.route_id")
def e48(t: Tables) -> DataFrame:
    done = F.count_if(is_("SOLD"))
    return t.stops.join(t.props.select("id", "status"), F.col("pid") == F.col("id")).groupBy("route_id").agg(done.alias("done"), (F.count("*") - done).alias("pending"), percent(done, F.count("*")).alias("completion"))


@query("e49_route_complete", "SELECT s.route_id, bool_and(p.status NOT IN ('MLS_PENDING', 'REJECTED')) AS complete FROM stops s JOIN props p ON s.pid = p.id GROUP BY s.route_id")
def e49(t: Tables) -> DataFrame:
    return t.stops.join(t.props.select("id", "status"), F.col("pid") == F.col("id")).groupBy("route_id").agg(F.every(~F.col("status").isin("MLS_PENDING", "REJECTED")).alias("complete"))


@query("e50_referrals", "SELECT industry, count(*) AS n, count(*) FILTER (member_status = 'active') AS active, CAST(sum(CASE WHEN member_status = 'active' THEN 9.9e0 ELSE 0e0 END) AS DOUBLE) AS balance FROM members GROUP BY industry")
def e50(t: Tables) -> DataFrame:
    active = F.col("member_status") == "active"
    return t.members.groupBy("industry").agg(F.count("*").alias("n"), F.count_if(active).alias("active"), F.sum(F.when(active, 9.9).otherwise(0.0)).alias("balance"))


@query("e51_billing_audit", "SELECT CASE WHEN x.rep IS NULL THEN 'none' WHEN x.n > 60 THEN 'active' ELSE 'trial' END AS subscription, count(*) AS customers FROM members m LEFT JOIN (SELECT rep, count(*) AS n FROM logs GROUP BY rep) x ON m.member_id = x.rep GROUP BY 1")
def e51(t: Tables) -> DataFrame:
    per = t.members.join(t.logs.groupBy("rep").agg(F.count("*").alias("n")), F.col("member_id") == F.col("rep"), "left")
    return per.groupBy(F.when(F.col("rep").isNull(), "none").when(F.col("n") > 60, "active").otherwise("trial").alias("subscription")).agg(F.count("*").alias("customers"))


@query("e52_unit_economics", "SELECT users, round(users * 29.9e0, 2) AS revenue, round(users * 1500 * 0.5e0 / 1048576, 6) AS storage_gb, round(users * 20 * 300 * 30 / 1073741824e0, 6) AS log_gb FROM (VALUES (10), (100), (1000)) u(users)")
def e52(t: Tables) -> DataFrame:
    u = F.col("users")
    tiers = t.spark.createDataFrame([(10,), (100,), (1000,)], "users int")
    return tiers.select("users", F.round(u * 29.9, 2).alias("revenue"), F.round(u * 1500 * 0.5 / 1048576, 6).alias("storage_gb"), F.round(u.cast("long") * 180_000 / 1073741824.0, 6).alias("log_gb"))


@query("e55_chunk_timing", "SELECT route_id, round(avg(value), 4) AS mean FROM logs GROUP BY route_id")
def e55(t: Tables) -> DataFrame:
    per = t.logs.groupBy("route_id").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    return per.select("route_id", F.round(F.col("s") / F.col("n"), 4).alias("mean"))


@query("e56_directions", """SELECT CASE WHEN abs(y) > abs(x) * 1.7e0 THEN ns WHEN abs(x) > abs(y) * 1.7e0 THEN ew ELSE ns || ew END AS direction, count(*) AS n
FROM (SELECT lat - 34.6e0 AS y, lng + 82.55e0 AS x, CASE WHEN lat - 34.6e0 >= 0 THEN 'N' ELSE 'S' END AS ns, CASE WHEN lng + 82.55e0 >= 0 THEN 'E' ELSE 'W' END AS ew FROM props) d GROUP BY 1""")
def e56(t: Tables) -> DataFrame:
    return t.props.groupBy(geo.sector(F.col("lat") - 34.6, F.col("lng") + 82.55).alias("direction")).agg(F.count("*").alias("n"))


@query("e58_prompt_counts", f"SELECT rep, count(*) AS total, count(*) FILTER (status = 'SOLD') AS sales, count(*) FILTER (status = 'HARD_NO') AS refused, array_to_string(list(status ORDER BY event_id)[1:10], ',') AS recent FROM logs GROUP BY rep")
def e58(t: Tables) -> DataFrame:
    first = joins.first_n(t.logs, "rep", "event_id", "status", 10)
    return t.logs.groupBy("rep").agg(F.count("*").alias("total"), F.count_if(is_("SOLD")).alias("sales"), F.count_if(is_("HARD_NO")).alias("refused")).join(first, "rep").withColumnRenamed("first", "recent")


@query("e59_counters", "SELECT count(*) FILTER (status = 'SOLD') AS sold, count(*) FILTER (sale_type = 'MLS') AS mls, count(*) FILTER (sale_type LIKE 'DEED%') AS deed FROM props")
def e59(t: Tables) -> DataFrame:
    return t.props.agg(F.count_if(is_("SOLD")).alias("sold"), F.count_if(F.col("sale_type") == "MLS").alias("mls"), F.count_if(F.col("sale_type").startswith("DEED")).alias("deed"))


@query("e60_rep_cards", "SELECT rep, count(DISTINCT route_id) FILTER (status = 'SOLD') AS completed, count(DISTINCT route_id) AS active FROM logs GROUP BY rep")
def e60(t: Tables) -> DataFrame:
    return t.logs.groupBy("rep").agg(F.countDistinct(F.when(is_("SOLD"), F.col("route_id"))).alias("completed"), F.countDistinct("route_id").alias("active"))


@query("e61_messages_by_day", "SELECT conv_id, count(*) AS n, array_to_string(list(role ORDER BY turn, text), ',') AS roles FROM conversations GROUP BY conv_id")
def e61(t: Tables) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text", "role")))
    return t.raw("conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x["role"]), ",").alias("roles"))


@query("e62_cities", "SELECT city, count(*) AS n FROM props GROUP BY city")
def e62(t: Tables) -> DataFrame:
    return t.props.groupBy("city").agg(F.count("*").alias("n")).orderBy("city")
