"""Further queries of several families: listing variants, status checks, metrics, shapes, transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreline.functions import geo
from acreline.functions.js import percent
from acreline.operators import ordered, rules, scoring
from acreline.plans.aggregates import pct
from acreline.plans.base import AS_OF_PROPS, Tables
from acreline.plans.catalog import query
from acreline.plans.joins import _miles
from acreline.plans.ordered import ROUTE_SQL, routed
from acreline.plans.rules import LISTING, NOW, now, observations


@query("c07_status_sanity", r"""SELECT id, CASE WHEN regexp_matches(t, '\b(expired|withdrawn|cancell?ed)\b') THEN 'withdrawn' WHEN regexp_matches(t, '\b(pending|contingent)\b') THEN 'pending' WHEN regexp_matches(t, '\bactive\b') AND NOT regexp_matches(t, '\b(sold|closed)\b') THEN 'active'
  WHEN regexp_matches(t, '\b(sold|closed)\b') THEN 'sold' ELSE 'clean' END AS verdict FROM (SELECT id, lower(replace(status, '_', ' ')) || ' ' || CASE id % 5 WHEN 0 THEN 'withdrawn' WHEN 1 THEN 'active' ELSE '' END AS t FROM props) x""")
def c07(t: Tables) -> DataFrame:
    signal = F.concat_ws(" ", F.lower(F.replace("status", F.lit("_"), F.lit(" "))), F.when(F.col("id") % 5 == 0, "withdrawn").when(F.col("id") % 5 == 1, "active"))
    sold = signal.rlike(r"\b(sold|closed)\b")
    verdict = F.when(signal.rlike(r"\b(expired|withdrawn|cancell?ed)\b"), "withdrawn").when(signal.rlike(r"\b(pending|contingent)\b"), "pending").when(signal.rlike(r"\bactive\b") & ~sold, "active").when(sold, "sold").otherwise("clean")
    return t.props.select("id", verdict.alias("verdict"))


@query("d23_route_rep", "SELECT r.route_id, m.member_id FROM (SELECT DISTINCT route_id FROM logs) r JOIN members m ON right(m.name, 3) = lpad(CAST(r.route_id AS VARCHAR), 3, '0') AND left(m.name, 3) = 'Cus'")
def d23(t: Tables) -> DataFrame:
    routes = t.logs.select("route_id").distinct().withColumn("tail", F.lpad(F.col("route_id").cast("string"), 3, "0"))
    reps = t.members.withColumn("tail", F.right(F.element_at(F.split("name", "#"), -1), F.lit(3))).filter(F.left("name", F.lit(3)) == "Cus")
    return routes.join(reps, "tail").select("route_id", "member_id")


@query("e39_coverage_gap", f"SELECT zip_code, {pct('(n - touched)', 'n', 1)} AS gap FROM (SELECT zip_code, count(*) AS n, count(*) FILTER (id IN (SELECT pid FROM logs)) AS touched FROM props GROUP BY zip_code) x")
def e39(t: Tables) -> DataFrame:
    touched = t.logs.select(F.col("pid").alias("id")).distinct().withColumn("hit", F.lit(1))
    per = t.props.join(touched, "id", "left").groupBy("zip_code").agg(F.count("*").alias("n"), F.count("hit").alias("hit"))
    return per.select("zip_code", percent(F.col("n") - F.col("hit"), F.col("n"), 1).alias("gap"))


@query("e47_route_metrics", f"""SELECT route_id, count(*) AS houses, round(avg(price), 6) AS score, round(sum(coalesce(leg, 0)), 5) AS miles FROM (SELECT route_id, price, {_miles('lat', 'lead(lat) OVER w', 'lng', 'lead(lng) OVER w')} AS leg FROM ({ROUTE_SQL}) r WINDOW w AS (PARTITION BY route_id ORDER BY pos)) x GROUP BY route_id""")
def e47(t: Tables) -> DataFrame:
    return ordered.legs(routed(t)).groupBy("route_id").agg(F.count("*").alias("houses"), F.round(F.avg("price"), 6).alias("score"), F.round(F.sum("leg"), 5).alias("miles"))


@query("e53_progress", f"SELECT route_id, {pct('done', 'n', 1)} AS done, round(done / greatest(date_diff('hour', first, last), 1), 4) AS per_hour FROM (SELECT route_id, count(*) AS n, count(*) FILTER (status <> 'NO_ANSWER') AS done, min(ts) AS first, max(ts) AS last FROM logs GROUP BY route_id) x")
def e53(t: Tables) -> DataFrame:
    per = t.logs.groupBy("route_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") != "NO_ANSWER").alias("d"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    hours = F.timestamp_diff("HOUR", F.date_trunc("hour", "a"), F.date_trunc("hour", "b"))
    return per.select("route_id", percent(F.col("d"), F.col("n"), 1).alias("done"), F.round(F.col("d") / F.greatest(hours, F.lit(1)), 4).alias("per_hour"))


@query("e57_response_stats", "SELECT rep, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high FROM logs GROUP BY rep")
def e57(t: Tables) -> DataFrame:
    return t.logs.groupBy("rep").agg(F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("i10_bounding_circle", f"""SELECT route_id, round(clat, 6) AS lat, round(clng, 6) AS lng, ceil(round(max({_miles('clat', 'lat', 'clng', 'lng')}) * 10.5e0, 6)) / 10 AS radius FROM (SELECT route_id, lat, lng, avg(lat) OVER (PARTITION BY route_id) AS clat, avg(lng) OVER (PARTITION BY route_id) AS clng FROM ({ROUTE_SQL}) r) x GROUP BY route_id, clat, clng""")
def i10(t: Tables) -> DataFrame:
    centers = routed(t).groupBy("route_id").agg(F.avg("lat").alias("clat"), F.avg("lng").alias("clng"))
    far = geo.haversine_miles(F.col("clat"), F.col("clng"), F.col("lat"), F.col("lng"))
    per = routed(t).join(centers, "route_id").groupBy("route_id", "clat", "clng").agg(F.max(far).alias("far"))
    return per.select("route_id", F.round("clat", 6).alias("lat"), F.round("clng", 6).alias("lng"), (F.ceil(F.round(F.col("far") * 10.5, 6)) / 10).alias("radius"))


@query("i14_circle_points", "SELECT id, i, round(lat + 1e0 / 69 * cos(2 * pi() * i / 32), 6) AS plat, round(lng + 1e0 / (69 * cos(radians(lat))) * sin(2 * pi() * i / 32), 6) AS plng FROM props, (SELECT CAST(unnest(range(32)) AS INTEGER) AS i) s")
def i14(t: Tables) -> DataFrame:
    """32 points around each property, a mile away."""
    angle = F.lit(6.283185307179586) * F.col("i") / 32
    some = t.props.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return some.select("id", "i", F.round(F.col("lat") + F.lit(1 / 69) * F.cos(angle), 6).alias("plat"), F.round(F.col("lng") + F.lit(1.0) / (F.cos(F.radians("lat")) * 69) * F.sin(angle), 6).alias("plng"))


@query("i17_sector", """SELECT id, CASE WHEN abs(y) > abs(x) * 1.7e0 THEN ns WHEN abs(x) > abs(y) * 1.7e0 THEN ew ELSE ns || ew END AS sector
FROM (SELECT id, lat - 34.6e0 AS y, lng + 82.55e0 AS x, CASE WHEN lat - 34.6e0 >= 0 THEN 'N' ELSE 'S' END AS ns, CASE WHEN lng + 82.55e0 >= 0 THEN 'E' ELSE 'W' END AS ew FROM props) d""")
def i17(t: Tables) -> DataFrame:
    return t.props.select("id", geo.sector(F.col("lat") - 34.6, F.col("lng") + 82.55).alias("sector"))


@query("i41_commission", "SELECT member_id, CASE member_id % 4 WHEN 0 THEN 9.9e0 WHEN 1 THEN 29.9e0 WHEN 2 THEN 4.9e0 ELSE 10e0 END AS commission FROM members")
def i41(t: Tables) -> DataFrame:
    tier = F.col("member_id") % 4
    return t.members.select("member_id", F.when(tier == 0, 9.9).when(tier == 1, 29.9).when(tier == 2, 4.9).otherwise(10.0).alias("commission"))


@query("i44_nullable_dates", "SELECT id, CASE id % 3 WHEN 2 THEN NULL ELSE sold_date END AS parsed FROM props")
def i44(t: Tables) -> DataFrame:
    from acreline.sources.portal import parsed_date

    written = F.when(F.col("id") % 3 == 0, F.date_format("sold_date", "MMMM-d-yyyy")).when(F.col("id") % 3 == 1, F.date_format("sold_date", "yyyy-MM-dd")).otherwise("OFF MARKET")
    return t.props.select("id", parsed_date(written).alias("parsed"))


@query("i53_expiry", "SELECT id, CAST(removed AS DATE) + CASE WHEN id % 3 = 0 THEN 7 ELSE 30 END AS expires FROM listings")
def i53(t: Tables) -> DataFrame:
    return t.listings.select("id", F.date_add(F.to_date("removed"), F.when(F.col("id") % 3 == 0, 7).otherwise(30)).alias("expires"))



@query("j04_days_only", f"SELECT id, CASE WHEN gone > 90 THEN 'REJECTED' WHEN dom > 150 THEN 'REJECTED' WHEN dom BETWEEN 14 AND 45 THEN 'HEURISTIC_SOLD' ELSE 'RECENT_OFF_MARKET' END AS label FROM ({LISTING}) l")
def j04(t: Tables) -> DataFrame:
    """Days alone: how long since removal, how long on the market."""
    x = rules.Listing(now(t))
    label = F.when(x.since_removed > 90, "REJECTED").when(x.dom > 150, "REJECTED").when(x.dom.between(14, 45), "HEURISTIC_SOLD").otherwise("RECENT_OFF_MARKET")
    return t.listings.select("id", label.alias("label"))


@query("j07_webhook_outcome", f"SELECT id, CASE WHEN status = 'SOLD' THEN 'sold' WHEN status = 'MLS_PENDING' AND sold_date >= {NOW} - INTERVAL 365 DAY THEN 'pending_confirmation' ELSE 'rejected' END AS outcome FROM props")
def j07(t: Tables) -> DataFrame:
    recent = F.coalesce(F.col("sold_date") >= F.expr(f"timestamp'{AS_OF_PROPS}' - INTERVAL 365 DAYS"), F.lit(False))
    return t.props.select("id", F.when(F.col("status") == "SOLD", "sold").when((F.col("status") == "MLS_PENDING") & recent, "pending_confirmation").otherwise("rejected").alias("outcome"))


@query("k13_channel_weights", """WITH m AS (SELECT route_id % 4 AS channel, (2e0 + sum(greatest(w, 0))) / (20e0 + sum(abs(w))) AS mean FROM (SELECT route_id, CASE status WHEN 'SOLD' THEN 1e0 WHEN 'QUALIFIED' THEN 0.6e0 WHEN 'CALLBACK' THEN 0.3e0 WHEN 'NO_ANSWER' THEN -0.1e0 ELSE -1e0 END AS w FROM logs) o GROUP BY 1),
raw AS (SELECT channel, 0.25e0 * (1 + (mean - 0.1e0) * 2) AS w FROM m), one AS (SELECT channel, greatest(w / sum(w) OVER (), 0.05e0) AS w FROM raw)
SELECT channel, floor(w / sum(w) OVER () * 10000 + 0.5) / 10000 AS weight FROM one""")
def k13(t: Tables) -> DataFrame:
    per = scoring.posteriors(observations(t).withColumn("channel", F.col("route_id") % 4), "channel")
    whole = Window.partitionBy(F.lit(1))  # four rows
    raw = per.select("channel", (F.lit(0.25) * (F.lit(1) + (F.col("mean") - 0.1) * 2)).alias("w"))
    one = raw.withColumn("w", F.greatest(F.col("w") / F.sum("w").over(whole), F.lit(0.05)))
    return one.select("channel", (F.floor(F.col("w") / F.sum("w").over(whole) * 10000 + 0.5) / 10000).alias("weight"))


@query("m03_lease_lock", "SELECT route_id, arg_min(rep, (ts, event_id)) AS holder FROM logs WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY route_id")
def m03(t: Tables) -> DataFrame:
    """Of the claims since an instant, the oldest holds the lock."""
    return t.logs.filter("ts >= timestamp'2024-01-15'").groupBy("route_id").agg(F.min_by("rep", F.struct("ts", "event_id")).alias("holder"))


@query("m15_completions", "SELECT event_id FROM (SELECT event_id, status, lag(status) OVER (PARTITION BY rep ORDER BY ts, event_id) AS before FROM logs) x WHERE status = 'SOLD' AND before IS DISTINCT FROM 'SOLD'")
def m15(t: Tables) -> DataFrame:
    before = F.lag("status").over(Window.partitionBy("rep").orderBy("ts", "event_id"))
    return t.logs.withColumn("before", before).filter((F.col("status") == "SOLD") & ~F.col("before").eqNullSafe("SOLD")).select("event_id")
