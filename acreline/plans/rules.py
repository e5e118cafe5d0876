"""Queries of the J and K families: classification and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.operators import eligibility, rules, scoring
from acreline.plans.base import AS_OF, AS_OF_PROPS, Tables
from acreline.plans.catalog import query
from acreline.plans.joins import _miles

NOW = f"TIMESTAMP '{AS_OF_PROPS}'"
LISTING = f"""SELECT id, coalesce(dom, gone) AS dom, date_diff('day', listed, removed) AS dur, date_diff('day', last_seen, removed) AS gap, n_history AS h, gone FROM (SELECT *, date_diff('day', removed, {NOW}) AS gone FROM listings) g"""


def now(t: Tables):
    return F.lit(AS_OF_PROPS).cast("timestamp")


J1 = """CASE WHEN dom > 150 THEN -3 WHEN dom > 60 THEN -2 ELSE 0 END + CASE WHEN dur < 7 THEN -1 ELSE 0 END + CASE WHEN abs(gap) < 1 THEN -3 ELSE 0 END + CASE WHEN h >= 3 THEN -1 ELSE 0 END
  + CASE WHEN dom < 30 THEN 3 ELSE 0 END + CASE WHEN dur > 0 AND dur < 45 THEN 2 ELSE 0 END + CASE WHEN gap >= 7 THEN 1 ELSE 0 END + CASE WHEN h = 1 THEN 1 ELSE 0 END"""


@query("j01_chunk_v15", f"SELECT id, score, CASE WHEN score <= -2 THEN 'REJECTED' WHEN score <= 0 THEN 'AMBIGUOUS' ELSE 'MLS_PENDING_VERIFICATION' END AS label FROM (SELECT id, {J1} AS score FROM ({LISTING}) l) x")
def j01(t: Tables) -> DataFrame:
    score, label = rules.chunk_v15(now(t))
    return t.listings.select("id", score.alias("score"), label.alias("label"))


J2 = " + ".join(
    [f"CASE WHEN abs({c} - {d}) <= 3 THEN {p} ELSE 0 END" for c, p in (("dom", -3), ("dur", -2)) for d in (90, 180, 365)]
    + ["CASE WHEN dom > 150 THEN -3 WHEN dom > 60 THEN -2 ELSE 0 END", "CASE WHEN dur < 7 THEN -2 ELSE 0 END", "CASE WHEN abs(gap) < 1 THEN -2 ELSE 0 END", "CASE WHEN h >= 3 THEN -1 ELSE 0 END",
       "CASE WHEN dom BETWEEN 30 AND 45 THEN 3 WHEN dom >= 14 AND dom < 30 THEN 2 ELSE 0 END", "CASE WHEN gap >= 7 THEN 1 ELSE 0 END", "CASE WHEN h = 1 THEN 1 ELSE 0 END"]
)


@query("j02_zip_v8", f"SELECT id, score, CASE WHEN gone > 90 OR score <= -4 THEN 'REJECTED' WHEN score >= 3 THEN 'HEURISTIC_SOLD' ELSE 'RECENT_OFF_MARKET' END AS label FROM (SELECT id, gone, {J2} AS score FROM ({LISTING}) l) x")
def j02(t: Tables) -> DataFrame:
    score, label = rules.zip_v8(now(t))
    return t.listings.select("id", score.alias("score"), label.alias("label"))


@query("j05_sale_confidence", "SELECT id, CASE WHEN sale_type = 'CORPORATE' THEN 'medium' WHEN assessed > 0 AND price < assessed * 0.5 THEN 'medium' ELSE 'high' END AS level FROM props")
def j05(t: Tables) -> DataFrame:
    return t.props.select("id", rules.sale_confidence(F.col("price"), F.col("assessed"), F.col("sale_type") == "CORPORATE").alias("level"))


@query("j06_outcome", f"""SELECT id, CASE WHEN id % 12 = 0 THEN 'rejected' WHEN id % 12 = 1 THEN 'rejected' WHEN id % 12 = 2 THEN 'rejected' WHEN status = 'SOLD' AND date_diff('day', sold_date, {NOW}) <= 90 THEN 'sold'
  WHEN status IN ('PENDING', 'EXPIRED', 'WITHDRAWN') THEN 'rejected' ELSE 'not_sold' END AS outcome FROM props""")
def j06(t: Tables) -> DataFrame:
    k = F.col("id") % 12
    return t.props.select("id", rules.outcome(k == 0, k == 1, k != 2, F.col("status"), F.datediff(now(t), "sold_date")).alias("outcome"))


@query("j08_effective_status", f"""WITH last AS (SELECT pid, arg_max(status, (ts, event_id)) AS r, CAST(arg_max(ts, (ts, event_id)) AS DATE) AS d FROM logs GROUP BY pid)
SELECT id, CASE WHEN r = 'NO_ANSWER' AND d + 14 > DATE '2024-01-31' THEN 'COOLDOWN' WHEN r IS NULL THEN CASE WHEN status IN ('HARD_NO', 'DO_NOT_KNOCK', 'UNVERIFIED') THEN status ELSE 'ELIGIBLE' END WHEN r IN ('HARD_NO', 'SOLD') THEN r WHEN r = 'NO_ANSWER' THEN 'ELIGIBLE'
  WHEN r = 'CALLBACK' THEN CASE WHEN d + 1 <= DATE '2024-01-31' THEN 'ELIGIBLE' ELSE 'CALLBACK' END ELSE r END AS effective FROM props LEFT JOIN last ON id = pid""")
def j08(t: Tables) -> DataFrame:
    return rules.effective_status(t.props, t.logs, F.lit(AS_OF).cast("timestamp"))


@query("j09_result_eligibility", "SELECT id, coalesce(r NOT IN ('SOLD', 'HARD_NO'), true) AS eligible FROM props LEFT JOIN (SELECT pid, arg_max(status, (ts, event_id)) AS r FROM logs GROUP BY pid) l ON id = pid")
def j09(t: Tables) -> DataFrame:
    last = t.logs.groupBy("pid").agg(F.max_by("status", F.struct("ts", "event_id")).alias("r"))
    return t.props.join(last, F.col("id") == F.col("pid"), "left").select("id", F.coalesce(~F.col("r").isin("SOLD", "HARD_NO"), F.lit(True)).alias("eligible"))


@query("j10_street_cooldown", "SELECT id FROM props WHERE street_name NOT IN (SELECT street_name FROM logs l JOIN props p ON l.pid = p.id WHERE l.status = 'NO_ANSWER' AND ts > TIMESTAMP '2024-01-30 12:00:00')")
def j10(t: Tables) -> DataFrame:
    recent = t.logs.filter("status = 'NO_ANSWER' AND ts > timestamp'2024-01-30 12:00:00'").select(F.col("pid").alias("id")).distinct()
    cooling = t.props.join(recent, "id", "left_semi").select("street_name").distinct()
    return t.props.join(cooling, "street_name", "left_anti").select("id")


@query("j12_pins", f"SELECT id, CASE WHEN status = 'SOLD' AND sold_date >= {NOW} - INTERVAL 90 DAY THEN 'recent' WHEN status = 'SOLD' THEN 'sold' WHEN status = 'REJECTED' THEN 'hidden' ELSE 'open' END AS pin FROM props")
def j12(t: Tables) -> DataFrame:
    recent = F.col("sold_date") >= F.expr(f"timestamp'{AS_OF_PROPS}' - INTERVAL 90 DAYS")
    return t.props.select("id", F.when((F.col("status") == "SOLD") & recent, "recent").when(F.col("status") == "SOLD", "sold").when(F.col("status") == "REJECTED", "hidden").otherwise("open").alias("pin"))


@query("j13_downgrade", "SELECT id, CASE WHEN confidence = 'medium' AND id NOT IN (SELECT pid FROM logs) THEN 'low' ELSE confidence END AS level FROM props")
def j13(t: Tables) -> DataFrame:
    seen = t.logs.select(F.col("pid").alias("id")).distinct().withColumn("seen", F.lit(True))
    return t.props.join(seen, "id", "left").select("id", F.when((F.col("confidence") == "medium") & F.col("seen").isNull(), "low").otherwise(F.col("confidence")).alias("level"))


YEARS = f"(date_diff('millisecond', sold_date, {NOW}) / 86400000 / 365.25e0)"
OWNER = f"CASE WHEN sold_date IS NULL THEN 0.3e0 WHEN {YEARS} < 1.5 THEN 0.02e0 ELSE 1 - exp(-0.1155e0 * {YEARS}) END"


@query("k03_ownership", f"SELECT id, round({OWNER}, 8) AS score FROM props")
def k03(t: Tables) -> DataFrame:
    return t.props.select("id", F.round(scoring.ownership(F.col("sold_date"), now(t)), 8).alias("score"))


def _cap(c: str) -> str:
    return f"(SELECT v FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS r, count(*) OVER () AS n FROM props) x WHERE r = floor(n * 0.99) + 1)"


def _scale(c: str) -> str:
    return f"greatest(0e0, least(1e0, (least({c}, {_cap(c)}) - (SELECT min({c}) FROM props)) / ({_cap(c)} - (SELECT min({c}) FROM props))))"


def _weights(i: int) -> str:
    return f"CASE WHEN property_type IN ('Condo', 'Townhouse') THEN {scoring.QUALITY['condo'][i]}e0 WHEN property_type = 'Multi-Family' THEN {scoring.QUALITY['multi'][i]}e0 ELSE {scoring.QUALITY['sfr'][i]}e0 END"


@query("k04_quality", f"SELECT id, round({_weights(0)} * {_scale('ln(price)')} + {_weights(1)} * {_scale('sqft')} + {_weights(2)} * {_scale('lot_size')}, 6) AS pqi FROM props")
def k04(t: Tables) -> DataFrame:
    return scoring.quality(t.props).select("id", F.round("pqi", 6).alias("pqi"))


CELLS = "CAST(floor(lat / 0.004e0) AS BIGINT) AS r, CAST(floor(lng / 0.004e0) AS BIGINT) AS c"


@query("k05_heat", f"""WITH rings(a, b) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1), (1, 1), (-1, -1)), cells AS (SELECT id, lat, lng, sold_date, {CELLS} FROM props),
sales AS (SELECT *, date_diff('millisecond', sold_date, {NOW}) / 86400000 AS age FROM cells WHERE sold_date BETWEEN {NOW} - INTERVAL 365 DAY AND {NOW}),
raw AS (SELECT p.id, sum(exp(-0.005e0 * s.age)) AS raw, max(CASE WHEN {_miles('p.lat', 's.lat', 'p.lng', 's.lng')} <= 0.1 THEN 1 ELSE 0 END) AS near FROM cells p, rings JOIN sales s ON s.r = p.r + a AND s.c = p.c + b GROUP BY p.id)
SELECT p.id, round(coalesce(CASE WHEN near = 1 THEN least(1e0, (1 - exp(-raw)) * 1.16e0) ELSE 1 - exp(-raw) END, 0), 6) AS heat FROM props p LEFT JOIN raw USING (id)""")
def k05(t: Tables) -> DataFrame:
    return scoring.heat(t.props, now(t)).select("id", F.round("heat", 6).alias("heat"))


MEDIAN = f"SELECT r, c, max(price) FILTER (k = floor(m / 2) + 1) AS median FROM (SELECT r, c, price, row_number() OVER (PARTITION BY r, c ORDER BY price) AS k, count(*) OVER (PARTITION BY r, c) AS m FROM (SELECT {CELLS}, price FROM props) y) x GROUP BY r, c"


@query("k06_distress", f"SELECT id, round(0.4e0 * {OWNER} + 0.35e0 * least(1e0, greatest(0e0, (2001 - year_built) / 50e0)) + 0.25e0 * coalesce(least(1e0, abs(price - median) / median), 0), 6) AS distress FROM (SELECT *, {CELLS} FROM props) p JOIN ({MEDIAN}) m USING (r, c)")
def k06(t: Tables) -> DataFrame:
    return scoring.distress(t.props, now(t)).select("id", F.round("distress", 6).alias("distress"))


@query("k07_contact_penalty", "SELECT pid, round(least(0.5e0, 1 - exp(-0.3e0 * count(*) FILTER (status = 'NO_ANSWER'))), 8) AS penalty FROM logs GROUP BY pid")
def k07(t: Tables) -> DataFrame:
    return scoring.contact_penalty(t.logs).select("pid", F.round("penalty", 8).alias("penalty"))


WEIGHT_CASE = "CASE status WHEN 'SOLD' THEN 1e0 WHEN 'QUALIFIED' THEN 0.6e0 WHEN 'CALLBACK' THEN 0.3e0 WHEN 'NO_ANSWER' THEN -0.1e0 ELSE -1e0 END"


def observations(t: Tables) -> DataFrame:
    weight = F.create_map(*[F.lit(x) for kv in scoring.OUTCOME_WEIGHTS.items() for x in kv])[F.col("status")]
    return t.logs.withColumn("w", weight)


FEATURE_SQL = {
    "age_gt_10": "2001 - year_built > 10", "price_gt_300k": "price > 300000", "single_family": "contains(lower(property_type), 'single')", "recent_sale": f"date_diff('millisecond', sold_date, {NOW}) / 86400000e0 / 365 <= 3",
    "high_value": "price > 750000", "large_lot": "lot_size > 10890",
}
POSTERIOR_SQL = f"""seen AS (SELECT p.*, {WEIGHT_CASE.replace('status', 'l.status')} AS w FROM logs l JOIN props p ON l.address_hash IN (p.address_hash, p.legacy_hash)),
learned AS (SELECT {', '.join(f"(2e0 + coalesce(sum(w) FILTER (w > 0 AND {c}), 0)) / (20e0 + coalesce(sum(abs(w)) FILTER ({c}), 0)) AS mean_{n}" for n, c in {**FEATURE_SQL, 'all': 'true'}.items())} FROM seen)"""
BOOST_SQL = " + ".join(f"CASE WHEN {c} THEN greatest(-0.05e0, least(0.05e0, (mean_{n} - mean_all) * 0.5e0)) ELSE 0 END" for n, c in FEATURE_SQL.items())


@query("k08_propensity", f"""WITH rings(a, b) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1), (1, 1), (-1, -1)), cells AS (SELECT *, {CELLS} FROM props),
sales AS (SELECT *, date_diff('millisecond', sold_date, {NOW}) / 86400000 AS age FROM cells WHERE sold_date BETWEEN {NOW} - INTERVAL 365 DAY AND {NOW}),
near AS (SELECT p.id, sum(exp(-0.005e0 * s.age)) AS raw, max(CASE WHEN {_miles('p.lat', 's.lat', 'p.lng', 's.lng')} <= 0.1 THEN 1 ELSE 0 END) AS near FROM cells p, rings JOIN sales s ON s.r = p.r + a AND s.c = p.c + b GROUP BY p.id),
heat AS (SELECT id, CASE WHEN near = 1 THEN least(1e0, (1 - exp(-raw)) * 1.16e0) ELSE 1 - exp(-raw) END AS heat FROM near),
medians AS ({MEDIAN}), pen AS (SELECT pid, least(0.5e0, 1 - exp(-0.3e0 * count(*) FILTER (status = 'NO_ANSWER'))) AS penalty FROM logs GROUP BY pid), {POSTERIOR_SQL},
parts AS (SELECT p.id, id % 9 AS closed, {OWNER} AS owner, {_weights(0)} * {_scale('ln(price)')} + {_weights(1)} * {_scale('sqft')} + {_weights(2)} * {_scale('lot_size')} AS pqi, coalesce(heat, 0) AS heat, coalesce(penalty, 0) AS penalty,
  0.4e0 * {OWNER} + 0.35e0 * least(1e0, greatest(0e0, (2001 - year_built) / 50e0)) + 0.25e0 * coalesce(least(1e0, abs(price - median) / median), 0) AS distress, {BOOST_SQL} AS boost
  FROM cells p JOIN medians USING (r, c) LEFT JOIN heat USING (id) LEFT JOIN pen ON pid = p.id, learned)
SELECT id, CASE WHEN closed = 7 THEN 0 ELSE round(1 / (1 + exp(-6e0 * (0.35e0 * owner + 0.2e0 * CASE WHEN pqi = 0 THEN 0.5e0 ELSE pqi END + 0.25e0 * heat + 0.2e0 * distress + boost - penalty - 0.5e0))), 6) END AS propensity FROM parts""")
def k08(t: Tables) -> DataFrame:
    """The whole score with the boosts that the log teaches; one in nine properties is closed."""
    props = t.props.withColumn("effective_status", F.when(F.col("id") % 9 == 7, "HARD_NO").otherwise("ELIGIBLE"))
    learned = scoring.feature_posteriors(t.props, observations(t).select("address_hash", "w"), now(t))
    return scoring.propensity(props, t.logs, now(t), learned=learned).select("id", F.round("propensity", 6).alias("propensity"))


@query("k09_features", f"SELECT id, {', '.join(f'{c} AS {n}' for n, c in FEATURE_SQL.items())} FROM props")
def k09(t: Tables) -> DataFrame:
    return t.props.select("id", *[c.alias(n) for n, c in scoring.features(now(t)).items()])


@query("k10_outcome_weights", f"SELECT status, {WEIGHT_CASE} AS w, count(*) AS n FROM logs GROUP BY status")
def k10(t: Tables) -> DataFrame:
    return observations(t).groupBy("status", "w").agg(F.count("*").alias("n"))


@query("k11_posteriors", f"""SELECT route_id, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(mean, 8) AS mean, round(greatest(0, mean - 1.96e0 * sqrt(v)), 8) AS low, round(least(1, mean + 1.96e0 * sqrt(v)), 8) AS high FROM (SELECT *, alpha / (alpha + beta) AS mean, alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)) AS v FROM (
  SELECT route_id, 2e0 + sum(CASE WHEN w > 0 THEN w ELSE 0 END) AS alpha, 18e0 + sum(CASE WHEN w < 0 THEN -w ELSE 0 END) AS beta FROM (SELECT route_id, {WEIGHT_CASE} AS w FROM logs) o GROUP BY route_id) s) x""")
def k11(t: Tables) -> DataFrame:
    return scoring.posteriors(observations(t), "route_id").select("route_id", *[F.round(c, d).alias(c) for c, d in (("alpha", 6), ("beta", 6), ("mean", 8), ("low", 8), ("high", 8))])


@query("k14_multipliers", f"""WITH o AS (SELECT l.route_id, {WEIGHT_CASE} AS w FROM logs l), g AS (SELECT (2e0 + sum(greatest(w, 0))) / (20e0 + sum(abs(w))) AS mean FROM o)
SELECT route_id, round((2e0 + sum(greatest(w, 0))) / (20e0 + sum(abs(w))) / greatest((SELECT mean FROM g), 0.01e0), 6) AS multiplier FROM o GROUP BY route_id""")
def k14(t: Tables) -> DataFrame:
    seen = observations(t)
    whole = scoring.posteriors(seen.withColumn("all", F.lit(1)), "all").select(F.col("mean").alias("whole"))
    return scoring.posteriors(seen, "route_id").join(F.broadcast(whole)).select("route_id", F.round(F.col("mean") / F.greatest("whole", F.lit(0.01)), 6).alias("multiplier"))  # one row


VECTOR_SQL = "(VALUES " + ", ".join(f"('{n}', " + ", ".join(f"{x}e0" for x in v) + ")" for n, v in eligibility.INDUSTRIES.items()) + ") v(industry, wa, wv, wq, wl, wi, wr)"
SCORE_SQL = f"""talks AS (SELECT pid, bool_or(status = 'HARD_NO') AS hard, bool_or(status IN ('SOLD', 'QUALIFIED')) AS good, bool_or(status = 'CALLBACK') AS back, bool_or(status = 'NO_ANSWER') AS missed FROM logs GROUP BY pid),
factors AS (SELECT id, status, coalesce(hard, false) AS hard, least(100e0, coalesce(2001 - nullif(year_built, 0), 20) / 50e0 * 100) AS a, least(100e0, coalesce(price, 0) / 500000e0 * 100) AS v, least(100e0, coalesce(sqft, 0) / 3000e0 * 100) AS q, least(100e0, coalesce(lot_size, 0) / 20000e0 * 100) AS l,
  CASE WHEN pid IS NULL THEN 20 WHEN hard THEN 0 WHEN good THEN 95 WHEN back THEN 85 WHEN missed THEN 40 ELSE 30 END AS i,
  CASE WHEN sold_date IS NULL THEN 30 WHEN m <= 6 THEN 95 WHEN m <= 12 THEN 80 WHEN m <= 24 THEN 60 WHEN m <= 60 THEN 40 ELSE 20 END AS r
  FROM (SELECT *, date_diff('millisecond', sold_date, {NOW}) / 86400000e0 / 30 AS m FROM props) p LEFT JOIN talks ON pid = id),
scored AS (SELECT id, industry, status, hard, least(100, greatest(0, CAST(floor(a * wa + v * wv + q * wq + l * wl + i * wi + r * wr + 0.5e0) AS INTEGER))) AS score FROM factors, {VECTOR_SQL})"""


@query("k15_industry_score", f"WITH {SCORE_SQL}\nSELECT id, industry, score FROM scored")
def k15(t: Tables) -> DataFrame:
    return eligibility.scores(t.props, t.logs, now(t), eligibility.INDUSTRIES).select("id", "industry", "score")


@query("k16_rep_match", f"""SELECT rep, round(0.3e0 * CASE WHEN seen > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY THEN 1 ELSE 0 END + 0.3e0 * greatest(0e0, 1 - {_miles('lat', '34.6e0', 'lng', '-82.55e0')} / 20) + 0.4e0 * sales / n, 6) AS score
FROM (SELECT rep, max(ts) AS seen, arg_max(pid, (ts, event_id)) AS last, count(*) AS n, count(*) FILTER (status = 'SOLD') AS sales FROM logs GROUP BY rep) l JOIN props ON last = id""")
def k16(t: Tables) -> DataFrame:
    from acreline.functions.geo import haversine_miles

    per = t.logs.groupBy("rep").agg(F.max("ts").alias("seen"), F.max_by("pid", F.struct("ts", "event_id")).alias("id"), F.count("*").alias("n"), F.count_if(F.col("status") == "SOLD").alias("sales"))
    here = haversine_miles(F.col("lat"), F.col("lng"), F.lit(34.6), F.lit(-82.55))
    free = F.when(F.col("seen") > F.expr(f"timestamp'{AS_OF}' - INTERVAL 1 DAY"), 1).otherwise(0)
    return per.join(t.props.select("id", "lat", "lng"), "id").select("rep", F.round(free * 0.3 + F.greatest(F.lit(0.0), F.lit(1.0) - here / 20) * 0.3 + F.col("sales") / F.col("n") * 0.4, 6).alias("score"))


@query("k18_next_route", f"SELECT route_id FROM (SELECT route_id, avg(price) / 1000 - 2 * {_miles('avg(lat)', '34.6e0', 'avg(lng)', '-82.55e0')} AS v FROM stops s JOIN props p ON s.pid = p.id GROUP BY route_id) x ORDER BY round(v, 6) DESC, route_id LIMIT 1")
def k18(t: Tables) -> DataFrame:
    from acreline.functions.geo import haversine_miles

    per = t.stops.join(t.props, F.col("pid") == F.col("id")).groupBy("route_id").agg(F.avg("price").alias("score"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    value = F.col("score") / 1000 - haversine_miles(F.col("lat"), F.col("lng"), F.lit(34.6), F.lit(-82.55)) * 2
    return per.select("route_id", F.round(value, 6).alias("v")).orderBy(F.desc("v"), "route_id").limit(1).select("route_id")


@query("k19_competitiveness", "SELECT route_id, CAST(floor((0.6e0 * avg(value) + 40 * (count(*) FILTER (status = 'SOLD') / count(*))) * (1 + least(0.2e0, count(DISTINCT pid) / 100e0)) - least(2 * route_id, 20) + 0.5) AS BIGINT) AS score FROM logs GROUP BY route_id")
def k19(t: Tables) -> DataFrame:
    per = t.logs.groupBy("route_id").agg(F.avg("value").alias("v"), (F.count_if(F.col("status") == "SOLD") / F.count("*")).alias("e"), F.countDistinct("pid").alias("d"))
    score = (F.col("v") * 0.6 + F.col("e") * 40) * (F.least(F.lit(0.2), F.col("d") / 100.0) + 1) - F.least(F.col("route_id") * 2, F.lit(20))
    return per.select("route_id", F.floor(score + 0.5).cast("long").alias("score"))


@query("k21_auto_schedule", f"""WITH {SCORE_SQL},
best AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS i FROM scored WHERE industry = 'solar' AND NOT hard AND status <> 'DO_NOT_KNOCK' AND score >= 55 ORDER BY score DESC, id LIMIT 200),
slots AS (SELECT row_number() OVER (ORDER BY d, h) - 1 AS k, TIMESTAMP '2001-08-02' + to_days(CAST(d AS INTEGER)) + to_hours(CAST(h AS INTEGER)) AS at FROM (SELECT d, 9 + k AS h FROM range(1, 8) x(d), range(6) y(k)) z WHERE dayofweek(DATE '2001-08-02' + CAST(d AS INTEGER)) <> 0),
reps AS (SELECT member_id, row_number() OVER (ORDER BY member_id) - 1 AS k FROM members WHERE member_status = 'active')
SELECT b.id, b.score, s.at AS scheduled, r.member_id AS rep FROM best b JOIN slots s ON s.k = b.i % (SELECT count(*) FROM slots) JOIN reps r ON r.k = b.i % (SELECT count(*) FROM reps)""")
def k21(t: Tables) -> DataFrame:
    """Two hundred appointments at most, six a day over a week without its Sunday."""
    reps = t.members.filter("member_status = 'active'").select("member_id")
    return eligibility.schedule(t.props, t.logs, reps, now(t), "solar", 55, 200, 7, 6)
