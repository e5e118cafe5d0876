"""Queries of the F and G families: order-dependent operators, sorts and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreline.functions import dates
from acreline.operators import aggregates, joins, ordered
from acreline.plans.base import AS_OF, Tables
from acreline.plans.catalog import query
from acreline.plans.joins import _miles

ROUTE_SQL = "SELECT s.route_id, s.pos, p.lat, p.lng, p.id, p.house_number, p.street_name, p.price, p.sold_date FROM stops s JOIN props p ON s.pid = p.id"


def routed(t: Tables) -> DataFrame:
    return t.stops.join(t.props, F.col("pid") == F.col("id")).select("route_id", "pos", "lat", "lng", "id", "house_number", "street_name", "price", "sold_date")


@query("f01_latest_result", "SELECT address_hash, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts FROM logs GROUP BY address_hash")
def f01(t: Tables) -> DataFrame:
    return joins.latest(t.logs, "address_hash", ["ts", "event_id"], ["status", "ts"])


@query("f02_street_cooldown", f"SELECT street_name, max(ts) FILTER (l.status = 'NO_ANSWER') AS last_missed FROM logs l JOIN props p ON l.pid = p.id GROUP BY street_name")
def f02(t: Tables) -> DataFrame:
    return t.logs.withColumnRenamed("status", "result").join(t.props.select("id", "street_name"), F.col("pid") == F.col("id")).groupBy("street_name").agg(F.max(F.when(F.col("result") == "NO_ANSWER", F.col("ts"))).alias("last_missed"))


@query("f03_dedup_latest_sale", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY house_number, upper(street_name), zip_code ORDER BY sold_date DESC NULLS LAST, id) AS r FROM props) x WHERE r = 1")
def f03(t: Tables) -> DataFrame:
    keyed = t.props.withColumn("street", F.upper("street_name"))
    return ordered.keep_first(keyed, ["house_number", "street", "zip_code"], [F.desc_nulls_last("sold_date"), "id"]).select("id")


@query("f04_dedup_first_wins", "SELECT id, source FROM (SELECT id, source, row_number() OVER (PARTITION BY id ORDER BY source) AS r FROM (SELECT id, 0 AS source FROM props WHERE id % 3 = 0 UNION ALL SELECT id, 1 FROM props WHERE id % 2 = 0) u) x WHERE r = 1")
def f04(t: Tables) -> DataFrame:
    both = t.props.filter("id % 3 = 0").select("id", F.lit(0).alias("source")).unionAll(t.props.filter("id % 2 = 0").select("id", F.lit(1)))
    return ordered.keep_first(both, ["id"], ["source"])


@query("f05_dedup_last_wins", "SELECT pid, arg_max(event_id, event_id) AS event_id FROM logs GROUP BY pid")
def f05(t: Tables) -> DataFrame:
    return ordered.keep_first(t.logs.select("pid", "event_id"), ["pid"], [F.desc("event_id")])


@query("f06_seen_set", "SELECT address_hash, min(event_id) AS event_id FROM logs GROUP BY address_hash")
def f06(t: Tables) -> DataFrame:
    return t.logs.groupBy("address_hash").agg(F.min("event_id").alias("event_id"))


@query("f07_route_legs", f"SELECT route_id, round(sum(leg), 6) AS miles, count(*) AS stops FROM (SELECT route_id, {_miles('lat', 'lead(lat) OVER w', 'lng', 'lead(lng) OVER w')} AS leg FROM ({ROUTE_SQL}) r WINDOW w AS (PARTITION BY route_id ORDER BY pos)) x GROUP BY route_id HAVING count(*) > 1")
def f07(t: Tables) -> DataFrame:
    return ordered.legs(routed(t)).groupBy("route_id").agg(F.round(F.sum("leg"), 6).alias("miles"), F.count("*").alias("stops")).filter("stops > 1")


@query("f07_truncated", f"""SELECT route_id, count(*) AS stops FROM (SELECT route_id, sum(leg) OVER (PARTITION BY route_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM (SELECT route_id, pos, coalesce({_miles('lat', 'lead(lat) OVER w', 'lng', 'lead(lng) OVER w')}, 0) AS leg FROM ({ROUTE_SQL}) r WINDOW w AS (PARTITION BY route_id ORDER BY pos)) x) y
WHERE coalesce(so_far, 0) <= 15 GROUP BY route_id""")
def f07b(t: Tables) -> DataFrame:
    return ordered.legs(routed(t)).filter("coalesce(so_far, 0) <= 15").groupBy("route_id").agg(F.count("*").alias("stops"))


@query("f08_route_names", "SELECT route_id, 'Route ' || row_number() OVER (ORDER BY n DESC, route_id) AS name FROM (SELECT route_id, count(*) AS n FROM logs GROUP BY route_id) x")
def f08(t: Tables) -> DataFrame:
    per = t.logs.groupBy("route_id").agg(F.count("*").alias("n"))  # a row a route
    return per.select("route_id", F.concat(F.lit("Route "), F.row_number().over(Window.orderBy(F.desc("n"), "route_id"))).alias("name"))


@query("f09_streaks", """SELECT rep, least(n, 365) AS streak FROM (SELECT rep, max(day) AS last, count(*) AS n FROM (SELECT rep, day, day - CAST(row_number() OVER (PARTITION BY rep ORDER BY day) AS INTEGER) AS island FROM (SELECT DISTINCT rep, CAST(ts AS DATE) AS day FROM logs WHERE ts < TIMESTAMP '2024-01-26') d) i GROUP BY rep, island) r WHERE DATE '2024-01-25' - last <= 1""")
def f09(t: Tables) -> DataFrame:
    return ordered.streaks(t.logs, "rep", "ts", "2024-01-25")


@query("f10_velocity", "SELECT rep, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS this_week, count(*) FILTER (ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-24') AS last_week FROM logs GROUP BY rep")
def f10(t: Tables) -> DataFrame:
    n = lambda p, a: F.count_if(F.expr(p)).alias(a)
    return t.logs.groupBy("rep").agg(n("ts >= timestamp'2024-01-24'", "this_week"), n("ts >= timestamp'2024-01-17' AND ts < timestamp'2024-01-24'", "last_week"))


@query("f11_daily_trend", "SELECT d.day, count(event_id) AS knocks, count(*) FILTER (status = 'SOLD') AS sales FROM (SELECT CAST(unnest(range(DATE '2023-12-25', DATE '2024-02-01', INTERVAL 1 DAY)) AS DATE) AS day) d LEFT JOIN logs ON CAST(ts AS DATE) = d.day GROUP BY d.day")
def f11(t: Tables) -> DataFrame:
    return aggregates.daily(t.logs, "ts", "2023-12-25", "2024-01-31", knocks=F.count("*"), sales=F.count_if(F.col("status") == "SOLD"))


@query("f12_forecast", """WITH fit AS (SELECT regr_slope(n, x) AS slope, regr_intercept(n, x) AS intercept FROM (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS DOUBLE) AS x, count(*) AS n FROM logs GROUP BY 1) d)
SELECT CAST(30 + d AS BIGINT) AS day_number, round(greatest(0, intercept + slope * (30 + d)), 4) AS forecast, CASE WHEN slope > 0.1 THEN 'up' WHEN slope < -0.1 THEN 'down' ELSE 'flat' END AS label FROM fit, (SELECT unnest(range(14)) AS d) s""")
def f12(t: Tables) -> DataFrame:
    per = t.logs.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    fit = ordered.trend(per)
    days = fit.withColumn("day_number", F.explode(F.sequence(F.lit(30).cast("long"), F.lit(43).cast("long"))))
    return days.select("day_number", F.round(F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * F.col("day_number")), 4).alias("forecast"), "label")


@query("f13_adwin", """WITH shares(share) AS (VALUES (0.3e0), (0.35e0), (0.39999999999999997e0), (0.44999999999999996e0), (0.49999999999999994e0), (0.5499999999999999e0), (0.6e0), (0.65e0)),
sums AS (SELECT route_id, row_number() OVER w AS i, sum(v) OVER w AS s, count(*) OVER (PARTITION BY route_id) AS n, sum(v) OVER (PARTITION BY route_id) AS t FROM (SELECT route_id, ts, event_id, CASE WHEN status IN ('SOLD', 'QUALIFIED') THEN 1e0 ELSE 0e0 END AS v FROM logs) l WINDOW w AS (PARTITION BY route_id ORDER BY ts, event_id)),
splits AS (SELECT route_id, CAST(i AS INTEGER) AS i, round(abs(s / i - (t - s) / (n - i)), 9) AS gap FROM sums, shares WHERE n >= 60 AND i = floor(n * share) AND i >= 30 AND n - i >= 30)
SELECT route_id, CASE WHEN gap > 0.15 THEN i ELSE 0 END AS cut_at, gap FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY gap DESC, i) AS r FROM splits) x WHERE r = 1""")
def f13(t: Tables) -> DataFrame:
    rows = t.logs.withColumn("v", F.when(F.col("status").isin("SOLD", "QUALIFIED"), 1.0).otherwise(0.0))
    return ordered.adwin(rows, "route_id", ["ts", "event_id"], "v")


@query("f14_round_robin", "SELECT id, (row_number() OVER (PARTITION BY zip_code ORDER BY id) - 1) % 5 AS slot FROM props")
def f14(t: Tables) -> DataFrame:
    return t.props.select("id", ((F.row_number().over(Window.partitionBy("zip_code").orderBy("id")).cast("long") - 1) % 5).alias("slot"))


@query("f15_priority", "SELECT s.route_id, s.pid, s.pos, row_number() OVER (PARTITION BY s.route_id ORDER BY p.price DESC, s.pos)::INTEGER AS priority FROM stops s JOIN props p ON s.pid = p.id")
def f15(t: Tables) -> DataFrame:
    rank = Window.partitionBy("route_id").orderBy(F.desc("price"), "pos")
    return routed(t).select("route_id", F.col("id").alias("pid"), "pos", F.row_number().over(rank).alias("priority"))


@query("f16_ghost_leads", """SELECT zip_code, street_name, CAST(unnest(range(house_number + 2, ahead, 2)) AS INTEGER) AS house_number FROM (SELECT zip_code, street_name, house_number, lead(house_number) OVER (PARTITION BY zip_code, street_name, house_number % 2 ORDER BY house_number) AS ahead FROM (SELECT DISTINCT zip_code, street_name, house_number FROM props) d) x WHERE ahead - house_number BETWEEN 4 AND 40""")
def f16(t: Tables) -> DataFrame:
    return ordered.ghosts(t.props)


@query("f17_sliding_rate", "SELECT event_id, round(avg(value) OVER (PARTITION BY rep ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rate FROM logs")
def f17(t: Tables) -> DataFrame:
    last = Window.partitionBy("rep").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return t.logs.select("event_id", F.round(F.avg("value").over(last), 6).alias("rate"))


@query("f18_chunks", "SELECT id, (row_number() OVER (PARTITION BY owner_id ORDER BY id) - 1) // 20 AS chunk FROM props")
def f18(t: Tables) -> DataFrame:
    return t.props.select("id", F.expr("(row_number() OVER (PARTITION BY owner_id ORDER BY id) - 1) div 20").alias("chunk"))


@query("f19_waypoints", "SELECT route_id, pos FROM (SELECT route_id, pos, count(*) OVER (PARTITION BY route_id) AS n FROM stops) x WHERE n <= 4 OR (pos - 1) % CAST(ceil(n / 4) AS INTEGER) = 0")
def f19(t: Tables) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("route_id"))
    return t.stops.withColumn("n", n).filter((F.col("n") <= 4) | ((F.col("pos") - 1) % F.ceil(F.col("n") / 4).cast("int") == 0)).select("route_id", "pos")


@query("f20_look_back", "SELECT conv_id, turn, coalesce(lag(role, 1) OVER w, '') || '|' || coalesce(lag(role, 2) OVER w, '') || '|' || coalesce(lag(role, 3) OVER w, '') AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)")
def f20(t: Tables) -> DataFrame:
    along = Window.partitionBy("conv_id").orderBy("turn", "text")
    return t.raw("conversations").select("conv_id", "turn", F.concat_ws("|", *[F.coalesce(F.lag("role", i).over(along), F.lit("")) for i in (1, 2, 3)]).alias("before"))


@query("f21_recent_keys", "SELECT k, max(ts) AS ts FROM logs GROUP BY k ORDER BY ts DESC, k LIMIT 20")
def f21(t: Tables) -> DataFrame:
    return t.logs.groupBy("k").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "k").limit(20)


@query("g01_newest_sales", "SELECT id, sold_date FROM props ORDER BY sold_date DESC NULLS LAST, id LIMIT 50")
def g01(t: Tables) -> DataFrame:
    return t.props.orderBy(F.desc_nulls_last("sold_date"), "id").limit(50).select("id", "sold_date")


@query("g02_top_leads", "SELECT zip_code, id FROM (SELECT zip_code, id, row_number() OVER (PARTITION BY zip_code ORDER BY price DESC, id) AS r FROM props) x WHERE r <= 3")
def g02(t: Tables) -> DataFrame:
    rank = Window.partitionBy("zip_code").orderBy(F.desc("price"), "id")
    return t.props.withColumn("r", F.row_number().over(rank)).filter("r <= 3").select("zip_code", "id")


@query("g03_leaderboard_top", "SELECT rep, sales, knocks FROM (SELECT rep, count(*) FILTER (status = 'SOLD') AS sales, count(*) AS knocks FROM logs GROUP BY rep) x ORDER BY sales DESC, knocks DESC, rep LIMIT 10")
def g03(t: Tables) -> DataFrame:
    return aggregates.board(t.logs, ["rep"]).orderBy(F.desc("sales"), F.desc("knocks"), "rep").limit(10).select("rep", "sales", "knocks")


@query("g04_status_order", "SELECT id, CASE status WHEN 'SOLD' THEN 0 WHEN 'HEURISTIC_SOLD' THEN 1 WHEN 'MLS_PENDING' THEN 2 ELSE 3 END AS place FROM props ORDER BY place, id LIMIT 100")
def g04(t: Tables) -> DataFrame:
    place = F.when(F.col("status") == "SOLD", 0).when(F.col("status") == "HEURISTIC_SOLD", 1).when(F.col("status") == "MLS_PENDING", 2).otherwise(3)
    return t.props.select("id", place.alias("place")).orderBy("place", "id").limit(100)


@query("g05_route_sort", f"SELECT route_id, count(*) AS houses, max(sold_date) AS last_sale FROM ({ROUTE_SQL}) r GROUP BY route_id ORDER BY houses DESC, last_sale DESC NULLS LAST, route_id LIMIT 25")
def g05(t: Tables) -> DataFrame:
    return routed(t).groupBy("route_id").agg(F.count("*").alias("houses"), F.max("sold_date").alias("last_sale")).orderBy(F.desc("houses"), F.desc_nulls_last("last_sale"), "route_id").limit(25)


@query("g06_best_hour", "SELECT hour FROM (SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) FILTER (status <> 'NO_ANSWER') / count(*) AS rate, count(*) AS n FROM logs GROUP BY 1) x ORDER BY rate DESC, n DESC, hour LIMIT 1")
def g06(t: Tables) -> DataFrame:
    per = t.logs.groupBy(F.hour("ts").alias("hour")).agg((F.count_if(F.col("status") != "NO_ANSWER") / F.count("*")).alias("rate"), F.count("*").alias("n"))
    return per.orderBy(F.desc("rate"), F.desc("n"), "hour").limit(1).select("hour")


def hours_sql(ts: str) -> str:
    case = lambda table: f"CASE CAST(hour({ts}) AS INTEGER) " + " ".join(f"WHEN {h} THEN {s}" for h, s in table.items()) + " ELSE 0 END"
    return f"CASE dayofweek({ts}) WHEN 0 THEN {case(dates.SUNDAY_HOURS)} WHEN 6 THEN {case(dates.SATURDAY_HOURS)} ELSE {case(dates.WEEKDAY_HOURS)} END"


@query("g07_time_sorted", f"SELECT event_id, {hours_sql('ts')} AS score FROM logs ORDER BY score DESC, event_id LIMIT 200")
def g07(t: Tables) -> DataFrame:
    return t.logs.select("event_id", dates.knock_score(F.col("ts")).alias("score")).orderBy(F.desc("score"), "event_id").limit(200)


@query("g08_day_groups", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM logs GROUP BY 1 ORDER BY day DESC LIMIT 10")
def g08(t: Tables) -> DataFrame:
    return t.logs.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(10)


@query("g09_random_order")
def g09(t: Tables) -> DataFrame:
    """A repeatable draw: the order is a hash of the key and a seed."""
    return t.props.orderBy(F.xxhash64("id", F.lit(42)), "id").limit(100).select("id")


@query("g10_plain_limit", "SELECT id FROM props ORDER BY id LIMIT 10")
def g10(t: Tables) -> DataFrame:
    return t.props.orderBy("id").limit(10).select("id")


@query("g11_best_windows", f"SELECT slot FROM (SELECT unnest(range(TIMESTAMP '{AS_OF}', TIMESTAMP '{AS_OF}' + INTERVAL 48 HOUR, INTERVAL 1 HOUR)) AS slot) h WHERE {hours_sql("slot")} >= 80 ORDER BY slot LIMIT 3")
def g11(t: Tables) -> DataFrame:
    at = F.explode(F.sequence(F.lit(AS_OF).cast("timestamp"), F.expr(f"timestamp'{AS_OF}' + INTERVAL 47 HOURS"), F.expr("INTERVAL 1 HOUR")))
    return t.spark.range(1).select(at.alias("slot")).filter(dates.knock_score(F.col("slot")) >= 80).orderBy("slot").limit(3)


@query("g12_result_table", "SELECT id FROM props ORDER BY coalesce(CAST(CAST(sold_date AS DATE) AS VARCHAR), '') DESC, price DESC, id LIMIT 200")
def g12(t: Tables) -> DataFrame:
    return t.props.orderBy(F.desc(F.coalesce(F.to_date("sold_date").cast("string"), F.lit(""))), F.desc("price"), "id").limit(200).select("id")
