"""Queries of the D family: joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.functions import geo
from acreline.operators import joins
from acreline.plans.base import AS_OF_PROPS, Tables
from acreline.plans.catalog import query
from acreline.plans.filters import POLYGON

ALIAS_SQL = "logs l JOIN (SELECT id, address_hash AS a FROM props UNION SELECT id, legacy_hash FROM props) p ON l.address_hash = p.a"
HAVERSINE = "3959e0 * 2 * atan2(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)), sqrt(1 - (pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"


def _miles(a: str, b: str, c: str, d: str) -> str:
    return HAVERSINE.format(a=a, b=b, c=c, d=d)


@query("d01_workspace_join", "SELECT l.event_id, m.name FROM logs l JOIN members m ON l.rep = m.member_id WHERE l.status = 'SOLD'")
def d01(t: Tables) -> DataFrame:
    return t.logs.filter("status = 'SOLD'").join(t.members, F.col("rep") == F.col("member_id")).select("event_id", "name")


@query("d02_zip_coordinates", """WITH zips AS (SELECT zip_code, avg(lat) AS zlat FROM props WHERE zip_code < '29620' GROUP BY zip_code)
SELECT p.id, round(coalesce(z.zlat, p.lat), 6) AS lat FROM props p LEFT JOIN zips z USING (zip_code)""")
def d02(t: Tables) -> DataFrame:
    zips = t.props.filter("zip_code < '29620'").groupBy("zip_code").agg(F.avg("lat").alias("zlat"))
    return t.props.join(zips, "zip_code", "left").select("id", F.round(F.coalesce("zlat", "lat"), 6).alias("lat"))


@query("d03_alias_join", f"SELECT l.event_id, p.id FROM {ALIAS_SQL}")
def d03(t: Tables) -> DataFrame:
    return joins.alias_join(t.logs, t.props.select("id", "address_hash", "legacy_hash")).select("event_id", "id")


@query("d04_request_order", "SELECT s.route_id, s.pos, p.zip_code FROM stops s JOIN props p USING (address_hash)")
def d04(t: Tables) -> DataFrame:
    return joins.in_order(t.stops, t.props.select("address_hash", "zip_code"), "address_hash").select("route_id", "pos", "zip_code")


@query("d05_fallback_lookup", """SELECT k.address_hash, CASE WHEN p.owner_id = 7 THEN 0 WHEN p.id < 1000 THEN 1 ELSE 2 END AS tier
FROM (SELECT DISTINCT address_hash FROM stops) k JOIN props p USING (address_hash)""")
def d05(t: Tables) -> DataFrame:
    rows = t.props.select("address_hash", "id", "owner_id")
    return joins.cascade(t.stops.select("address_hash").distinct(), "address_hash", [rows.filter("owner_id = 7"), rows.filter("id < 1000"), rows]).select("address_hash", "tier")


ADDRESS = "upper(house_number || ' ' || street_name) || '|' || zip_code"


@query("d06_deed_wins", f"SELECT id FROM props WHERE sale_type = 'DEED' UNION ALL SELECT id FROM props WHERE sale_type = 'MLS' AND {ADDRESS} NOT IN (SELECT {ADDRESS} FROM props WHERE sale_type = 'DEED')")
def d06(t: Tables) -> DataFrame:
    keyed = t.props.withColumn("key", F.expr(ADDRESS))
    deeds = keyed.filter("sale_type = 'DEED'")
    return deeds.select("id").unionAll(keyed.filter("sale_type = 'MLS'").join(deeds.select("key").distinct(), "key", "left_anti").select("id"))


@query("d07_not_stored", "SELECT id FROM props WHERE CAST(id AS VARCHAR) NOT IN (SELECT address_hash FROM stops)")
def d07(t: Tables) -> DataFrame:
    stored = t.stops.select(F.col("address_hash").alias("stored")).distinct()
    return t.props.join(stored, F.col("id").cast("string") == F.col("stored"), "left_anti").select("id")


@query("d08_promote_confirmed", f"""SELECT id, CASE WHEN {ADDRESS} IN (SELECT {ADDRESS} FROM props WHERE sale_type = 'DEED') THEN 'DEED_CONFIRMED' ELSE status END AS status FROM props WHERE sale_type = 'MLS'""")
def d08(t: Tables) -> DataFrame:
    keyed = t.props.withColumn("key", F.expr(ADDRESS))
    return joins.promote(keyed.filter("sale_type = 'MLS'"), keyed.filter("sale_type = 'DEED'"), "key", {"status": F.lit("DEED_CONFIRMED")}).select("id", "status")


@query("d09_promote_global", f"""SELECT id, CASE WHEN status = 'HEURISTIC_SOLD' AND {ADDRESS} IN (SELECT {ADDRESS} FROM props WHERE sale_type IN ('DEED', 'CORPORATE')) THEN 'verified' ELSE confidence END AS confidence FROM props""")
def d09(t: Tables) -> DataFrame:
    keyed = t.props.withColumn("key", F.expr(ADDRESS))
    verified = F.when(F.col("status") == "HEURISTIC_SOLD", "verified").otherwise(F.col("confidence"))
    return joins.promote(keyed, keyed.filter("sale_type IN ('DEED', 'CORPORATE')"), "key", {"confidence": verified}).select("id", "confidence")


@query("d10_unseen_listings", "SELECT id FROM listings WHERE id NOT IN (SELECT id FROM listings WHERE last_seen < TIMESTAMP '1999-01-01')")
def d10(t: Tables) -> DataFrame:
    return t.listings.join(t.listings.filter("last_seen < timestamp'1999-01-01'").select("id"), "id", "left_anti").select("id")


@query("d11_knocked_flag", "SELECT id, address_hash IN (SELECT address_hash FROM logs) AS knocked FROM props")
def d11(t: Tables) -> DataFrame:
    knocked = t.logs.select("address_hash").distinct().withColumn("seen", F.lit(True))
    return t.props.join(knocked, "address_hash", "left").select("id", F.col("seen").isNotNull().alias("knocked"))


@query("d12_verification_result", """SELECT p.id, CASE WHEN v.status = 'SOLD' THEN 'verified' WHEN v.status IS NULL THEN p.confidence ELSE 'low' END AS confidence
FROM props p LEFT JOIN (SELECT address_hash, arg_min(status, event_id) AS status FROM logs GROUP BY 1) v USING (address_hash)""")
def d12(t: Tables) -> DataFrame:
    first = t.logs.groupBy("address_hash").agg(F.min_by("status", "event_id").alias("result"))
    return t.props.join(first, "address_hash", "left").select("id", F.when(F.col("result") == "SOLD", "verified").when(F.col("result").isNull(), F.col("confidence")).otherwise("low").alias("confidence"))


@query("d13_heat_join", """WITH cells AS (SELECT id, CAST(floor(lat / 0.004e0) AS BIGINT) AS r, CAST(floor(lng / 0.004e0) AS BIGINT) AS c, status FROM props),
rings(a, b) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1), (1, 1), (-1, -1))
SELECT p.id, count(*) AS n_sales FROM cells p, rings JOIN cells s ON s.status = 'SOLD' AND s.r = p.r + a AND s.c = p.c + b GROUP BY p.id""")
def d13(t: Tables) -> DataFrame:
    row, col = geo.cell(F.col("lat"), F.col("lng"))
    # sales are summed per cell first, so a crowded cell is one row
    sold = t.props.filter("status = 'SOLD'").groupBy(F.struct(row.alias("r"), col.alias("c")).alias("cell")).agg(F.count("*").alias("n"))
    around = t.props.select("id", F.explode(geo.ring(row, col)).alias("cell"))
    return around.join(sold, "cell").groupBy("id").agg(F.sum("n").alias("n_sales"))


EDGES = ", ".join(f"({a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for a, b in zip(POLYGON, [*POLYGON[1:], POLYGON[0]], strict=True))


@query("d14_points_in_polygon", f"""WITH edges(la, na, lb, nb) AS (VALUES {EDGES})
SELECT id FROM props, edges WHERE (la > lat) <> (lb > lat) AND lng < (nb - na) * (lat - la) / (lb - la) + na GROUP BY id HAVING count(*) % 2 = 1""")
def d14(t: Tables) -> DataFrame:
    near = geo.in_bounds(F.col("lat"), F.col("lng"), geo.bounds(POLYGON))
    return t.props.filter(near).filter(geo.in_polygon(F.col("lat"), F.col("lng"), POLYGON)).select("id")


def edge_sql(lat: str, lng: str) -> str:
    """Miles from a circle's centre to the edge (la, na, lb, nb) on the plane at its latitude."""
    k = f"(cos(radians({lat})) * 69e0)"
    ax, ay, dx, dy = f"((na - {lng}) * {k})", f"((la - {lat}) * 69e0)", f"((nb - na) * {k})", "((lb - la) * 69e0)"
    t = f"greatest(0e0, least(1e0, -({ax} * {dx} + {ay} * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return f"sqrt(pow({ax} + {t} * {dx}, 2) + pow({ay} + {t} * {dy}, 2))"


@query("d15_circle_polygon", f"""WITH edges(la, na, lb, nb) AS (VALUES {EDGES}), inside AS (SELECT id FROM props, edges WHERE (la > lat) <> (lb > lat) AND lng < (nb - na) * (lat - la) / (lb - la) + na GROUP BY id HAVING count(*) % 2 = 1)
SELECT id FROM props WHERE id IN (SELECT id FROM inside) OR id IN (SELECT id FROM props, edges WHERE {edge_sql('lat', 'lng')} <= 1.5)""")
def d15(t: Tables) -> DataFrame:
    """Circles of 1.5 miles around properties that meet the polygon: centre inside, or an edge within."""
    return t.props.filter(geo.circle_meets(F.col("lat"), F.col("lng"), 1.5, POLYGON)).select("id")


@query("d16_nearest_fill", f"""WITH a AS (SELECT * FROM props WHERE assessed IS NULL), b AS (SELECT * FROM props WHERE assessed IS NOT NULL)
SELECT id, near AS near_id FROM (SELECT a.id, b.id AS near, row_number() OVER (PARTITION BY a.id ORDER BY {_miles('a.lat', 'b.lat', 'a.lng', 'b.lng')}, b.id) AS r FROM a, b WHERE {_miles('a.lat', 'b.lat', 'a.lng', 'b.lng')} < 0.5) x WHERE r = 1""")
def d16(t: Tables) -> DataFrame:
    others = t.props.filter("assessed IS NOT NULL").select(F.col("id").alias("near_id"), "lat", "lng")
    return joins.nearest(t.props.filter("assessed IS NULL"), others, 0.5, ["near_id"]).select("id", "near_id")


@query("d17_radius_lookup", f"SELECT id, round({_miles('34.6e0', 'lat', '-82.55e0', 'lng')}, 6) AS miles FROM props WHERE {_miles('34.6e0', 'lat', '-82.55e0', 'lng')} <= 1 ORDER BY {_miles('34.6e0', 'lat', '-82.55e0', 'lng')}, id LIMIT 15")
def d17(t: Tables) -> DataFrame:
    miles = geo.haversine_miles(F.lit(34.6), F.lit(-82.55), F.col("lat"), F.col("lng"))
    near = t.props.filter(geo.in_bounds(F.col("lat"), F.col("lng"), (34.58, 34.62, -82.58, -82.52))).withColumn("far", miles).filter("far <= 1")
    return near.orderBy("far", "id").limit(15).select("id", F.round("far", 6).alias("miles"))


@query("d18_prior_overlap", f"SELECT id FROM props WHERE abs(lat - 34.6) < 0.1 AND abs(lng + 82.55) < 0.1 AND sqft >= 2400 AND sold_date > TIMESTAMP '{AS_OF_PROPS}' - INTERVAL 90 DAY ORDER BY sold_date DESC, id LIMIT 1")
def d18(t: Tables) -> DataFrame:
    prior = t.props.filter((F.abs(F.col("lat") - 34.6) < 0.1) & (F.abs(F.col("lng") + 82.55) < 0.1) & (F.col("sqft") >= 2400) & (F.col("sold_date") > F.expr(f"timestamp'{AS_OF_PROPS}' - INTERVAL 90 DAYS")))
    return prior.orderBy(F.desc("sold_date"), "id").limit(1).select("id")


@query("d19_member_totals", """SELECT m.member_id, coalesce(x.knocks, 0) AS knocks, coalesce(x.sales, 0) AS sales
FROM members m LEFT JOIN (SELECT rep, count(*) AS knocks, count(*) FILTER (status = 'SOLD') AS sales FROM logs GROUP BY rep) x ON m.member_id = x.rep""")
def d19(t: Tables) -> DataFrame:
    per = t.logs.groupBy("rep").agg(F.count("*").alias("knocks"), F.count_if(F.col("status") == "SOLD").alias("sales"))
    return t.members.join(per, F.col("member_id") == F.col("rep"), "left").select("member_id", F.coalesce("knocks", F.lit(0)).alias("knocks"), F.coalesce("sales", F.lit(0)).alias("sales"))


@query("d20_log_routes", "SELECT l.event_id, coalesce(m.name, 'Route ' || l.route_id) AS route FROM logs l LEFT JOIN (SELECT * FROM members WHERE member_id < 10) m ON l.route_id = m.member_id")
def d20(t: Tables) -> DataFrame:
    named = t.members.filter("member_id < 10").select(F.col("member_id").alias("route_id"), "name")
    return t.logs.join(named, "route_id", "left").select("event_id", F.coalesce("name", F.concat(F.lit("Route "), "route_id")).alias("route"))


@query("d21_routes_of_logs", "SELECT l.event_id, s.route_id AS saved_route FROM logs l JOIN stops s USING (address_hash)")
def d21(t: Tables) -> DataFrame:
    return t.logs.join(t.stops.select(F.col("route_id").alias("saved_route"), "address_hash"), "address_hash").select("event_id", "saved_route")


@query("d22_member_user", """WITH users AS (SELECT s_suppkey AS user_id, CASE WHEN s_suppkey % 2 = 0 THEN 'rep' || s_suppkey || '@example.com' ELSE 'x' || s_suppkey END AS mail, 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS full_name FROM supplier)
SELECT member_id, user_id, CASE WHEN mail = email THEN 0 ELSE 1 END AS how FROM members JOIN users ON mail = email OR full_name = name""")
def d22(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    users = t.raw("supplier").select(k.alias("user_id"), F.when(k % 2 == 0, F.concat(F.lit("rep"), k, F.lit("@example.com"))).otherwise(F.concat(F.lit("x"), k)).alias("mail"), F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0")).alias("full_name"))
    m = t.members
    pairs = m.join(users, F.col("email") == F.col("mail")).withColumn("how", F.lit(0)).unionByName(m.join(users, F.col("name") == F.col("full_name")).withColumn("how", F.lit(1)))
    return joins.first_priority(pairs, "member_id", "how", "user_id").select("member_id", "user_id", "how")


D24_ZIPS = ("29607", "29619", "29631")
#: An order's address as somebody wrote it down: as it is, with signs in it, or cut off.
WRITTEN_SQL = "CASE id % 4 WHEN 0 THEN house_number || ' ' || upper(street_name) || ' ' WHEN 1 THEN house_number || '  ' || street_name || '.,' WHEN 2 THEN house_number || ' ' || left(street_name, 8) ELSE house_number || ' ' || street_name || ' North' END"


@query("d24_fuzzy_address", f"""WITH asked AS (SELECT id AS n, {WRITTEN_SQL} AS address, trim(lower({WRITTEN_SQL})) AS txt FROM props WHERE id % 5 = 0),
keyed AS (SELECT *, trim(lower(house_number || ' ' || street_name)) AS txt FROM props),
per AS (SELECT txt, arg_max(id, (coalesce(sold_date, TIMESTAMP '1970-01-01'), -id)) AS id, min(id) AS first FROM keyed GROUP BY txt),
one AS (SELECT n, 1 AS step, per.id FROM asked JOIN per USING (txt)),
hashes AS (SELECT trim(regexp_replace(regexp_replace(upper(txt), '[.,#]', '', 'g'), '\\s+', ' ', 'g')) || '|' || zip_code AS h, max(id) AS id FROM keyed GROUP BY 1),
wanted AS (SELECT n, k, trim(regexp_replace(regexp_replace(upper(address), '[.,#]', '', 'g'), '\\s+', ' ', 'g')) || '|' || z AS h FROM asked, (VALUES {', '.join(f"({i}, '{z}')" for i, z in enumerate(D24_ZIPS))}) v(k, z) WHERE n NOT IN (SELECT n FROM one)),
two AS (SELECT n, 2 AS step, arg_min(id, k) AS id FROM wanted JOIN hashes USING (h) GROUP BY n),
three AS (SELECT n, 3 AS step, arg_min(per.id, first) AS id FROM asked a JOIN per ON split_part(a.txt, ' ', 1) = split_part(per.txt, ' ', 1) AND (contains(substr(per.txt, strpos(per.txt, ' ') + 1), substr(a.txt, strpos(a.txt, ' ') + 1)) OR contains(substr(a.txt, strpos(a.txt, ' ') + 1), substr(per.txt, strpos(per.txt, ' ') + 1)))
  WHERE n NOT IN (SELECT n FROM one) AND n NOT IN (SELECT n FROM two) GROUP BY n)
SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three""")
def d24(t: Tables) -> DataFrame:
    """A fifth of the addresses as somebody wrote them down, found by text, by hash or by part."""
    address = F.expr(WRITTEN_SQL.replace("id % 4", "(id % 4)"))
    asked = t.props.filter("id % 5 = 0").select(F.col("id").alias("n"), address.alias("address"))
    return joins.address_cascade(asked, t.props, D24_ZIPS)


@query("d25_address_report", "SELECT 'matched' AS kind, count(*) AS n FROM stops WHERE lower(address_hash) IN (SELECT lower(address_hash) FROM props) UNION ALL SELECT 'missing', count(*) FROM stops WHERE lower(address_hash) NOT IN (SELECT lower(address_hash) FROM props)")
def d25(t: Tables) -> DataFrame:
    known = t.props.select(F.lower("address_hash").alias("h")).distinct()
    asked = t.stops.select(F.lower("address_hash").alias("h"))
    count = lambda how, name: asked.join(known, "h", how).agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return count("left_semi", "matched").unionAll(count("left_anti", "missing"))


@query("d26_drifted_territory", "SELECT owner_id, array_to_string(list_sort(list_distinct(list(zip_code))), ',') AS zips FROM props WHERE zip_code IN ('29600', '29605', '29610', '29630') GROUP BY owner_id")
def d26(t: Tables) -> DataFrame:
    drifted = t.props.filter(F.col("zip_code").isin("29600", "29605", "29610", "29630"))
    return drifted.groupBy("owner_id").agg(F.array_join(F.array_sort(F.collect_set("zip_code")), ",").alias("zips"))  # four at most


@query("d27_referrals", "SELECT m.member_id, r.member_id AS referrer_id FROM members m JOIN members r ON m.member_id // 7 = r.member_id")
def d27(t: Tables) -> DataFrame:
    referrer = t.members.select(F.col("member_id").alias("referrer_id"))
    return t.members.withColumn("code", F.expr("member_id div 7")).join(referrer, F.col("code") == F.col("referrer_id")).select("member_id", "referrer_id")


@query("d28_cache_ttl", f"SELECT p.id, l.id AS cached_id FROM props p JOIN listings l ON p.id = l.id WHERE l.last_seen > TIMESTAMP '{AS_OF_PROPS}' - INTERVAL 14 DAY")
def d28(t: Tables) -> DataFrame:
    fresh = t.listings.filter(F.col("last_seen") > F.expr(f"timestamp'{AS_OF_PROPS}' - INTERVAL 14 DAYS")).select("id", F.col("id").alias("cached_id"))
    return t.props.join(fresh, "id").select("id", "cached_id")


@query("d29_confirmed_sale", f"""SELECT l.id, count(*) AS n FROM listings l JOIN props a USING (id) JOIN props p ON p.house_number = a.house_number AND p.zip_code = a.zip_code AND p.sale_type = 'DEED'
WHERE abs(date_diff('day', p.sold_date, l.removed)) <= 45 GROUP BY l.id""")
def d29(t: Tables) -> DataFrame:
    # dates meet by stretches of 45 days, a deed in its own and the two beside it
    stretch = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / 45)
    place = t.listings.select("id", "removed").join(t.props.select("id", "house_number", "zip_code"), "id").withColumn("at", stretch("removed"))
    deeds = t.props.filter("sale_type = 'DEED' AND sold_date IS NOT NULL").select("house_number", "zip_code", "sold_date", F.explode(F.sequence(stretch("sold_date") - 1, stretch("sold_date") + 1)).alias("at"))
    return place.join(deeds, ["house_number", "zip_code", "at"]).filter("abs(datediff(removed, sold_date)) <= 45").groupBy("id").agg(F.count("*").alias("n"))


@query("d30_last_location", "SELECT rep, arg_max(pid, (ts, event_id)) AS pid, max(ts) AS seen FROM logs GROUP BY rep")
def d30(t: Tables) -> DataFrame:
    return joins.latest(t.logs, "rep", ["ts", "event_id"], ["pid", "ts"]).select("rep", "pid", F.col("ts").alias("seen"))


@query("d31_group_membership", "SELECT DISTINCT route_id FROM stops WHERE address_hash = 'H7'")
def d31(t: Tables) -> DataFrame:
    return t.stops.filter("address_hash = 'H7'").select("route_id").distinct()
