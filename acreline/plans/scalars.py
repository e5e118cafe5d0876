"""Queries of the I family: scalar functions, grouped by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.functions import dates, geo, text
from acreline.functions.js import clamp, round_half_up, sigmoid
from acreline.plans.base import AS_OF, AS_OF_PROPS, Tables
from acreline.plans.catalog import query
from acreline.sources import portal
from acreline.plans.filters import POLYGON
from acreline.plans.joins import _miles
from acreline.plans.ordered import hours_sql

HOME = ("34.6e0", "-82.55e0")


@query("i01_haversine", f"SELECT id, round({_miles(HOME[0], 'lat', HOME[1], 'lng')}, 6) AS miles FROM props")
def i01(t: Tables) -> DataFrame:
    return t.props.select("id", F.round(geo.haversine_miles(F.lit(34.6), F.lit(-82.55), F.col("lat"), F.col("lng")), 6).alias("miles"))


FAST = "(pow((lng + 82.55e0) * cos(radians((lat + 34.6e0) / 2)), 2) + pow(lat - 34.6e0, 2))"


@query("i02_fast_distance", f"SELECT id, round(sqrt({FAST}) * 69, 6) AS miles, round({FAST}, 9) AS squared FROM props")
def i02(t: Tables) -> DataFrame:
    at = (F.lit(34.6), F.lit(-82.55), F.col("lat"), F.col("lng"))
    return t.props.select("id", F.round(geo.fast_miles(*at), 6).alias("miles"), F.round(geo.fast_squared(*at), 9).alias("squared"))


@query("i04_planar", "SELECT id, round(sqrt(pow((lng + 82.55e0) * 69 * cos(radians(34.6e0)), 2) + pow((lat - 34.6e0) * 69, 2)), 6) AS miles FROM props")
def i04(t: Tables) -> DataFrame:
    return t.props.select("id", F.round(geo.planar_miles(F.lit(34.6), F.lit(-82.55), F.col("lat"), F.col("lng"), F.lit(34.6)), 6).alias("miles"))


@query("i05_bearing", """SELECT id, round((degrees(atan2(sin(radians(lng + 82.55e0)) * cos(radians(lat)), cos(radians(34.6e0)) * sin(radians(lat)) - sin(radians(34.6e0)) * cos(radians(lat)) * cos(radians(lng + 82.55e0)))) + 360) % 360, 5) AS bearing FROM props""")
def i05(t: Tables) -> DataFrame:
    return t.props.select("id", F.round(geo.bearing(F.lit(34.6), F.lit(-82.55), F.col("lat"), F.col("lng")), 5).alias("bearing"))


EDGES = ", ".join(f"({a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for a, b in zip(POLYGON, [*POLYGON[1:], POLYGON[0]], strict=True))


@query("i06_in_polygon", f"""WITH edges(la, na, lb, nb) AS (VALUES {EDGES})
SELECT id, count(*) FILTER ((la > lat) <> (lb > lat) AND lng < (nb - na) * (lat - la) / (lb - la) + na) % 2 = 1 AS inside FROM props, edges GROUP BY id""")
def i06(t: Tables) -> DataFrame:
    return t.props.select("id", geo.in_polygon(F.col("lat"), F.col("lng"), POLYGON).alias("inside"))


SEG = "greatest(0e0, least(1e0, ((px - 0e0) * bx + (py - 0e0) * by_) / (bx * bx + by_ * by_)))"


@query("i07_segment", f"""SELECT id, round(sqrt(pow(px - {SEG} * bx, 2) + pow(py - {SEG} * by_, 2)), 5) AS miles FROM (SELECT id, (lng + 82.6e0) * 69 * cos(radians(34.6e0)) AS px, (lat - 34.55e0) * 69 AS py, 0.1e0 * 69 * cos(radians(34.6e0)) AS bx, 0.1e0 * 69 AS by_ FROM props) x""")
def i07(t: Tables) -> DataFrame:
    return t.props.select("id", F.round(geo.segment_miles(F.col("lat"), F.col("lng"), (34.55, -82.6), (34.65, -82.5), 34.6), 5).alias("miles"))


@query("i08_area", """SELECT route_id, round(abs(sum(lng * nlat - nlng * lat)) / 2 * 69 * 69 * cos(radians(avg(lat))), 4) AS area FROM (
  SELECT route_id, lat, lng, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS nlat, coalesce(lead(lng) OVER w, first_value(lng) OVER w) AS nlng FROM stops s JOIN props p ON s.pid = p.id WINDOW w AS (PARTITION BY route_id ORDER BY pos)) x GROUP BY route_id HAVING count(*) >= 3""")
def i08(t: Tables) -> DataFrame:
    rows = t.stops.join(t.props.select("id", "lat", "lng"), F.col("pid") == F.col("id"))
    rings = rows.groupBy("route_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lat", "lng"))), lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng"))).alias("ring"))
    return rings.filter(F.size("ring") >= 3).select("route_id", F.round(geo.shoelace_sq_miles(F.col("ring")), 4).alias("area"))


@query("i09_area_label", "SELECT id, CASE WHEN a BETWEEN 294 AND 306 THEN 300e0 WHEN a BETWEEN 39 AND 41 THEN 40e0 WHEN a BETWEEN 4.8 AND 5.2 THEN 5e0 ELSE a END AS label FROM (SELECT id, sqft / 10 AS a FROM props) x")
def i09(t: Tables) -> DataFrame:
    return t.props.select("id", geo.snapped_area(F.col("sqft") / 10).alias("label"))


@query("i11_bounds", "SELECT s.route_id, min(lat) AS south, max(lat) AS north, min(lng) AS west, max(lng) AS east FROM stops s JOIN props p ON s.pid = p.id GROUP BY s.route_id")
def i11(t: Tables) -> DataFrame:
    return t.stops.join(t.props, F.col("pid") == F.col("id")).groupBy("route_id").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"))


@query("i19_grid", "SELECT id, CAST(floor(lat / 0.01e0) AS BIGINT) AS r, CAST(floor(lng / 0.01e0) AS BIGINT) AS c FROM props")
def i19(t: Tables) -> DataFrame:
    row, col = geo.cell(F.col("lat"), F.col("lng"), 0.01)
    return t.props.select("id", row.alias("r"), col.alias("c"))


@query("i20_maths", "SELECT event_id, round(1 / (1 + exp(-6e0 * (value / 100 - 0.5e0))), 8) AS s, round(exp(-0.005e0 * value), 8) AS d, least(1e0, greatest(0.2e0, value / 100)) AS c, CAST(floor(value + 0.5) AS BIGINT) AS n FROM logs")
def i20(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.logs.select("event_id", F.round(sigmoid(v / 100), 8).alias("s"), F.round(F.exp(v * -0.005), 8).alias("d"), clamp(v / 100, 0.2, 1.0).alias("c"), round_half_up(v).alias("n"))


def _normal_sql(c: str) -> str:
    out = f"regexp_replace(regexp_replace(trim(upper({c})), '[.,#]', '', 'g'), '\\s+', ' ', 'g')"
    for word, short in text.ABBREVIATIONS:
        if word != short:
            out = f"regexp_replace({out}, '\\b{word}\\b', '{short}', 'g')"
    return out


ADDRESS = "house_number || '  ' || street_name || ' #' || (id % 9)"


@query("i21_normal_address", f"SELECT id, {_normal_sql(ADDRESS)} AS address FROM props")
def i21(t: Tables) -> DataFrame:
    return t.props.select("id", text.normal_address(F.expr(ADDRESS)).alias("address"))


@query("i22_hash_variants", f"""SELECT id, {_normal_sql(ADDRESS)} || '|' || substr(zip_code, 1, 5) AS normal, upper(trim({ADDRESS})) || '|' || zip_code AS plain, sha256(upper(trim({ADDRESS})) || '|' || upper(city) || '|' || zip_code) AS sha,
  substr(md5(upper(trim({ADDRESS}))), 1, 16) AS md, substr(regexp_replace(base64(encode({ADDRESS})), '[^A-Za-z0-9]', '', 'g'), 1, 16) AS b64, regexp_replace(lower(trim({ADDRESS})), '[^a-z0-9]+', '-', 'g') || '-' || zip_code AS dashed FROM props""")
def i22(t: Tables) -> DataFrame:
    a, z = F.expr(ADDRESS), F.col("zip_code")
    return t.props.select(
        "id", text.hash_normal(a, z).alias("normal"), text.hash_upper(a, z).alias("plain"), text.hash_sha256(a, F.col("city"), z).alias("sha"), text.hash_md5(a).alias("md"), text.hash_base64(a).alias("b64"), text.hash_dashed(a, z).alias("dashed"),
    )


@query("i23_split_address", "SELECT id, CAST(house_number AS INTEGER) AS number, street_name AS street FROM props")
def i23(t: Tables) -> DataFrame:
    whole = F.concat_ws(" ", "house_number", "street_name")
    return t.props.select("id", text.house_number(whole).alias("number"), text.street_name(whole).alias("street"))


@query("i25_street_keys", "SELECT DISTINCT street_name, trim(regexp_replace(upper(street_name), '\\s+(AVENUE|ROAD|LANE)$', '')) AS upper_key, regexp_replace(regexp_replace(lower(street_name), '(avenue|road|lane)$', ''), '[^a-z0-9]', '', 'g') AS lower_key FROM props")
def i25(t: Tables) -> DataFrame:
    s = F.col("street_name")
    return t.props.select("street_name").distinct().select("street_name", text.street_key_upper(s).alias("upper_key"), text.street_key(s).alias("lower_key"))


@query("i27_first_integer", "SELECT id, CAST(nullif(regexp_extract(street_name, '[0-9]+'), '') AS INTEGER) AS n FROM props")
def i27(t: Tables) -> DataFrame:
    return t.props.select("id", F.nullif(F.regexp_extract("street_name", r"\d+", 0), F.lit("")).cast("int").alias("n"))


@query("i28_zip5", "SELECT id, CASE WHEN id % 5 = 0 THEN '00000' ELSE substr(trim(' ' || zip_code || '-1234'), 1, 5) END AS zip FROM props")
def i28(t: Tables) -> DataFrame:
    return t.props.select("id", text.zip5(F.when(F.col("id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "zip_code", F.lit("-1234")))).alias("zip"))


@query("i29_zip_of_hash", "SELECT id, CASE id % 3 WHEN 2 THEN NULL ELSE zip_code END AS zip FROM props")
def i29(t: Tables) -> DataFrame:
    h = F.when(F.col("id") % 3 == 0, F.concat(F.lit("1 MAPLE|"), "zip_code", F.lit("-0001"))).when(F.col("id") % 3 == 1, F.concat(F.lit("1-maple-"), "zip_code")).otherwise(F.col("address_hash"))
    return t.props.select("id", text.zip_of_hash(h).alias("zip"))


@query("i30_full_address", "SELECT id, house_number || ' ' || street_name || CASE WHEN id % 4 = 0 THEN '' ELSE ', ' || city END || ', ' || state || ', ' || zip_code AS address FROM props")
def i30(t: Tables) -> DataFrame:
    parts = [F.concat_ws(" ", "house_number", "street_name"), F.when(F.col("id") % 4 == 0, " ").otherwise(F.col("city")), F.col("state"), F.col("zip_code")]
    return t.props.select("id", text.full_address(*parts).alias("address"))


@query("i31_map_url", "SELECT id, 'https://maps.example.com/?q=' || replace(replace(house_number || ' ' || street_name, ' ', '+'), ',', '%2C') AS url FROM props")
def i31(t: Tables) -> DataFrame:
    return t.props.select("id", F.concat(F.lit("https://maps.example.com/?q="), F.url_encode(F.concat_ws(" ", "house_number", "street_name"))).alias("url"))


@query("i32_corporate_owner", "SELECT member_id, member_id % 4 = 0 AS corporate FROM members")
def i32(t: Tables) -> DataFrame:
    return t.members.select("member_id", text.is_corporate(F.array("name", F.when(F.col("member_id") % 4 == 0, "Maple llc").otherwise("Ann Oak"))).alias("corporate"))


@query("i33_import_status", "SELECT event_type, CASE event_type WHEN 'purchase' THEN 'SOLD' WHEN 'click' THEN 'CALLBACK' WHEN 'view' THEN 'NO_ANSWER' WHEN 'signup' THEN 'QUALIFIED' ELSE 'HARD_NO' END AS status, count(*) AS n FROM events GROUP BY 1, 2")
def i33(t: Tables) -> DataFrame:
    return t.raw("events").groupBy("event_type", text.import_status(F.col("event_type")).alias("status")).agg(F.count("*").alias("n"))


@query("i35_result_parser", r"""SELECT doc_id, CASE WHEN regexp_matches(t, 'sold|closed|signed|deal') THEN 'SOLD' WHEN regexp_matches(t, 'nh|n/h|no answer|nobody') THEN 'NO_ANSWER' WHEN regexp_matches(t, 'not interested|go away|dni|\bno\b') THEN 'HARD_NO'
  WHEN regexp_matches(t, 'back|return|later|tomorrow') THEN 'CALLBACK' ELSE 'ELIGIBLE' END AS status FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE lang = 'en') x""")
def i35(t: Tables) -> DataFrame:
    return t.raw("documents").filter("lang = 'en'").select("doc_id", text.result_status(F.col("text")).alias("status"))


@query("i36_result_parser_wide", """SELECT doc_id, CASE WHEN contains(t, 'sold') THEN 'SOLD' WHEN regexp_matches(t, 'qualified|interested|hot lead') THEN 'QUALIFIED' WHEN regexp_matches(t, 'back|return') THEN 'CALLBACK'
  WHEN regexp_matches(t, 'not moved in|hasnt moved|nmi') THEN 'NOT_MOVED_IN' WHEN regexp_matches(t, 'decision maker|dm not home|spouse') THEN 'DM_NOT_HOME' WHEN regexp_matches(t, 'no answer|not home|nh|nobody') THEN 'NO_ANSWER'
  WHEN regexp_matches(t, 'not interested|dni|do not|go away') OR t = 'no' THEN 'HARD_NO' ELSE 'OTHER' END AS status FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE lang = 'en') x""")
def i36(t: Tables) -> DataFrame:
    return t.raw("documents").filter("lang = 'en'").select("doc_id", text.result_status_wide(F.col("text")).alias("status"))


@query("i37_portal_status", "SELECT o_orderstatus AS raw, CASE o_orderstatus WHEN 'F' THEN 'SOLD' WHEN 'O' THEN 'ACTIVE' ELSE 'PENDING' END AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def i37(t: Tables) -> DataFrame:
    return t.raw("orders").groupBy(F.col("o_orderstatus").alias("raw"), text.portal_status(F.col("o_orderstatus")).alias("status")).agg(F.count("*").alias("n"))


@query("i39_page_emails", r"""WITH found AS (SELECT page_id, list_transform(regexp_extract_all(html || ' Info@h' || page_id || '.example.com 1x@y.org info@h' || page_id || '.example.com', '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1), lambda x: lower(x)) AS f FROM pages),
once AS (SELECT page_id, list_filter(f, lambda x, i: list_position(f, x) = i AND NOT regexp_matches(x, '^[0-9]')) AS f FROM found)
SELECT page_id, f[1] AS first_mail, CAST(len(f) AS INTEGER) AS n FROM once""")
def i39(t: Tables) -> DataFrame:
    page = F.concat("html", F.lit(" Info@h"), "page_id", F.lit(".example.com 1x@y.org info@h"), "page_id", F.lit(".example.com"))
    found = text.emails(page)
    return t.raw("pages").select("page_id", F.get(found, F.lit(0)).alias("first_mail"), F.size(found).alias("n"))


@query("i42_amounts", "SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE CAST(CAST(floor(price) AS BIGINT) AS DOUBLE) END AS amount FROM props")
def i42(t: Tables) -> DataFrame:
    written = F.when(F.col("id") % 9 == 0, "n/a").otherwise(F.concat(F.lit("$"), F.format_number(F.floor("price"), 0)))
    return t.props.select("id", text.amount(written).alias("amount"))


@query("i45_days_between", f"SELECT event_id, CAST(floor(date_diff('millisecond', ts, TIMESTAMP '{AS_OF}') / 86400000 + 0.5) AS BIGINT) AS days, round(date_diff('millisecond', ts, TIMESTAMP '{AS_OF}') / 86400000 / 30.44, 6) AS months FROM logs")
def i45(t: Tables) -> DataFrame:
    now, ts = F.lit(AS_OF), F.date_trunc("millisecond", "ts")
    return t.logs.select("event_id", dates.days_between(now, ts).alias("days"), F.round(dates.months_ago(now, ts, 30.44), 6).alias("months"))


@query("i47_month_start", "SELECT id, CAST(sold_date - INTERVAL 6 MONTH AS DATE) AS half_year_before FROM props")
def i47(t: Tables) -> DataFrame:
    return t.props.select("id", F.add_months("sold_date", -6).alias("half_year_before"))


@query("i48_day_keys", "SELECT event_id, CAST(ts AS DATE) AS day, CAST(dayofweek(ts) AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour FROM logs")
def i48(t: Tables) -> DataFrame:
    return t.logs.select("event_id", F.to_date("ts").alias("day"), dates.weekday(F.col("ts")).alias("weekday"), F.hour("ts").alias("hour"))


@query("i49_knock_window", f"SELECT event_id, s AS score, CASE WHEN s >= 85 THEN 'PRIME TIME' WHEN s >= 60 THEN 'GOOD' WHEN s >= 20 THEN 'LOW' ELSE 'AVOID' END AS label FROM (SELECT event_id, {hours_sql('ts')} AS s FROM logs) x")
def i49(t: Tables) -> DataFrame:
    scored = t.logs.select("event_id", dates.knock_score(F.col("ts")).alias("score"))
    return scored.withColumn("label", dates.knock_label(F.col("score")))


@query("i50_time_score", f"""SELECT p.id, least(100, {hours_sql('l.ts')} + CASE WHEN age < 30 THEN 20 WHEN age < 90 THEN 10 ELSE 0 END + CASE WHEN price > 500000 AND hour(l.ts) BETWEEN 10 AND 14 THEN 10 ELSE 0 END) AS score, l.event_id
FROM logs l JOIN (SELECT id, price, floor(date_diff('millisecond', sold_date, TIMESTAMP '{AS_OF_PROPS}') / 86400000) AS age FROM props) p ON l.pid = p.id""")
def i50(t: Tables) -> DataFrame:
    joined = t.logs.join(t.props.select("id", "price", "sold_date"), F.col("pid") == F.col("id"))
    return joined.select("id", dates.time_score(F.col("ts"), F.col("sold_date"), F.col("price"), F.lit(AS_OF_PROPS)).alias("score"), "event_id")


@query("i54_next_eligible", """SELECT event_id, CASE status WHEN 'NO_ANSWER' THEN CAST(ts AS DATE) + 14 WHEN 'CALLBACK' THEN CAST(ts AS DATE) + 1 WHEN 'QUALIFIED' THEN CAST(date_trunc('month', CAST(CAST(ts AS DATE) + INTERVAL 1 MONTH AS DATE)) AS DATE) END AS next_day FROM logs""")
def i54(t: Tables) -> DataFrame:
    return t.logs.select("event_id", dates.next_eligible(F.col("status"), F.col("ts")).alias("next_day"))


@query("i55_cooldown", f"SELECT event_id, CAST(greatest(0, ceil(14 - date_diff('millisecond', ts, TIMESTAMP '{AS_OF}') / 86400000)) AS BIGINT) AS days FROM logs")
def i55(t: Tables) -> DataFrame:
    return t.logs.select("event_id", dates.cooldown_left(F.lit(AS_OF), F.date_trunc("millisecond", "ts"), 14).alias("days"))


@query("i57_array_tests", "SELECT route_id, bool_or(pid % 7 = 0) AS some, bool_and(pid > 2) AS every, bool_or(address_hash = 'H3') AS has FROM stops GROUP BY route_id")
def i57(t: Tables) -> DataFrame:
    per = t.stops.groupBy("route_id").agg(F.collect_list("pid").alias("p"), F.collect_list("address_hash").alias("h"))
    return per.select("route_id", F.exists("p", lambda x: x % 7 == 0).alias("some"), F.forall("p", lambda x: x > 2).alias("every"), F.array_contains("h", "H3").alias("has"))


@query("i58_json_paths", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def i58(t: Tables) -> DataFrame:
    body = portal.parsed(t.raw("events").select("event_id", "props"), "props")
    return body.select("event_id", portal.found(F.col("props"), ("listing.k", "result.k", "k")).cast("long").alias("k"))


@query("i59_to_json", """SELECT member_id, '{"member_id":' || member_id || ',"name":"' || name || '"}' AS payload FROM members""")
def i59(t: Tables) -> DataFrame:
    return t.members.select("member_id", F.to_json(F.struct("member_id", "name")).alias("payload"))


@query("i62_buckets", "SELECT CASE WHEN status IN ('SOLD', 'HEURISTIC_SOLD') THEN 'done' WHEN status = 'MLS_PENDING' THEN 'open' ELSE 'other' END AS bucket, count(*) AS n FROM props GROUP BY 1")
def i62(t: Tables) -> DataFrame:
    bucket = F.when(F.col("status").isin("SOLD", "HEURISTIC_SOLD"), "done").when(F.col("status") == "MLS_PENDING", "open").otherwise("other")
    return t.props.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("i63_polygon_key", "SELECT id, printf('%.5f:%.5f:%d', lat, lng, 5) AS key FROM props")
def i63(t: Tables) -> DataFrame:
    return t.props.select("id", F.format_string("%.5f:%.5f:%d", "lat", "lng", F.lit(5)).alias("key"))


@query("i64_pair_key", "SELECT a.member_id, 'dm_' || least(a.email, b.email) || '_' || greatest(a.email, b.email) AS key FROM members a JOIN members b ON b.member_id = a.member_id * 2")
def i64(t: Tables) -> DataFrame:
    b = t.members.select(F.col("member_id").alias("twice"), F.upper("email").alias("other"))
    return t.members.join(b, F.col("twice") == F.col("member_id") * 2).select("member_id", text.pair_key(F.col("email"), F.col("other")).alias("key"))
