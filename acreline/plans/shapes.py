"""Queries of shapes on the map, small text functions, guards, listing research and the legacy plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreline.functions import geo
from acreline.functions.text import key_name
from acreline.operators import joins, rules
from acreline.plans.base import Tables
from acreline.plans.catalog import query
from acreline.plans.filters import POLYGON
from acreline.plans.joins import EDGES, _miles, edge_sql

CIRCLE_MILES = 5.0
ACROSS, DOWN = 2 * CIRCLE_MILES * math.cos(math.pi / 6), 1.5 * CIRCLE_MILES


def sub_circles(centers: DataFrame, miles: Column) -> DataFrame:
    """centers (lat, lng, ...) with i, clat, clng: circles of five miles on a hexagonal grid that reach into each radius.

    A radius of five miles or less is one circle. The grid is spelt out by sequences, so nothing is looped over.
    """
    step_lng = F.lit(1.0) / (F.cos(F.radians("lat")) * 69.0)
    size = lambda spacing: F.greatest(F.lit(2), F.ceil(miles * 2 / spacing) + 1).cast("int")
    grid = centers.withColumn("rows", size(DOWN)).withColumn("cols", size(ACROSS))
    grid = grid.withColumn("row", F.explode(F.sequence(F.lit(0), F.when(miles > CIRCLE_MILES, F.col("rows") - 1).otherwise(0))))
    grid = grid.withColumn("col", F.explode(F.sequence(F.lit(0), F.when(miles > CIRCLE_MILES, F.col("cols") - 1).otherwise(0))))
    north = (F.col("row") - (F.col("rows") - 1) / 2) * DOWN
    east = (F.col("col") - (F.col("cols") - 1) / 2) * ACROSS + F.when(F.col("row") % 2 == 1, ACROSS / 2).otherwise(0.0)
    placed = lambda c, off: F.when(miles > CIRCLE_MILES, F.floor((F.col(c) + off) * 1e6 + 0.5) / 1e6).otherwise(F.col(c))
    out = grid.withColumns({"clat": placed("lat", north / 69.0), "clng": placed("lng", east * step_lng), "i": F.col("row") * F.col("cols") + F.col("col")})
    near = geo.planar_miles(F.col("lat"), F.col("lng"), F.col("clat"), F.col("clng"), F.col("lat")) <= miles + CIRCLE_MILES
    return out.filter(near).select(*centers.columns, "i", "clat", "clng")


@query("i12_sub_circles", f"""WITH c AS (SELECT id, lat, lng, CAST(id % 25 AS DOUBLE) AS miles FROM props),
d AS (SELECT *, greatest(2, CAST(ceil(miles * 2 / {DOWN!r}e0) AS INTEGER) + 1) AS rows, greatest(2, CAST(ceil(miles * 2 / {ACROSS!r}e0) AS INTEGER) + 1) AS cols FROM c),
g AS (SELECT *, unnest(range(CASE WHEN miles > 5 THEN cols ELSE 1 END)) AS col FROM (SELECT *, unnest(range(CASE WHEN miles > 5 THEN rows ELSE 1 END)) AS row FROM d) r),
p AS (SELECT *, CAST(row * cols + col AS INTEGER) AS i, CASE WHEN miles > 5 THEN floor((lat + (row - (rows - 1) / 2e0) * {DOWN!r}e0 / 69e0) * 1e6 + 0.5e0) / 1e6 ELSE lat END AS clat,
  CASE WHEN miles > 5 THEN floor((lng + ((col - (cols - 1) / 2e0) * {ACROSS!r}e0 + CASE WHEN row % 2 = 1 THEN {ACROSS / 2!r}e0 ELSE 0e0 END) * (1e0 / (cos(radians(lat)) * 69e0))) * 1e6 + 0.5e0) / 1e6 ELSE lng END AS clng FROM g)
SELECT id, i FROM p WHERE sqrt(pow((clng - lng) * cos(radians(lat)) * 69e0, 2) + pow((clat - lat) * 69e0, 2)) <= miles + 5""")
def i12(t: Tables) -> DataFrame:
    some = t.props.select("id", "lat", "lng", (F.col("id") % 25).cast("double").alias("miles"))
    return sub_circles(some, F.col("miles")).select("id", "i")


CIRCLE_AREA = math.pi * CIRCLE_MILES * CIRCLE_MILES


def coverage(centers: DataFrame, miles: Column, polygon: list[tuple[float, float]]) -> DataFrame:
    """id, original, filtered, pruned, removed, fetch_area, pruned_area, savings: how many circles of the grid reach into the radius, and which of these meet the polygon."""
    large = miles > CIRCLE_MILES
    whole = lambda spacing: F.greatest(F.lit(2), F.ceil(miles * 2 / spacing) + 1)
    placed = sub_circles(centers.withColumn("original", F.when(large, whole(DOWN) * whole(ACROSS)).otherwise(1).cast("long")).withColumn("miles", miles), F.col("miles"))
    meets = ~(F.col("miles") > CIRCLE_MILES) | geo.circle_meets(F.col("clat"), F.col("clng"), CIRCLE_MILES, polygon)
    per = placed.groupBy("id", "miles", "original").agg(F.count("*").alias("filtered"), F.count_if(meets).alias("pruned"))
    area = lambda n: F.round(F.when(F.col("miles") > CIRCLE_MILES, F.col(n) * CIRCLE_AREA).otherwise(F.col("miles") * F.col("miles") * math.pi), 1)
    removed = F.col("original") - F.col("pruned")
    return per.select("id", "original", "filtered", "pruned", removed.alias("removed"), area("original").alias("fetch_area"), area("pruned").alias("pruned_area"), F.round(removed / F.col("original") * 100, 1).alias("savings"))


@query("i12_coverage", f"""WITH c AS (SELECT id, lat, lng, CAST(id % 25 AS DOUBLE) AS miles FROM props),
d AS (SELECT *, greatest(2, CAST(ceil(miles * 2 / {DOWN!r}e0) AS INTEGER) + 1) AS rows, greatest(2, CAST(ceil(miles * 2 / {ACROSS!r}e0) AS INTEGER) + 1) AS cols FROM c),
g AS (SELECT *, unnest(range(CASE WHEN miles > 5 THEN cols ELSE 1 END)) AS col FROM (SELECT *, unnest(range(CASE WHEN miles > 5 THEN rows ELSE 1 END)) AS row FROM d) r),
p AS (SELECT *, CAST(row * cols + col AS INTEGER) AS i, CASE WHEN miles > 5 THEN floor((lat + (row - (rows - 1) / 2e0) * {DOWN!r}e0 / 69e0) * 1e6 + 0.5e0) / 1e6 ELSE lat END AS clat,
  CASE WHEN miles > 5 THEN floor((lng + ((col - (cols - 1) / 2e0) * {ACROSS!r}e0 + CASE WHEN row % 2 = 1 THEN {ACROSS / 2!r}e0 ELSE 0e0 END) * (1e0 / (cos(radians(lat)) * 69e0))) * 1e6 + 0.5e0) / 1e6 ELSE lng END AS clng FROM g)
, near AS (SELECT id, i, miles, rows, cols, clat, clng FROM p WHERE sqrt(pow((clng - lng) * cos(radians(lat)) * 69e0, 2) + pow((clat - lat) * 69e0, 2)) <= miles + 5),
edges(la, na, lb, nb) AS (VALUES {EDGES}),
crossed AS (SELECT id, i FROM near, edges WHERE (la > clat) <> (lb > clat) AND clng < (nb - na) * (clat - la) / (lb - la) + na GROUP BY id, i HAVING count(*) % 2 = 1),
touched AS (SELECT DISTINCT id, i FROM near, edges WHERE {edge_sql('clat', 'clng')} <= 5),
n AS (SELECT id, miles, CASE WHEN miles > 5 THEN rows * cols ELSE 1 END AS original, count(*) AS filtered, count(*) FILTER (miles <= 5 OR (id, i) IN (SELECT (id, i) FROM crossed) OR (id, i) IN (SELECT (id, i) FROM touched)) AS pruned FROM near GROUP BY 1, 2, 3)
SELECT id, CAST(original AS BIGINT) AS original, filtered, pruned, original - pruned AS removed, round(CASE WHEN miles > 5 THEN original * {CIRCLE_AREA!r}e0 ELSE pi() * miles * miles END, 1) AS fetch_area, round(CASE WHEN miles > 5 THEN pruned * {CIRCLE_AREA!r}e0 ELSE pi() * miles * miles END, 1) AS pruned_area, round((original - pruned) / original * 100e0, 1) AS savings FROM n""")
def i12_coverage(t: Tables) -> DataFrame:
    return coverage(t.props.select("id", "lat", "lng"), (F.col("id") % 25).cast("double"), POLYGON)


@query("i15_preset_shapes", """WITH s AS (SELECT id, lat, lng, CAST(greatest(id % 40, 1) AS DOUBLE) AS area, greatest(1e0, 69e0 * cos(radians(lat))) AS w FROM props)
SELECT id, round(lat + sqrt(area) / 2e0 / 69e0, 6) AS square_north, round(lng - sqrt(area) / 2e0 / w, 6) AS square_west, round(lat + sqrt(area / pi()) / 69e0, 6) AS circle_north, round(lng + sqrt(area / pi()) / w, 6) AS circle_east, round(lng + sqrt(area / 2e0) / w, 6) AS triangle_east FROM s""")
def i15(t: Tables) -> DataFrame:
    """Extents of the circle, square and triangle of an area around each property."""
    area, wide = F.greatest(F.col("id") % 40, F.lit(1)).cast("double"), F.greatest(F.lit(1.0), F.cos(F.radians("lat")) * 69.0)
    half, radius, arm = F.sqrt(area) / 2, F.sqrt(area / math.pi), F.sqrt(area / 2)
    cut = lambda c, n: F.round(c, 6).alias(n)
    return t.props.select(
        "id", cut(F.col("lat") + half / 69, "square_north"), cut(F.col("lng") - half / wide, "square_west"), cut(F.col("lat") + radius / 69, "circle_north"),
        cut(F.col("lng") + radius / wide, "circle_east"), cut(F.col("lng") + arm / wide, "triangle_east"),
    )


@query("i16_project", "SELECT id, round((lng + 82.55e0) * 69 * cos(radians(34.6e0)), 6) AS x, round((lat - 34.6e0) * 69, 6) AS y FROM props")
def i16(t: Tables) -> DataFrame:
    """Miles east and north of a place."""
    return t.props.select("id", F.round((F.col("lng") + 82.55) * 69 * math.cos(math.radians(34.6)), 6).alias("x"), F.round((F.col("lat") - 34.6) * 69, 6).alias("y"))


@query("i24_leading_number", "SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE house_number END AS number, street_name AS street FROM props")
def i24(t: Tables) -> DataFrame:
    """A whole address is cut at its first blank if a number stands before it."""
    whole = F.when(F.col("id") % 3 == 0, F.col("street_name")).otherwise(F.concat_ws(" ", F.concat("house_number", F.when(F.col("id") % 3 == 1, "B").otherwise("")), "street_name"))
    parts = t.props.select("id", F.trim(whole).alias("whole")).withColumn("number", F.regexp_extract("whole", r"^(\d+)\S*\s+(.*)$", 1).try_cast("int"))
    return parts.select("id", "number", F.when(F.col("number").isNull(), F.col("whole")).otherwise(F.regexp_extract("whole", r"^(\d+)\S*\s+(.*)$", 2)).alias("street"))


@query("i34_key_names", "SELECT DISTINCT replace(replace(replace(lower(trim(event_type || '_Name Of-')), ' ', ''), '_', ''), '-', '') AS name FROM events")
def i34(t: Tables) -> DataFrame:
    return t.raw("events").select(key_name(F.concat("event_type", F.lit("_Name Of-"))).alias("name")).distinct()


@query("i38_address_parts", "SELECT id, house_number || ' ' || street_name AS street, city, state, CASE WHEN id % 2 = 0 THEN zip_code ELSE '' END AS zip FROM props")
def i38(t: Tables) -> DataFrame:
    whole = F.concat_ws(", ", F.concat_ws(" ", "house_number", "street_name"), "city", F.when(F.col("id") % 2 == 0, F.concat_ws(" ", "state", "zip_code")).otherwise(F.col("state")))
    parts = F.split(whole, ", ")
    tail = F.split(F.trim(F.array_join(F.slice(parts, 3, 9), " ")), " ")
    return t.props.select("id", F.get(parts, F.lit(0)).alias("street"), F.get(parts, F.lit(1)).alias("city"), F.get(tail, F.lit(0)).alias("state"), F.coalesce(F.get(tail, F.lit(1)), F.lit("")).alias("zip"))


@query("i40_referral_codes", "SELECT member_id, 'FK-' || upper(substr(regexp_replace(name, '[^A-Za-z]', '', 'g'), 1, 4)) || upper(substr(md5(CAST(member_id AS VARCHAR)), 1, 5)) AS code FROM members")
def i40(t: Tables) -> DataFrame:
    letters = F.upper(F.substring(F.regexp_replace("name", "[^A-Za-z]", ""), 1, 4))
    return t.members.select("member_id", F.concat(F.lit("FK-"), letters, F.upper(F.substring(F.md5(F.col("member_id").cast("string")), 1, 5))).alias("code"))


@query("i43_name_match", "SELECT member_id, CASE member_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE true END AS same FROM members")
def i43(t: Tables) -> DataFrame:
    """The same last name, and first names that share three letters or begin one another."""
    known = F.concat(F.lit("Charles "), F.lpad(F.col("member_id").cast("string"), 9, "0"))
    k = F.col("member_id") % 4
    given = F.when(k == 0, F.lower(known)).when(k == 1, F.concat(F.lit("Charlie "), F.lpad(F.col("member_id").cast("string"), 9, "0"))).when(k == 2, F.concat(F.lit("Dana "), F.lpad(F.col("member_id").cast("string"), 9, "0"))).otherwise(F.concat(F.lit("ch "), F.lpad(F.col("member_id").cast("string"), 9, "0")))
    a, b = F.split(F.lower(F.trim(known)), " "), F.split(F.lower(F.trim(given)), " ")
    first = lambda c: F.get(c, F.lit(0))
    begins = (F.substring(first(a), 1, 3) == F.substring(first(b), 1, 3)) | first(a).startswith(first(b)) | first(b).startswith(first(a))
    last = (F.element_at(a, -1) == F.element_at(b, -1)) & (F.size(a) > 1) & (F.size(b) > 1)
    return t.members.select("member_id", ((F.lower(F.trim(known)) == F.lower(F.trim(given))) | (last & begins)).alias("same"))


# Points by the weather, the day's advice, and knocking scores of senior communities by hour.
WEATHER = {"clear": 10, "cloudy": 5, "rain": -20, "snow": -30, "hot": -10, "cold": -5}
SENIOR = {
    "weekday": {10: 90, 11: 95, 12: 85, 13: 80, 14: 75, 15: 60, 17: 30, 18: 20},
    "saturday": {10: 85, 11: 90, 12: 80, 14: 70, 17: 40},
    "sunday": {12: 60, 13: 70, 14: 75, 15: 70},
}
BEST_HOURS = {"weekday": "5pm - 7pm", "saturday": "9am - 12pm", "sunday": "Consider other days"}


def day_kind(ts: Column) -> Column:
    return F.when(F.dayofweek(ts) == 1, "sunday").when(F.dayofweek(ts) == 7, "saturday").otherwise("weekday")


def _mapped(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


DAY_SQL = "CASE dayofweek(ts) WHEN 0 THEN 'sunday' WHEN 6 THEN 'saturday' ELSE 'weekday' END"


@query("i51_day_advice", f"""SELECT event_id, CASE {DAY_SQL} WHEN 'weekday' THEN '5pm - 7pm' WHEN 'saturday' THEN '9am - 12pm' ELSE 'Consider other days' END AS best,
CASE event_id % 7 WHEN 0 THEN 10 WHEN 1 THEN 5 WHEN 2 THEN -20 WHEN 3 THEN -30 WHEN 4 THEN -10 WHEN 5 THEN -5 ELSE 0 END AS weather FROM logs""")
def i51(t: Tables) -> DataFrame:
    sky = F.get(F.array(*[F.lit(x) for x in WEATHER]), (F.col("event_id") % 7).cast("int"))
    points = F.coalesce(F.when(sky.isNotNull(), F.try_element_at(_mapped(WEATHER), F.coalesce(sky, F.lit("")))), F.lit(0))
    return t.logs.select("event_id", _mapped(BEST_HOURS)[day_kind(F.col("ts"))].alias("best"), points.alias("weather"))


SENIOR_SQL = "VALUES " + ", ".join(f"('{d}', {h}, {p})" for d, hours in SENIOR.items() for h, p in hours.items())


@query("i52_senior_hours", f"WITH points(day, hour, score) AS ({SENIOR_SQL})\nSELECT event_id, coalesce(score, 0) AS score FROM logs LEFT JOIN points ON day = {DAY_SQL} AND hour = hour(ts)")
def i52(t: Tables) -> DataFrame:
    points = {f"{d}/{h}": p for d, hours in SENIOR.items() for h, p in hours.items()}
    return t.logs.select("event_id", F.coalesce(F.try_element_at(_mapped(points), F.concat_ws("/", day_kind(F.col("ts")), F.hour("ts").cast("string"))), F.lit(0)).alias("score"))


@query("i56_history", "SELECT id, n_history AS entries, CASE WHEN n_history = 0 THEN '' ELSE array_to_string(list_transform(range(greatest(n_history - 3, 0), n_history), lambda i: 'e' || i), ',') END AS latest FROM listings")
def i56(t: Tables) -> DataFrame:
    """How many entries a history has, and its last three values."""
    each = F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < F.col("n_history")), lambda i: F.struct(F.concat(F.lit("2020-"), i).alias("key"), F.concat(F.lit("e"), i).alias("value")))
    history = F.map_from_entries(each)
    values = F.map_values(history)
    return t.listings.select("id", F.size(history).alias("entries"), F.array_join(F.slice(values, F.greatest(F.size(values) - 2, F.lit(1)), F.lit(3)), ",").alias("latest"))


@query("i60_distinct_hashes", "SELECT route_id, count(DISTINCT address_hash) AS n FROM stops GROUP BY route_id")
def i60(t: Tables) -> DataFrame:
    """Of each route's list of stops, the distinct hashes."""
    lists = t.stops.groupBy("route_id").agg(F.collect_list(F.struct("pos", "address_hash")).alias("stops"))  # a route has some stops
    return lists.select("route_id", F.size(F.array_distinct(F.transform("stops", lambda s: s["address_hash"]))).cast("long").alias("n"))


@query("i61_bounded_log", "SELECT rep, event_id FROM (SELECT rep, event_id, row_number() OVER (PARTITION BY rep ORDER BY ts DESC, event_id DESC) AS r FROM logs WHERE status = 'HARD_NO') x WHERE r <= 50")
def i61(t: Tables) -> DataFrame:
    """Each rep's last fifty refusals."""
    from pyspark.sql import Window

    rank = Window.partitionBy("rep").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.logs.filter("status = 'HARD_NO'").withColumn("r", F.row_number().over(rank)).filter("r <= 50").select("rep", "event_id")


@query("c02_clamps", "SELECT event_id, least(greatest(CAST(value * 1000 AS BIGINT), 1), 100000) AS rows, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 24 + 1) * 30 END AS days FROM logs")
def c02(t: Tables) -> DataFrame:
    """A limit between one and 100,000; months as days, `all` as no bound."""
    asked = F.when(F.col("event_id") % 5 == 0, "all").otherwise((F.col("event_id") % 24 + 1).cast("string"))
    rows = F.least(F.greatest(F.round(F.col("value") * 1000).cast("long"), F.lit(1)), F.lit(100_000))
    return t.logs.select("event_id", rows.alias("rows"), (asked.try_cast("long") * 30).alias("days"))


@query("c39_pull_guards", "SELECT route_id, CASE WHEN radius > 100 THEN 'radius_too_large' WHEN pi() * radius * radius > CASE WHEN route_id % 2 = 0 THEN 350 ELSE 50 END THEN 'area_too_large' ELSE 'ok' END AS verdict FROM (SELECT route_id, CAST(route_id * route_id AS DOUBLE) / 2e0 AS radius FROM (SELECT DISTINCT route_id FROM logs) r) x")
def c39(t: Tables) -> DataFrame:
    radius = (F.col("route_id") * F.col("route_id")).cast("double") / 2.0
    most = F.when(F.col("route_id") % 2 == 0, 350).otherwise(50)
    verdict = F.when(radius > 100, "radius_too_large").when(radius * radius * math.pi > most, "area_too_large").otherwise("ok")
    return t.logs.select("route_id").distinct().select("route_id", verdict.alias("verdict"))


@query("e07_storage")
def e07(t: Tables) -> DataFrame:
    """Bytes of the orders' files, bytes a row, megabytes of ten thousand rows, and how many rows half a gibibyte holds."""
    files = t.spark.read.format("binaryFile").load(f"{t.sf_dir}/orders.parquet").select("length")
    rows = t.props.agg(F.count("*").alias("rows"))
    each = F.floor(F.col("bytes") / F.nullif(F.col("rows"), F.lit(0)) + 0.5)
    one = files.agg(F.sum("length").alias("bytes")).join(rows, F.lit(True))  # a row each
    return one.select("bytes", "rows", each.alias("bytes_a_row"), F.round(each * 10_000 / 1048576, 2).alias("mb_of_10000"), F.floor(F.lit(0.5 * 2**30) / each).alias("capacity"))


@query("e54_files_by_table")
def e54(t: Tables) -> DataFrame:
    """Files and bytes of each table's folder or file."""
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(t.sf_dir).select(F.regexp_extract("path", r"/([a-z_]+)\.parquet", 1).alias("name"), "length")
    return files.groupBy("name").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


RESEARCH = "coalesce(dom, 0) AS d, abs(date_diff('day', listed, removed)) AS dur, abs(date_diff('day', removed, last_seen)) AS gap, n_history AS h"
NEAR = lambda c: " OR ".join(f"abs({c} - {b}) <= 3" for b in (90, 180, 365))


@query("j03_research_score", f"""WITH x AS (SELECT id, {RESEARCH} FROM listings), y AS (SELECT *, CASE WHEN {NEAR('d')} OR {NEAR('dur')} THEN -99 ELSE CASE WHEN d < 30 THEN 3 ELSE 0 END + CASE WHEN dur < 45 THEN 2 ELSE 0 END + CASE WHEN gap >= 7 THEN 1 ELSE 0 END
  + CASE WHEN h = 1 THEN 1 ELSE 0 END - CASE WHEN d > 150 THEN 3 ELSE 0 END - CASE WHEN gap = 0 THEN 2 ELSE 0 END - CASE WHEN dur < 7 THEN 1 ELSE 0 END - CASE WHEN h >= 3 THEN 1 ELSE 0 END END AS score FROM x)
SELECT id, score, CASE WHEN score >= 3 THEN 'LIKELY_SOLD' WHEN score >= 1 THEN 'PROBABLY_SOLD' WHEN score >= -1 THEN 'AMBIGUOUS' WHEN score >= -3 THEN 'PROBABLY_EXPIRED' ELSE 'LIKELY_EXPIRED_WITHDRAWN' END AS label, score BETWEEN -1 AND 0 AS verify FROM y""")
def j03(t: Tables) -> DataFrame:
    dom = F.coalesce("dom", F.lit(0))
    apart = lambda a, b: F.coalesce(F.abs(F.datediff(a, b)), F.lit(0))
    score = rules.research_score(dom, apart("listed", "removed"), apart("removed", "last_seen"), F.coalesce("n_history", F.lit(0)))
    return t.listings.select("id", score.alias("score"), rules.research_label(score).alias("label"), score.between(-1, 0).alias("verify"))


LEGACY = "sale_type = 'CORPORATE'"
HASH = "house_number || ' ' || zip_code"


@query("j11_legacy_plan", f"""WITH old AS (SELECT id, {HASH} AS h, lat, lng, status, CASE WHEN id % 7 = 0 THEN NULL ELSE city END AS city FROM props WHERE {LEGACY}), held AS (SELECT id, {HASH} AS h, lat, lng, city FROM props WHERE NOT ({LEGACY})),
near AS (SELECT id, city FROM (SELECT o.id, n.city, row_number() OVER (PARTITION BY o.id ORDER BY {_miles('o.lat', 'n.lat', 'o.lng', 'n.lng')}, n.id) AS r FROM old o, held n WHERE o.city IS NULL AND {_miles('o.lat', 'n.lat', 'o.lng', 'n.lng')} < 0.5) y WHERE r = 1)
SELECT old.id, CASE WHEN old.h IN (SELECT h FROM held) THEN 'merge' ELSE 'convert' END AS action, CASE WHEN old.h IN (SELECT h FROM held) THEN NULL ELSE coalesce(old.city, near.city) END AS city,
  CASE WHEN old.h IN (SELECT h FROM held) THEN NULL WHEN status = 'REJECTED' THEN status ELSE 'UNVERIFIED' END AS status FROM old LEFT JOIN near ON near.id = old.id""")
def j11(t: Tables) -> DataFrame:
    """Records of an old import: those that a newer source has are merged away, others get the new hash, a city from the nearest record within half a mile, and count as unverified."""
    hashed = t.props.withColumn("h", F.concat_ws(" ", "house_number", "zip_code"))
    old = hashed.filter(LEGACY).withColumn("city", F.when(F.col("id") % 7 != 0, F.col("city")))
    held = hashed.filter(f"NOT ({LEGACY})")
    seen = held.select("h").distinct().withColumn("seen", F.lit(True))
    rest = old.join(seen, "h", "left")
    near = joins.nearest(rest.filter("seen IS NULL AND city IS NULL"), held.select(F.col("id").alias("near_id"), F.col("city").alias("near_city"), "lat", "lng"), 0.5, ["near_id", "near_city"]).select("id", "near_city")
    merged = F.col("seen").isNotNull()
    return rest.join(near, "id", "left").select(
        "id", F.when(merged, "merge").otherwise("convert").alias("action"), F.when(~merged, F.coalesce("city", "near_city")).alias("city"),
        F.when(merged, None).when(F.col("status") == "REJECTED", F.col("status")).otherwise("UNVERIFIED").alias("status"),
    )
