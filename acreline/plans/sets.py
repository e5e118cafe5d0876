"""Queries of the H family: set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.functions.text import pair_key
from acreline.operators import ordered
from acreline.plans.base import Tables
from acreline.plans.catalog import query


@query("h01_union_sources", "SELECT id, count(*) AS n FROM (SELECT id FROM props WHERE id % 2 = 0 UNION SELECT id FROM props WHERE id % 3 = 0 UNION SELECT id FROM listings WHERE id % 5 = 0 UNION SELECT pid FROM logs) u GROUP BY id")
def h01(t: Tables) -> DataFrame:
    parts = [t.props.filter("id % 2 = 0").select("id"), t.props.filter("id % 3 = 0").select("id"), t.listings.filter("id % 5 = 0").select("id"), t.logs.select(F.col("pid").alias("id"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().select("id", F.lit(1).cast("long").alias("n"))


@query("h02_deed_union", "SELECT id FROM props WHERE sale_type = 'DEED' UNION SELECT id FROM (SELECT id FROM props WHERE sale_type = 'MLS' EXCEPT SELECT pid FROM logs) m")
def h02(t: Tables) -> DataFrame:
    mls = t.props.filter("sale_type = 'MLS'").select("id").join(t.logs.select(F.col("pid").alias("id")).distinct(), "id", "left_anti")
    return t.props.filter("sale_type = 'DEED'").select("id").union(mls)


@query("h03_accumulated", "SELECT route_id, count(DISTINCT address_hash) AS n FROM stops GROUP BY route_id")
def h03(t: Tables) -> DataFrame:
    return t.stops.groupBy("route_id").agg(F.countDistinct("address_hash").alias("n"))


@query("h04_zip_collection", "SELECT owner_id, array_to_string(list_sort(list_distinct(list(zip_code))), ',') AS zips FROM props GROUP BY owner_id")
def h04(t: Tables) -> DataFrame:
    return t.props.groupBy("owner_id").agg(F.array_join(F.array_sort(F.collect_set("zip_code")), ",").alias("zips"))


@query("h05_array_union", "SELECT owner_id, len(list_distinct(list_concat(list(zip_code), ['29699', '29600']))) AS n FROM props GROUP BY owner_id")
def h05(t: Tables) -> DataFrame:
    return t.props.groupBy("owner_id").agg(F.size(F.array_union(F.collect_set("zip_code"), F.array(F.lit("29699"), F.lit("29600")))).cast("long").alias("n"))


@query("h06_missing", "SELECT DISTINCT pid FROM stops EXCEPT SELECT pid FROM logs")
def h06(t: Tables) -> DataFrame:
    return t.stops.select("pid").subtract(t.logs.select("pid"))


@query("h07_combined_routes", "SELECT s.route_id % 10 AS team, count(*) AS stops, floor(avg(p.price) * 10 + 0.5) / 10 AS score FROM stops s JOIN props p ON s.pid = p.id GROUP BY 1")
def h07(t: Tables) -> DataFrame:
    joined = t.stops.join(t.props.select("id", "price"), F.col("pid") == F.col("id"))
    return joined.groupBy((F.col("route_id") % 10).alias("team")).agg(F.count("*").alias("stops"), (F.floor(F.avg("price") * 10 + 0.5) / 10).alias("score"))


@query("h08_intersection", "SELECT zip_code FROM props WHERE owner_id = 7 INTERSECT SELECT zip_code FROM props WHERE owner_id IN (17, 27)")
def h08(t: Tables) -> DataFrame:
    return t.props.filter("owner_id = 7").select("zip_code").intersect(t.props.filter("owner_id IN (17, 27)").select("zip_code"))


@query("h09_first_wins_union", "SELECT id, min(source) AS source FROM (SELECT id, 0 AS source FROM props WHERE owner_id = 7 UNION ALL SELECT id, 1 FROM props WHERE zip_code = '29607' UNION ALL SELECT pid, 2 FROM logs WHERE pid < 100) u GROUP BY id")
def h09(t: Tables) -> DataFrame:
    parts = [t.props.filter("owner_id = 7").select("id"), t.props.filter("zip_code = '29607'").select("id"), t.logs.filter("pid < 100").select(F.col("pid").alias("id"))]
    tagged = [p.withColumn("source", F.lit(i)) for i, p in enumerate(parts)]
    both = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).filter("id IS NOT NULL")
    return ordered.keep_first(both, ["id"], ["source"])


@query("h10_channels", """SELECT 'team' AS kind, 'team' AS channel UNION ALL SELECT 'group', 'route_' || route_id FROM (SELECT DISTINCT route_id FROM logs) r
UNION ALL SELECT 'direct', 'dm_' || least(a.email, b.email) || '_' || greatest(a.email, b.email) FROM members a JOIN members b ON b.member_id = a.member_id + 1""")
def h10(t: Tables) -> DataFrame:
    team = t.spark.createDataFrame([("team", "team")], "kind string, channel string")
    groups = t.logs.select("route_id").distinct().select(F.lit("group").alias("kind"), F.concat(F.lit("route_"), "route_id").alias("channel"))
    a, b = t.members.select("member_id", F.col("email").alias("a")), t.members.select((F.col("member_id") - 1).alias("member_id"), F.col("email").alias("b"))
    return team.unionAll(groups).unionAll(a.join(b, "member_id").select(F.lit("direct"), pair_key(F.col("a"), F.col("b"))))
