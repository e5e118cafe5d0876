"""Queries of the L family, and of K17, K20, E45: route ordering and grouped kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreline.operators import clusters, generate, routes
from acreline.plans.base import AS_OF_PROPS, Tables
from acreline.plans.catalog import query
from acreline.plans.ordered import routed


@query("l04_cluster_counts")
def l04(t: Tables) -> DataFrame:
    """How many clusters the stops of each short route form, and their sizes."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        points = group.sort_values("id")[["lat", "lng"]].to_numpy()
        own = routes.kmeans(points, routes.clusters_of(points))
        sizes = np.bincount(own)
        return pd.DataFrame({"route": group["route"].iloc[0], "cluster": np.arange(len(sizes), dtype=np.int32), "n": sizes.astype(np.int64)})

    split = t.props.join(generate.compact(t.props, "owner_id", 20).select("id", "route"), "id")
    return split.select("route", "id", "lat", "lng").groupBy("route").applyInPandas(one, "route string, cluster int, n long")


@query("l09_nearest_order")
def l09(t: Tables) -> DataFrame:
    return routes.ordered_routes(routed(t), improve=False)


@query("l10_street_groups", "SELECT zip_code, street_name, count(*) AS n, min(house_number) AS low, max(house_number) AS high FROM props GROUP BY 1, 2")
def l10(t: Tables) -> DataFrame:
    return t.props.groupBy("zip_code", "street_name").agg(F.count("*").alias("n"), F.min("house_number").alias("low"), F.max("house_number").alias("high"))


@query("l12_boustrophedon", "SELECT id, CAST(row_number() OVER (PARTITION BY zip_code ORDER BY regexp_replace(regexp_replace(lower(street_name), '(avenue|road|lane)$', ''), '[^a-z0-9]', '', 'g'), CASE WHEN house_number % 2 = 1 THEN 0 ELSE 1 END, CASE WHEN house_number % 2 = 1 THEN house_number ELSE -house_number END, id) AS INTEGER) AS seq FROM props")
def l12(t: Tables) -> DataFrame:
    return routes.boustrophedon(t.props).select("id", "seq")


@query("l16_optimised_routes")
def l16(t: Tables) -> DataFrame:
    """Nearest first, then 2-opt and relocation; tests hold it to be a permutation that never gets longer."""
    return routes.ordered_routes(routed(t))


@query("l17_chunked_routes", "SELECT id, owner_id, (row_number() OVER (PARTITION BY owner_id ORDER BY zip_code, id) - 1) // 40 AS route FROM props")
def l17(t: Tables) -> DataFrame:
    return t.props.selectExpr("id", "owner_id", "(row_number() OVER (PARTITION BY owner_id ORDER BY zip_code, id) - 1) div 40 AS route")


@query("l18_sweep", "SELECT id FROM props WHERE (zip_code, street_name) IN (SELECT zip_code, street_name FROM props WHERE id % 97 = 0)")
def l18(t: Tables) -> DataFrame:
    return routes.sweep(t.props.filter("id % 97 = 0"), t.props).select("id")


@query("l19_sweep_route", "SELECT id, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY street_name, house_number % 2 DESC, house_number, id) AS INTEGER) AS seq FROM props")
def l19(t: Tables) -> DataFrame:
    rank = Window.partitionBy("owner_id").orderBy("street_name", F.desc(F.col("house_number") % 2), "house_number", "id")
    return t.props.select("id", F.row_number().over(rank).alias("seq"))


@query("k17_greedy_assignment")
def k17(t: Tables) -> DataFrame:
    """Each team shares its own routes among its reps: a team is an industry, and a route belongs to one of five by its number."""
    home = F.element_at(F.array(*[F.lit(x) for x in TEAMS]), (F.col("route_id") % len(TEAMS) + 1).cast("int"))
    reps = t.members.select(F.col("member_id").alias("rep"), F.col("industry").alias("team"))
    per = t.logs.groupBy("route_id", "rep").agg(F.avg("value").alias("score")).join(reps, "rep").filter(F.col("team") == home)
    return routes.greedy_assign(per)


TEAMS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("k20_threshold_clusters")
def k20(t: Tables) -> DataFrame:
    """The last month's sales of two regions of three states each."""
    region = F.when(F.col("state").isin("TX", "UT", "SC"), "west").otherwise("east")
    return clusters.sold_clusters(t.props.withColumn("region", region), "region", F.lit(AS_OF_PROPS).cast("timestamp"))


@query("e45_zip_hulls")
def e45(t: Tables) -> DataFrame:
    """Hull sizes of zips with three points or more."""
    hulls = routes.hulls(t.props, "zip_code")
    return hulls.groupBy("zip_code").agg(F.count("*").alias("vertices")).filter("vertices >= 3")
