"""Queries of the L family over areas of many stops: seeds, clusters, street order, sweeps, and each improvement alone."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.operators import generate, routes, streets
from acreline.plans.base import Tables
from acreline.plans.catalog import query


def areas(t: Tables) -> DataFrame:
    """Properties with `area`, a zip's part of one of five owners' groups."""
    return t.props.withColumn("area", F.concat_ws("/", "zip_code", (F.col("owner_id") % 5).cast("string"))).withColumn("weight", (F.col("id") % 10) / 10.0)


def compact(t: Tables, most: int = 100) -> DataFrame:
    """An owner's properties on compact routes of so many stops at most."""
    return t.props.join(generate.compact(t.props, "owner_id", most).select("id", "route"), "id")


@query("l01_spread_seeds")
def l01(t: Tables) -> DataFrame:
    """The four seeds drawn on each compact route, and how far its stops are from the nearest of them: route, nth, lat, lng, mean, farthest."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        points = group.sort_values("id")[["lat", "lng"]].to_numpy()
        seeds = streets.spread_seeds(points, 4, np.random.default_rng(int(group["id"].min())).random(4))
        far = routes.miles(points[:, None], seeds[None])
        own, near = far.argmin(axis=1), far.min(axis=1)
        of = [near[own == k] for k in range(len(seeds))]
        return pd.DataFrame({"route": group["route"].iloc[0], "nth": np.arange(1, len(seeds) + 1, dtype=np.int32), "lat": seeds[:, 0], "lng": seeds[:, 1], "mean": [x.mean() if len(x) else 0.0 for x in of], "farthest": [x.max() if len(x) else 0.0 for x in of]})

    return compact(t).select("route", "id", "lat", "lng").groupBy("route").applyInPandas(one, "route string, nth int, lat double, lng double, mean double, farthest double")


@query("l02_weighted_clusters")
def l02(t: Tables) -> DataFrame:
    return streets.carry_clusters(areas(t), "area", 4, "weight").groupBy("area", "cluster").agg(F.count("*").alias("n"))


@query("l03_cluster_detection")
def l03(t: Tables) -> DataFrame:
    """How many clusters the stops of a short route call for."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        return group[["route"]].head(1).assign(k=routes.clusters_of(group[["lat", "lng"]].to_numpy()))

    return compact(t, 20).select("route", "lat", "lng").groupBy("route").applyInPandas(one, "route string, k long")


@query("l06_two_opt")
def l06(t: Tables) -> DataFrame:
    return streets.improved_miles(compact(t), "route", lambda points, order, _: routes.two_opt(points, order))


@query("l07_relocation")
def l07(t: Tables) -> DataFrame:
    return streets.improved_miles(compact(t), "route", lambda points, order, _: routes.or_opt(points, order))


@query("l16_long_routes")
def l16_long(t: Tables) -> DataFrame:
    """Routes of up to 1,000 stops, too long for a look at all pairs, shortened over neighbour lists."""
    return streets.improved_miles(compact(t, 1_000), "route", lambda points, order, _: routes.improved(points, order))


@query("l08_front_load")
def l08(t: Tables) -> DataFrame:
    return streets.improved_miles(areas(t), "area", routes.front_load, "weight")


@query("l11_street_order")
def l11(t: Tables) -> DataFrame:
    return streets.street_order(areas(t), "area")


@query("l13_intra_street")
def l13(t: Tables) -> DataFrame:
    return streets.intra_street(areas(t), "area")


@query("l14_mail_carrier")
def l14(t: Tables) -> DataFrame:
    return streets.carrier_order(areas(t), "area").select("area", "id", "nth", "seq")


@query("l20_ordered_sweep")
def l20(t: Tables) -> DataFrame:
    return streets.carrier_order(areas(t), "area", sweep=True).select("area", "id", "nth", "seq")
