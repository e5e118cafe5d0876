"""Routes street by street: streets are summed to their centres by Spark, ordered as one small group a route, and stops follow by a window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreline.functions import text
from acreline.operators import routes

SERPENTINE_OVER, STREETS_TWO_OPT, INTRA_MOST = 500, 200, 50


def planar(points: np.ndarray) -> np.ndarray:
    """All distances in miles on the plane, longitude shrunk by the mean latitude of each pair."""
    lat, lng = points[:, 0], points[:, 1]
    x = (lng[None] - lng[:, None]) * np.cos(np.radians((lat[None] + lat[:, None]) / 2))
    return np.sqrt(x * x + (lat[None] - lat[:, None]) ** 2) * 69


def nearest_path(d: np.ndarray, start: int) -> np.ndarray:
    left = np.ones(len(d), bool)
    order = [start]
    left[start] = False
    while left.any():
        order.append(int(np.where(left, d[order[-1]], np.inf).argmin()))
        left[order[-1]] = False
    return np.array(order)


def uncrossed(d: np.ndarray, order: np.ndarray, passes: int, closed_end: bool = False) -> np.ndarray:
    """Reverse stretches after the first stop while that shortens the path; with closed_end the last stop stays too."""
    n = len(order)
    for _ in range(passes):
        better = False
        for i in range(1, n - 1):
            last = n - 1 if closed_end else n
            j = np.arange(i + 1, last)
            if not len(j):
                continue
            after = order[np.minimum(j + 1, n - 1)]
            gain = d[order[i - 1], order[i]] + d[order[j], after] - d[order[i - 1], order[j]] - np.where(j + 1 < n, d[order[i], after], 0)
            k = int(gain.argmax())
            if gain[k] > 1e-12:
                order[i : j[k] + 1] = order[i : j[k] + 1][::-1].copy()
                better = True
        if not better:
            break
    return order


def street_path(centers: np.ndarray, start: int = 0, two_opt_to: int = STREETS_TWO_OPT, passes: int = 30) -> np.ndarray:
    """Order of street centres: nearest first and uncrossed; over 500 of them row by row of a grid, back and forth."""
    if len(centers) > SERPENTINE_OVER:
        row = np.floor(centers[:, 0] / 0.01).astype(int)
        return np.lexsort((np.where(row % 2 == 0, centers[:, 1], -centers[:, 1]), row))
    d = planar(centers)
    order = nearest_path(d, start)
    return uncrossed(d, order, passes) if 4 <= len(order) <= two_opt_to else order


def centers(stops: DataFrame, route: str) -> DataFrame:
    """route, street, lat, lng, n, first: the mean place of each street's stops and its least id."""
    keyed = stops.withColumn("street", text.street_key(F.col("street_name")))
    return keyed.groupBy(route, "street").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.count("*").alias("n"), F.min("id").alias("first"))


def street_order(stops: DataFrame, route: str, sweep: bool = False) -> DataFrame:
    """route, street, nth (from 1), by the centres of streets. A sweep starts at the street of the least id, any other path at the first name."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("street")
        start = int(group["first"].to_numpy().argmin()) if sweep else 0
        order = street_path(group[["lat", "lng"]].to_numpy(), start, 1 << 30 if sweep else STREETS_TWO_OPT, 50 if sweep else 30)
        return group.iloc[order][[route, "street"]].assign(nth=np.arange(1, len(order) + 1, dtype=np.int32))

    return centers(stops, route).groupBy(route).applyInPandas(one, f"{route} {stops.schema[route].dataType.simpleString()}, street string, nth int")


def carrier_order(stops: DataFrame, route: str, sweep: bool = False) -> DataFrame:
    """stops with street, nth and seq: along ordered streets, odd numbers up and even numbers back."""
    odd = F.col("house_number") % 2 == 1
    keyed = stops.withColumn("street", text.street_key(F.col("street_name"))).join(street_order(stops, route, sweep), [route, "street"])
    along = [F.when(odd, 0).otherwise(1), F.when(odd, F.col("house_number")).otherwise(-F.col("house_number")), "id"]
    return keyed.withColumn("seq", F.row_number().over(Window.partitionBy(route).orderBy("nth", *along)))


def intra_street(stops: DataFrame, route: str) -> DataFrame:
    """route, street, id, seq: each street's walk of 4 to 50 doors, uncrossed; others as they are."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        order = np.arange(len(group))
        if 4 <= len(group) <= INTRA_MOST:
            order = uncrossed(planar(group[["lat", "lng"]].to_numpy()), order, 10)
        return group.iloc[order][[route, "street", "id"]].assign(seq=np.arange(1, len(group) + 1, dtype=np.int32))

    walk = routes.boustrophedon(stops, route).select(route, "street", "id", "lat", "lng", "seq")
    return walk.groupBy(route, "street").applyInPandas(one, f"{route} {stops.schema[route].dataType.simpleString()}, street string, id long, seq int")


def spread_seeds(points: np.ndarray, k: int, draws: np.ndarray) -> np.ndarray:
    """k-means++ seeds: each next one drawn by its squared distance from those taken; `draws` are k numbers from 0 to 1."""
    chosen = [int(draws[0] * len(points))]
    scale = np.array([1.0, 1.0])
    for r in draws[1:k]:
        scale[1] = np.cos(np.radians(points[:, 0].mean()))
        d = np.min([(((points - points[c]) * scale) ** 2).sum(axis=1) for c in chosen], axis=0)
        total = d.sum()
        at = int(r * len(points)) if total == 0 else int(np.searchsorted(np.cumsum(d), r * total))
        chosen.append(min(at, len(points) - 1))
    return points[chosen]


def weighted_clusters(points: np.ndarray, weights: np.ndarray, k: int, draws: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Lloyd's assignment with centres weighted by propensity, 0.1 at least."""
    if len(points) <= k:
        return np.arange(len(points))
    centres, own, w = spread_seeds(points, k, draws), np.full(len(points), -1), np.maximum(0.1, weights)
    scale = np.array([1.0, np.cos(np.radians(points[:, 0].mean()))])
    for _ in range(rounds):
        new = (((points[:, None] - centres[None]) * scale) ** 2).sum(axis=2).argmin(axis=1)
        if (new == own).all():
            break
        own = new
        for c in range(k):
            if (own == c).any():
                centres[c] = np.average(points[own == c], axis=0, weights=w[own == c])
    return own


def carry_clusters(stops: DataFrame, route: str, k: int, weight: str) -> DataFrame:
    """route, id, cluster."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        draws = np.random.default_rng(int(group["id"].iloc[0])).random(k)
        own = weighted_clusters(group[["lat", "lng"]].to_numpy(), group[weight].to_numpy(), k, draws)
        return group[[route, "id"]].assign(cluster=own.astype(np.int32))

    return stops.select(route, "id", "lat", "lng", weight).groupBy(route).applyInPandas(one, f"{route} {stops.schema[route].dataType.simpleString()}, id long, cluster int")


def improved_miles(stops: DataFrame, route: str, kernel, score: str | None = None) -> DataFrame:
    """route, n, before, after: miles of the nearest-first path and of what kernel(points, order, scores) makes of it."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        points = group[["lat", "lng"]].to_numpy()
        order = routes.nearest_first(points)
        after = kernel(points, order, group[score].to_numpy() if score else None)
        assert sorted(after.tolist()) == list(range(len(points)))
        return pd.DataFrame({route: [group[route].iloc[0]], "n": [len(group)], "before": [routes.path_miles(points[order])], "after": [routes.path_miles(points[after])]})

    rows = stops.select(route, "id", "lat", "lng", *([score] if score else []))
    # few bytes but much work a route: a stated number of partitions isn't merged by size
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), route)
    return dealt.groupBy(route).applyInPandas(one, f"{route} {stops.schema[route].dataType.simpleString()}, n long, before double, after double")
