"""Order-dependent clusters of sales, one group for each part of the map that no cluster can leave.

A running mean stays in the bounding box of its members, so of two sets of rows whose boxes
are farther apart than the distance of joining, neither touches the other's clusters. Rows
are reduced to the cells of a grid, the cells joined to parts until all boxes are apart, and
each part's rows go through the sequential loop alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreline.functions import geo
from acreline.operators import routes

#: Parts hold up to this latitude, where a degree of longitude is shortest.
NORTH = 70.0


def boxes(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The part of each cell: cells in touching boxes are together, boxes being those of parts as they grow."""
    own = np.arange(len(r))

    def root(i: int) -> int:
        while own[i] != i:
            own[i] = own[own[i]]
            i = int(own[i])
        return i

    at = {place: i for i, place in enumerate(zip(r.tolist(), c.tolist(), strict=True))}
    for (a, b), i in at.items():
        for step in ((0, 1), (1, -1), (1, 0), (1, 1)):
            j = at.get((a + step[0], b + step[1]))
            if j is not None:
                own[root(i)] = root(j)
    while True:
        part = np.array([root(i) for i in range(len(r))])
        ids, back = np.unique(part, return_inverse=True)
        low, high = np.full((len(ids), 2), np.iinfo(np.int64).max), np.full((len(ids), 2), np.iinfo(np.int64).min)
        place = np.stack([r, c], axis=1)
        np.minimum.at(low, back, place)
        np.maximum.at(high, back, place)
        order = np.argsort(low[:, 0], kind="stable")
        moved = False
        for x, i in enumerate(order.tolist()):
            for j in order[x + 1 :].tolist():
                if low[j, 0] > high[i, 0] + 1:
                    break
                if low[j, 1] <= high[i, 1] + 1 and low[i, 1] <= high[j, 1] + 1 and root(int(ids[i])) != root(int(ids[j])):
                    own[root(int(ids[i]))] = root(int(ids[j]))
                    moved = True
        if not moved:
            return back


def independent(rows: DataFrame, owner: str, miles: float) -> DataFrame:
    """rows with `part`: rows of an owner in different parts are over `miles` apart, and so are the boxes of the parts."""
    kind = rows.schema[owner].dataType.simpleString()
    # a cell is no smaller than the distance on either side, so cells that don't touch are farther apart
    high = miles * 1.001 / geo.MILES_A_DEGREE
    wide = high / float(np.cos(np.radians(NORTH)))
    placed = rows.withColumns({"__r": F.floor(F.col("lat") / high).cast("long"), "__c": F.floor(F.col("lng") / wide).cast("long")})

    def one(group: pd.DataFrame) -> pd.DataFrame:
        return group.assign(part=boxes(group["__r"].to_numpy(), group["__c"].to_numpy()).astype(np.int64))

    cells = placed.select(owner, "__r", "__c").distinct().groupBy(owner).applyInPandas(one, f"{owner} {kind}, __r long, __c long, part long")
    return placed.join(cells, [owner, "__r", "__c"]).drop("__r", "__c")


def first_near(points: np.ndarray, miles: float) -> np.ndarray:
    """The cluster of each point: the first whose running mean is within `miles`, else a new one."""
    centers, counts, n = np.zeros((16, 2)), np.zeros(16), 0
    own = np.zeros(len(points), np.int64)
    for i, p in enumerate(points):
        near = routes.miles(p, centers[:n]) <= miles
        c = int(near.argmax()) if near.any() else n
        if c == n:
            if n == len(counts):
                centers, counts = np.vstack([centers, np.zeros_like(centers)]), np.concatenate([counts, np.zeros_like(counts)])
            n += 1
        counts[c] += 1
        centers[c] += (p - centers[c]) / counts[c]
        own[i] = c
    return own


def sold_clusters(sales: DataFrame, owner: str, as_of: Column, days: int = 30, least_sales: int = 10, least_stops: int = 20, miles: float = 5.0) -> DataFrame:
    """owner, id, cluster (its first row's id) of the sales of the last `days`.

    Sales of low confidence and rejected ones are left out, as are owners with fewer sales
    than `least_sales` and clusters with fewer stops than `least_stops`.
    """
    kind = sales.schema[owner].dataType.simpleString()
    recent = sales.filter((F.coalesce("confidence", F.lit("")) != "low") & (F.coalesce("status", F.lit("")) != "REJECTED") & (F.col("sold_date") >= F.timestamp_add("DAY", F.lit(-days), as_of)))
    enough = recent.groupBy(owner).count().filter(F.col("count") >= least_sales).select(owner)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        own = first_near(group[["lat", "lng"]].to_numpy(), miles)
        first = group["id"].to_numpy()[np.unique(own, return_index=True)[1]]
        return group[[owner, "id"]].assign(cluster=first[own])

    parts = independent(recent.join(enough, owner, "left_semi").select(owner, "id", "lat", "lng"), owner, miles)
    found = parts.groupBy(owner, "part").applyInPandas(one, f"{owner} {kind}, id long, cluster long")
    return found.join(found.groupBy(owner, "cluster").count().filter(F.col("count") >= least_stops).drop("count"), [owner, "cluster"]).select(owner, "id", "cluster")
