"""Generated routes: an owner's doors are split into compact routes, which are ordered door by door, measured and ranked.

The split is a k-d tree whose upper levels are cut by Spark - medians from histograms, all
parts of a level at once - and whose parts of some thousand doors are cut to the end as one
small group each. Every group after that is one route.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreline.functions import geo, text
from acreline.operators import ordered, routes, streets
from acreline.operators.priority import quick_scores
from acreline.sources.scratch import folder

#: Doors of a route, and of a part that is cut to the end in one group.
MOST, PART = 50, 20_000
BINS = 64
#: Fixed values of the generator: first stops that matter, share of best stops, extra miles allowed for them.
FRONT, BEST_SHARE, EXTRA = 22, 0.30, 0.12
TERMINAL = ("HARD_NO", "DO_NOT_KNOCK", "COOLDOWN")


def _written(rows: DataFrame, name: str) -> DataFrame:
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def parts(rows: DataFrame, owner: str, most: int = PART, each: int = 1) -> DataFrame:
    """id, owner, lat, lng, part: parts of `most` rows or so, halved at the bin of a histogram nearest the median of their wider side.

    The lower half gets a multiple of `each` rows, so that of an owner's parts one at most has a
    rest: the few rows that make it so, those next to the bin's end by place and id, change sides. A part
    whose rows all stand in one place is halved by a hash of the id and of what it was cut by before.
    """
    most = max(most, each)
    at = _written(rows.select("id", owner, "lat", "lng", F.col(owner).cast("string").alias("part")), "parts")
    while True:
        sizes = at.groupBy("part").agg(F.count("*").alias("n"), F.min("lat").alias("s"), F.max("lat").alias("n_"), F.min("lng").alias("w"), F.max("lng").alias("e"))
        wide = (F.col("e") - F.col("w")) * F.cos(F.radians((F.col("s") + F.col("n_")) / 2)) > F.col("n_") - F.col("s")
        large = sizes.filter(F.col("n") > most).select("part", "n", wide.alias("wide"), F.when(wide, F.col("w")).otherwise(F.col("s")).alias("low"), F.when(wide, F.col("e")).otherwise(F.col("n_")).alias("high"))
        large = _written(large, "large")
        if not large.limit(1).count():
            return at
        apart = F.coalesce(F.col("high") > F.col("low"), F.lit(False))
        spot = F.when(apart, F.coalesce(F.when(F.col("wide"), F.col("lng")).otherwise(F.col("lat")), "low")).otherwise(F.pmod(F.xxhash64("id", "part"), F.lit(1 << 20)).cast("double"))
        share = F.when(apart, (F.col("spot") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.col("spot") / (1 << 20))
        met = at.join(large, "part", "left").withColumn("spot", spot).withColumn("bin", F.least(F.lit(BINS - 1), F.floor(share * BINS)).cast("int"))
        # at most BINS rows a part from here
        of = Window.partitionBy("part")
        counted = met.filter("n IS NOT NULL").groupBy("part", "n", "bin").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(of.orderBy("bin")))
        counted = counted.withColumn("cut", F.least(F.min(F.when(F.col("upto") * 2 >= F.col("n"), F.col("bin"))).over(of), F.lit(BINS - 2)))
        counted = counted.withColumn("below", F.sum(F.when(F.col("bin") <= F.col("cut"), F.col("k")).otherwise(0)).over(of))
        # to the nearer multiple rows go up, or down; no half is left without rows
        rest = F.col("below") % each
        up = (F.col("below") >= each) & ((rest * 2 <= each) | (F.col("below") - rest + each >= F.col("n")))
        counted = counted.withColumn("moves", F.when(up, rest).otherwise(each - rest))
        first = F.max(F.when((F.col("bin") <= F.col("cut")) & (F.col("below") - F.col("upto") + F.col("k") >= F.col("moves")), F.col("bin")))
        last = F.min(F.when((F.col("bin") > F.col("cut")) & (F.col("upto") >= F.col("below") + F.col("moves")), F.col("bin")))
        cuts = counted.groupBy("part", "cut", "moves", up.alias("up")).agg(first.alias("first"), last.alias("last"))
        met = met.join(cuts, "part", "left")
        turned = lambda c: F.when(F.col("up"), -F.col(c)).otherwise(F.col(c))
        near = met.filter("moves > 0 AND CASE WHEN up THEN bin BETWEEN first AND cut ELSE bin BETWEEN cut + 1 AND last END").withColumn("nth", F.row_number().over(of.orderBy(turned("spot"), turned("id"))))
        edge = near.filter((F.col("nth") <= each) & (F.col("nth") == F.col("moves"))).select("part", F.struct("spot", "id").alias("edge"))
        place = F.struct("spot", "id")
        above = F.when(F.col("edge").isNull(), F.col("bin") > F.col("cut")).when(F.col("up"), place >= F.col("edge")).otherwise(place > F.col("edge"))
        half = F.when(F.col("n").isNull(), F.col("part")).otherwise(F.concat("part", F.when(above, ".1").otherwise(".0")))
        at = _written(met.join(edge, "part", "left").select("id", owner, "lat", "lng", half.alias("part")), "parts")


def leaves(lat: np.ndarray, lng: np.ndarray, most: int) -> np.ndarray:
    """The leaf of each point: halves at the median of the wider side until a leaf has no more than `most`."""
    own = np.zeros(len(lat), np.int64)
    todo, found = [(np.arange(len(lat)), -(-len(lat) // most))], 0
    while todo:
        at, k = todo.pop()
        if k <= 1:
            own[at] = found
            found += 1
            continue
        wide = np.ptp(lng[at]) * np.cos(np.radians(lat[at].mean())) > np.ptp(lat[at])
        order = at[np.lexsort((at, (lng if wide else lat)[at]))]
        first = k // 2
        cut = len(at) * first // k
        todo += [(order[cut:], k - first), (order[:cut], first)]
    return own


def compact(rows: DataFrame, owner: str, most: int = MOST, part: int = PART) -> DataFrame:
    """id, owner, route: compact routes of at most `most` rows, as few as can be, each row on one. rows: id, owner, lat, lng."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        leaf = leaves(group["lat"].to_numpy(), group["lng"].to_numpy(), most)
        return pd.DataFrame({"id": group["id"], owner: group[owner], "route": group["part"] + "/" + pd.Series(leaf, group.index).astype(str)})

    kind = rows.schema[owner].dataType.simpleString()
    return parts(rows, owner, part, most).groupBy("part").applyInPandas(one, f"id long, {owner} {kind}, route string")


def street_walk(numbers: np.ndarray, points: np.ndarray, backwards: bool) -> np.ndarray:
    """A street's doors: odd numbers up and even ones back, uncrossed where there are 4 to 50."""
    odd = numbers % 2 == 1
    order = np.lexsort((np.arange(len(numbers)), np.where(odd, numbers, -numbers), ~odd))
    order = order[::-1].copy() if backwards else order
    return streets.uncrossed(streets.planar(points), order, 10) if 4 <= len(order) <= streets.INTRA_MOST else order


def carrier_walk(points: np.ndarray, street: np.ndarray, numbers: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Order of a mail carrier: clusters by the nearest next one, in each the streets by the nearest next one, each street walked from its nearer end."""
    k = routes.clusters_of(points)
    own = routes.kmeans(points, k) if k > 1 else np.zeros(len(points), int)
    here = start if start is not None else (points.mean(axis=0) if k > 1 else None)
    left, out = sorted(set(own.tolist())), []
    while left:
        centers = np.array([points[own == c].mean(axis=0) for c in left])
        c = left.pop(int(routes.miles(here, centers).argmin()) if here is not None else 0)
        inside = np.flatnonzero(own == c)
        names = sorted(set(street[inside].tolist()))
        rows = [inside[street[inside] == n] for n in names]
        middle = np.array([points[r].mean(axis=0) for r in rows])
        first = int(routes.miles(here, middle).argmin()) if here is not None else 0
        for turn, s in enumerate(streets.street_path(middle, first).tolist()):
            walk = rows[s][street_walk(numbers[rows[s]], points[rows[s]], turn % 2 == 1)]
            if here is not None and len(walk) > 1 and routes.miles(here, points[walk[-1]]) < routes.miles(here, points[walk[0]]):
                walk = walk[::-1]
            out.append(walk)
            here = points[walk[-1]]
    return np.concatenate(out)


def front_loaded(points: np.ndarray, order: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The best-scored share of stops that come after the first ones moves up behind the start, one by one, while the path is at most EXTRA longer."""
    if len(order) <= FRONT:
        return order
    limit = routes.path_miles(points[order]) * (1 + EXTRA)
    best = set(order[np.argsort(-scores[order], kind="stable")[: int(np.ceil(len(order) * BEST_SHARE))]].tolist())
    out, place = order.tolist(), 1
    for stop in [s for s in order[FRONT:].tolist() if s in best]:
        if place >= FRONT:
            break
        moved = [s for s in out if s != stop]
        moved.insert(place, stop)
        if routes.path_miles(points[moved]) > limit:
            break
        out, place = moved, place + 1
    return np.array(out)


def eligible(rows: DataFrame, logs: DataFrame, as_of: Column, cooldown_days: int = 1) -> DataFrame:
    """Rows that a route may hold: placed, one an address (the latest sale), not on a street where nobody answered lately, not closed."""
    placed = rows.filter("lat IS NOT NULL AND lng IS NOT NULL AND lat <> 0 AND lng <> 0").filter("NOT (abs(lat) < 0.0001 AND abs(lng) < 0.0001)")
    keyed = placed.withColumns({"__street": F.upper(F.trim(F.coalesce("street_name", F.lit("")))), "__zip": text.zip5(F.col("zip_code"))})
    once = ordered.keep_first(keyed, ["house_number", "__street", "__zip"], [F.desc_nulls_last("sold_date"), "id"]).drop("__street", "__zip")
    missed = logs.filter((F.col("status") == "NO_ANSWER") & (F.col("ts") > as_of - F.make_dt_interval(F.lit(cooldown_days))) & (F.col("ts") <= as_of)).select(F.col("pid").alias("id")).distinct()
    cooling = rows.join(missed, "id", "left_semi").select("street_name").distinct()
    return once.join(cooling, "street_name", "left_anti").filter(~F.coalesce(F.col("effective_status"), F.lit("")).isin(*TERMINAL))


def walked(stops: DataFrame, owner: str, start: tuple[float, float] | None = None) -> DataFrame:
    """stops with seq (from 1) along their route's walk. stops: id, owner, route, lat, lng, street_name, house_number, score."""
    begin = np.array(start) if start is not None else None

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id").reset_index(drop=True)
        points = group[["lat", "lng"]].to_numpy()
        order = front_loaded(points, carrier_walk(points, group["street"].to_numpy(), group["house_number"].to_numpy(), begin), group["score"].to_numpy())
        return group.loc[order, [owner, "route", "id", "lat", "lng", "street", "score"]].assign(seq=np.arange(1, len(order) + 1, dtype=np.int32))

    some = stops.select(owner, "route", "id", "lat", "lng", F.coalesce(text.street_key(F.col("street_name")), F.lit("")).alias("street"), F.coalesce("house_number", F.lit(0)).cast("int").alias("house_number"), "score")
    kind = stops.schema[owner].dataType.simpleString()
    return some.groupBy("route").applyInPandas(one, f"{owner} {kind}, route string, id long, lat double, lng double, street string, score double, seq int")


def measured(stops: DataFrame, owner: str, start: tuple[float, float] | None = None, back: bool = False, longest: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(routes with their measures and rank, stops): stops after `longest` miles are cut off, `back` adds the way to the first stop.

    Ranks are an owner's, by competitiveness: of routes with the same value by name, after all
    with a higher one, so that no window holds more than an owner's equal values.
    """
    along = ordered.legs(stops.select(owner, "route", "id", "lat", "lng", "street", "score", "seq"), "route", "seq")
    if longest is not None:
        along = along.filter(F.coalesce("so_far", F.lit(0.0)) <= longest)
        along = along.withColumn("leg", F.when(F.row_number().over(Window.partitionBy("route").orderBy(F.desc("seq"))) == 1, 0.0).otherwise(F.col("leg")))
    q, r = geo.hexagon(F.col("lat"), F.col("lng"))
    dense = along.groupBy("route", q.alias("q"), r.alias("r")).agg(F.count("*").alias("n")).groupBy("route").agg(F.max("n").alias("dense"))
    ends = lambda pick: pick(F.struct("lat", "lng"), "seq")
    per = along.groupBy(owner, "route").agg(F.count("*").alias("houses"), F.countDistinct("street").alias("streets"), F.sum("leg").alias("walk"), F.sum("score").alias("total"), ends(F.min_by).alias("a"), ends(F.max_by).alias("z"))
    far = geo.haversine_miles(F.lit(start[0]), F.lit(start[1]), F.col("a.lat"), F.col("a.lng")) if start is not None else F.lit(0.0)
    home = geo.haversine_miles(F.col("z.lat"), F.col("z.lng"), F.col("a.lat"), F.col("a.lng")) if back else F.lit(0.0)
    per = per.join(dense, "route").withColumns({"miles": F.col("walk") + home, "mean": F.col("total") / F.col("houses"), "from_start": far})
    value = (F.col("mean") * 0.6 + F.col("houses") / F.greatest(F.col("miles"), F.lit(0.1)) * 100 * 0.4) * (F.least(F.lit(0.2), F.col("dense") / 10.0 * 0.2) + 1) - F.least(F.col("from_start") * 2, F.lit(20.0))
    per = per.withColumn("competitiveness", F.floor(value + 0.5).cast("long"))
    counts = per.groupBy(owner, "competitiveness").agg(F.count("*").alias("n"))
    ahead = counts.withColumn("ahead", F.sum("n").over(Window.partitionBy(owner).orderBy(F.desc("competitiveness"))) - F.col("n")).drop("n")
    among = F.row_number().over(Window.partitionBy(owner, "competitiveness").orderBy("route"))
    ranked = per.withColumn("among", among).join(ahead, [owner, "competitiveness"]).withColumn("rank", (F.col("ahead") + F.col("among")).cast("long"))
    two = lambda c: F.floor(F.col(c) * 100 + 0.5) / 100
    out = ranked.select(
        owner, "route", F.concat(F.lit("Route "), "rank").alias("name"), "rank", "houses", "streets", two("miles").alias("miles"), two("from_start").alias("from_start"),
        F.floor(F.col("total") + 0.5).cast("long").alias("score"), F.floor(F.col("mean") + 0.5).cast("long").alias("mean_score"), "competitiveness", F.lit("NOT_STARTED").alias("status"),
    )
    return out, along.select(owner, "route", "id", "seq", "leg", "score")


def generate(rows: DataFrame, logs: DataFrame, owner: str, as_of: Column, most: int = MOST, start: tuple[float, float] | None = None, back: bool = False, longest: float | None = None, cooldown_days: int = 1, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """(routes, stops) of every owner; rows are properties with effective_status."""
    scored = quick_scores(eligible(rows, logs, as_of, cooldown_days), as_of)
    split = compact(scored, owner, most, part).select("id", "route")
    stops = _written(walked(scored.join(split, "id"), owner, start), "stops")
    return measured(stops, owner, start, back, longest)
