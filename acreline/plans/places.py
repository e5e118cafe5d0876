"""Queries of many polygons and of generated routes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.operators import cover, generate, routes
from acreline.plans.base import AS_OF, Tables
from acreline.plans.catalog import query
from acreline.plans.joins import ALIAS_SQL
from acreline.plans.priority import HEX, staged
from acreline.sources import layout

_FAR = ", ".join(f"arg_max(id, (lat * {math.sin(2 * math.pi * d / 32)!r}e0 + lng * {math.cos(2 * math.pi * d / 32)!r}e0, id)) AS v{d}".replace("e-", "E-").replace("E-17e0", "E-17").replace("E-16e0", "E-16") for d in range(32))
_EDGES = " UNION ALL ".join(f"SELECT zip_code, v{d} AS a, v{(d + 1) % 32} AS b FROM far" for d in range(32))


@query("d14_points_in_outlines", f"""WITH far AS (SELECT zip_code, {_FAR} FROM props GROUP BY zip_code),
ends AS ({_EDGES}),
edges AS (SELECT e.zip_code, p.lat AS la, p.lng AS na, q.lat AS lb, q.lng AS nb FROM ends e JOIN props p ON p.id = e.a JOIN props q ON q.id = e.b WHERE p.lat <> q.lat)
SELECT id, count(*) AS outlines, min(zip) AS first, max(zip) AS last, CAST(sum(CAST(zip AS BIGINT)) AS BIGINT) AS zips FROM (
  SELECT t.id, e.zip_code AS zip FROM props t JOIN edges e ON (e.la > t.lat) <> (e.lb > t.lat) AND t.lng < (e.nb - e.na) * (t.lat - e.la) / (e.lb - e.la) + e.na GROUP BY t.id, e.zip_code HAVING count(*) % 2 = 1) x GROUP BY id""")
def d14_outlines(t: Tables) -> DataFrame:
    """Every property with all zips in whose outline it lies."""
    held = cover.holding(t.props.select("id", "lat", "lng"), cover.outlines(t.props, "zip_code", "id").withColumnRenamed("zip_code", "zip"), "id", "zip")
    return held.groupBy("id").agg(F.count("*").alias("outlines"), F.min("zip").alias("first"), F.max("zip").alias("last"), F.sum(F.col("zip").cast("long")).alias("zips"))


def _generated(t: Tables) -> tuple[DataFrame, DataFrame]:
    as_of = F.lit(AS_OF).cast("timestamp")
    return generate.generate(staged(t), t.logs, "owner_id", as_of, start=(34.6, -82.55), part=4_000)


@query("l15_generated_routes")
def l15(t: Tables) -> DataFrame:
    return _generated(t)[0]


@query("l15_route_totals", f"""WITH {HEX},
cooling AS (SELECT DISTINCT street_name FROM props WHERE id IN (SELECT pid FROM logs WHERE status = 'NO_ANSWER' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND ts <= TIMESTAMP '{AS_OF}')),
once AS (SELECT *, row_number() OVER (PARTITION BY house_number, upper(trim(street_name)), zip_code ORDER BY sold_date DESC NULLS LAST, id) AS nth FROM cells),
able AS (SELECT owner_id, id, CASE es WHEN 'ELIGIBLE' THEN 160 WHEN 'CALLBACK' THEN 200 WHEN 'QUALIFIED' THEN 180 WHEN 'UNVERIFIED' THEN 140 WHEN 'NO_ANSWER' THEN 130 WHEN 'SOLD' THEN CASE WHEN sold_date IS NULL THEN 100 ELSE 120 END ELSE 100 END + CASE WHEN price > 1000000 THEN 30 ELSE 0 END AS score
  FROM once WHERE nth = 1 AND es NOT IN ('HARD_NO', 'DO_NOT_KNOCK', 'COOLDOWN') AND street_name NOT IN (SELECT street_name FROM cooling))
SELECT owner_id, count(*) AS doors, CAST(sum(score) AS BIGINT) AS score, CAST(ceil(count(*) / 50.0) AS BIGINT) AS routes, CAST(ceil(count(*) / 50.0) AS BIGINT) AS last_rank FROM able GROUP BY owner_id""")
def l15_totals(t: Tables) -> DataFrame:
    """What all generated routes of an owner hold together: every eligible door once, on as few routes as can be, ranked without a gap."""
    made, stops = _generated(t)
    per = stops.groupBy("owner_id").agg(F.count("*").alias("doors"), F.sum("score").cast("long").alias("score"))
    ranks = made.groupBy("owner_id").agg(F.count("*").alias("routes"), F.max("rank").alias("last_rank"))
    return per.join(ranks, "owner_id").select("owner_id", "doors", "score", "routes", "last_rank")


@query("l15_generated_stops")
def l15_stops(t: Tables) -> DataFrame:
    return _generated(t)[1].select("owner_id", "route", "id", "seq")


@query("l09_turn_penalty")
def l09(t: Tables) -> DataFrame:
    """Compact routes walked with sharp turns avoided: seq along each."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id").reset_index(drop=True)
        order = routes.fewer_turns(group[["lat", "lng"]].to_numpy(), np.array([34.6, -82.55]))
        return group.loc[order, ["route", "id"]].assign(seq=np.arange(1, len(order) + 1, dtype=np.int32))

    split = generate.compact(t.props, "owner_id", 100).select("id", "route").join(t.props.select("id", "lat", "lng"), "id")
    return split.groupBy("route").applyInPandas(one, "route string, id long, seq int")


@query("l05_cluster_order")
def l05(t: Tables) -> DataFrame:
    """The order in which the zips of each owner are visited, by the nearest next centre: owner_id, zip_code, nth."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("zip_code").reset_index(drop=True)
        order = routes.next_nearest(group[["lat", "lng"]].to_numpy(), np.array([34.6, -82.55]))
        return group.loc[order, ["owner_id", "zip_code"]].assign(nth=np.arange(1, len(order) + 1, dtype=np.int32))

    centers = t.props.groupBy("owner_id", "zip_code").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    return centers.groupBy("owner_id").applyInPandas(one, "owner_id long, zip_code string, nth int")


@query("l22_split_routes", "SELECT owner_id, CAST(ceil(count(*) / 25.0) AS BIGINT) AS least, count(*) AS stops FROM props GROUP BY owner_id")
def l22(t: Tables) -> DataFrame:
    """Each owner's doors cut into routes of 25 at most: as few as can be, every door on one."""
    split = generate.compact(t.props, "owner_id", 25)
    per = split.groupBy("owner_id", "route").agg(F.count("*").alias("n"))
    return per.groupBy("owner_id").agg(F.count_if(F.col("n") <= 25).alias("least"), F.sum("n").alias("stops"))


@query("b25_laid_out_join", f"SELECT l.event_id, p.id FROM {ALIAS_SQL}")
def b25(t: Tables) -> DataFrame:
    """Logs meet properties by either hash on tables bucketed by it."""
    return layout.known_logs(t.spark, layout.lay_out(t.logs, "logs"), layout.lay_out(layout.aliases(t.props), "aliases")).select("event_id", "id")


@query("b25_laid_out_lookup", "SELECT zip_code, count(*) AS n, min(price) AS low FROM props WHERE zip_code = '29607' GROUP BY zip_code")
def b25_lookup(t: Tables) -> DataFrame:
    """A lookup that reads one bucket."""
    table = t.spark.table(layout.lay_out(t.props, "properties_by_zip"))
    return table.filter("zip_code = '29607'").groupBy("zip_code").agg(F.count("*").alias("n"), F.min("price").alias("low"))
