"""Queries of the M family: the incremental operators in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.operators.joins import latest
from acreline.plans.base import AS_OF, AS_OF_PROPS, Tables
from acreline.plans.catalog import query


@query("m05_late_data", f"SELECT id, removed < TIMESTAMP '{AS_OF_PROPS}' - INTERVAL 30 DAY AS late FROM listings")
def m05(t: Tables) -> DataFrame:
    return t.listings.select("id", (F.col("removed") < F.expr(f"timestamp'{AS_OF_PROPS}' - INTERVAL 30 DAYS")).alias("late"))


@query("m06_state_eviction", f"SELECT id FROM props WHERE sale_type = 'MLS' AND sold_date < TIMESTAMP '{AS_OF_PROPS}' - INTERVAL 60 DAY AND address_hash NOT IN (SELECT 'H' || pid FROM logs WHERE status = 'SOLD')")
def m06(t: Tables) -> DataFrame:
    deeds = t.logs.filter("status = 'SOLD'").select(F.concat(F.lit("H"), "pid").alias("address_hash")).distinct()
    stale = t.props.filter(F.col("sold_date") < F.expr(f"timestamp'{AS_OF_PROPS}' - INTERVAL 60 DAYS")).filter("sale_type = 'MLS'")
    return stale.join(deeds, "address_hash", "left_anti").select("id")


@query("m07_deed_state", "SELECT l.id FROM listings l JOIN props p ON l.id = p.id WHERE p.sale_type = 'DEED' AND l.removed >= p.sold_date")
def m07(t: Tables) -> DataFrame:
    deeds = t.props.filter("sale_type = 'DEED'").select("id", "sold_date")
    return t.listings.join(deeds, "id").filter("removed >= sold_date").select("id")


@query("m08_seen_listings", "SELECT k, min(event_id) AS first_seen, count(*) - 1 AS skipped FROM logs GROUP BY k")
def m08(t: Tables) -> DataFrame:
    return t.logs.groupBy("k").agg(F.min("event_id").alias("first_seen"), (F.count("*") - 1).alias("skipped"))


@query("m10_watchdog", f"SELECT rep FROM logs GROUP BY rep HAVING max(ts) < TIMESTAMP '{AS_OF}' - INTERVAL 30 MINUTE")
def m10(t: Tables) -> DataFrame:
    return t.logs.groupBy("rep").agg(F.max("ts").alias("last")).filter(F.col("last") < F.expr(f"timestamp'{AS_OF}' - INTERVAL 30 MINUTES")).select("rep")


@query("m16_day_windows", "SELECT date_trunc('day', ts) AS start, status, count(*) AS n FROM logs GROUP BY 1, 2")
def m16(t: Tables) -> DataFrame:
    return t.logs.groupBy(F.window("ts", "1 day").alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")


@query("m17_staleness", f"SELECT zip_code, max(sold_date) < TIMESTAMP '{AS_OF_PROPS}' - INTERVAL 24 HOUR AS stale FROM props GROUP BY zip_code")
def m17(t: Tables) -> DataFrame:
    return t.props.groupBy("zip_code").agg((F.max("sold_date") < F.expr(f"timestamp'{AS_OF_PROPS}' - INTERVAL 24 HOURS")).alias("stale"))


@query("m18_subscriptions", "SELECT rep, CASE WHEN arg_max(status, (ts, event_id)) = 'HARD_NO' THEN 'canceled' ELSE lower(arg_max(status, (ts, event_id))) END AS state FROM logs GROUP BY rep")
def m18(t: Tables) -> DataFrame:
    last = latest(t.logs, "rep", ["ts", "event_id"], ["status"])
    return last.select("rep", F.when(F.col("status") == "HARD_NO", "canceled").otherwise(F.lower("status")).alias("state"))
