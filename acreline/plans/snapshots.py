"""Queries of the B family: upserts, purges and exports, as the rows they would write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.operators import ordered, snapshots
from acreline.plans.base import AS_OF, AS_OF_PROPS, Tables
from acreline.plans.catalog import query

OLD = "SELECT id, price, sold_date, status FROM props WHERE id % 3 <> 0"
NEW = "SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE price + 1000 END AS price, CASE WHEN id % 5 = 0 THEN NULL ELSE sold_date + INTERVAL 30 DAY END AS sold_date, CASE WHEN id % 7 = 0 THEN 'SOLD' ELSE status END AS status FROM props WHERE id % 2 = 0"


def old(t: Tables) -> DataFrame:
    return t.props.filter("id % 3 <> 0").select("id", "price", "sold_date", "status")


def new(t: Tables) -> DataFrame:
    k = F.col("id")
    return t.props.filter("id % 2 = 0").select(
        "id", F.when(k % 4 != 0, F.col("price") + 1000).alias("price"), F.when(k % 5 != 0, F.expr("sold_date + INTERVAL 30 DAYS")).alias("sold_date"), F.when(k % 7 == 0, "SOLD").otherwise(F.col("status")).alias("status"),
    )


@query("b01_upsert_changed", f"""SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN n.price WHEN n.id IS NOT NULL AND (n.sold_date > o.sold_date OR n.status <> o.status) THEN coalesce(n.price, o.price) ELSE o.price END AS price,
  CASE WHEN o.id IS NULL THEN n.status WHEN n.id IS NOT NULL AND (n.sold_date > o.sold_date OR n.status <> o.status) THEN coalesce(n.status, o.status) ELSE o.status END AS status,
  CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NOT NULL AND (n.sold_date > o.sold_date OR n.status <> o.status) THEN 'updated' ELSE 'existed' END AS action FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.id = n.id""")
def b01(t: Tables) -> DataFrame:
    changed = (F.col("n.sold_date") > F.col("o.sold_date")) | (F.col("n.status") != F.col("o.status"))
    return snapshots.merge(old(t), new(t), "id", changed=changed).select("id", "price", "status", "action")


@query("b02_link_upsert", "SELECT owner_id, zip_code, arg_max(id, id) AS id FROM props GROUP BY owner_id, zip_code")
def b02(t: Tables) -> DataFrame:
    links = t.props.select("owner_id", "zip_code", "id")
    return ordered.keep_first(links, ["owner_id", "zip_code"], [F.desc("id")])


@query("b03_bulk_upsert", f"SELECT coalesce(o.id, n.id) AS id, coalesce(n.price, o.price) AS price, coalesce(n.sold_date, o.sold_date) AS sold_date FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.id = n.id")
def b03(t: Tables) -> DataFrame:
    return snapshots.merge(old(t), new(t), "id").select("id", "price", "sold_date")


@query("b04_restricted_upsert", f"SELECT coalesce(o.id, n.id) AS id, coalesce(n.price, o.price) AS price, CASE WHEN o.id IS NULL THEN n.status ELSE o.status END AS status FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.id = n.id")
def b04(t: Tables) -> DataFrame:
    return snapshots.merge(old(t), new(t), "id", keep_old=["status"]).select("id", "price", "status")


@query("b05_ingest_totals", "SELECT count(*) AS total, count(*) FILTER (price IS NOT NULL) AS inserted, count(*) FILTER (price IS NULL) AS failed FROM (" + NEW + ") n")
def b05(t: Tables) -> DataFrame:
    bad = F.col("price").isNull()
    return new(t).agg(F.count("*").alias("total"), F.count_if(~bad).alias("inserted"), F.count_if(bad).alias("failed"))


@query("b06_insert_absent", f"SELECT id, price FROM ({OLD}) o UNION ALL SELECT id, price FROM ({NEW}) n WHERE id NOT IN (SELECT id FROM ({OLD}) o)")
def b06(t: Tables) -> DataFrame:
    return snapshots.insert_absent(old(t), new(t), "id").select("id", "price")


@query("b07_split_writes", f"SELECT CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IN (SELECT pid FROM logs) THEN 'protected' ELSE 'update' END AS write, count(*) AS n FROM ({NEW}) n LEFT JOIN ({OLD}) o ON o.id = n.id GROUP BY 1")
def b07(t: Tables) -> DataFrame:
    knocked = t.logs.select(F.col("pid").alias("id")).distinct().withColumn("knocked", F.lit(True))
    joined = new(t).join(old(t).select("id", F.lit(True).alias("stored")), "id", "left").join(knocked, "id", "left")
    return joined.groupBy(F.when(F.col("stored").isNull(), "insert").when(F.col("knocked"), "protected").otherwise("update").alias("write")).agg(F.count("*").alias("n"))


@query("b10_offline_queue", f"SELECT event_id, rep, TIMESTAMP '{AS_OF}' AS synced FROM logs ORDER BY event_id LIMIT 500")
def b10(t: Tables) -> DataFrame:
    return t.logs.orderBy("event_id").limit(500).select("event_id", "rep", F.lit(AS_OF).cast("timestamp").alias("synced"))


@query("b11_history_import", "SELECT event_id, pid, status FROM logs WHERE status <> 'CALLBACK'")
def b11(t: Tables) -> DataFrame:
    return t.logs.filter("status <> 'CALLBACK'").select("event_id", "pid", "status")


@query("b14_day_export", f"""SELECT event_id AS "Log ID", rep AS "Rep", status AS "Result" FROM logs WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY""")
def b14(t: Tables) -> DataFrame:
    day = t.logs.filter(F.col("ts") >= F.expr(f"timestamp'{AS_OF}' - INTERVAL 1 DAY"))
    return day.select(F.col("event_id").alias("Log ID"), F.col("rep").alias("Rep"), F.col("status").alias("Result"))


@query("b17_route_export", "SELECT route_id, '[' || string_agg('{\"sequence\":' || pos || ',\"pid\":' || pid || '}', ',' ORDER BY pos) || ']' AS payload FROM stops GROUP BY route_id")
def b17(t: Tables) -> DataFrame:
    ordered_stops = F.array_sort(F.collect_list(F.struct(F.col("pos").alias("sequence"), "pid")))
    return t.stops.groupBy("route_id").agg(F.to_json(ordered_stops).alias("payload"))


@query("b18_cache_merge", f"SELECT id, price FROM ({NEW}) n UNION ALL SELECT id, price FROM ({OLD}) o WHERE id NOT IN (SELECT id FROM ({NEW}) n)")
def b18(t: Tables) -> DataFrame:
    return snapshots.last_wins(old(t), new(t), ["id"], "id").select("id", "price")


@query("b19_delete", "SELECT id FROM props WHERE zip_code <> '29605' AND state <> 'TX'")
def b19(t: Tables) -> DataFrame:
    return snapshots.delete(t.props, (F.col("zip_code") == "29605") | (F.col("state") == "TX")).select("id")


@query("b19_delete_random")
def b19b(t: Tables) -> DataFrame:
    """A seeded draw; the number of rows that stay is tested."""
    return snapshots.delete_random(t.props, "id", 100, 7).select("id")


@query("b20_purge_preview", "SELECT status, confidence, count(*) AS n FROM props WHERE sale_type = 'MLS' AND confidence NOT IN ('verified', 'high') GROUP BY 1, 2")
def b20(t: Tables) -> DataFrame:
    return t.props.filter("sale_type = 'MLS' AND confidence NOT IN ('verified', 'high')").groupBy("status", "confidence").agg(F.count("*").alias("n"))


@query("b21_status_patch", "SELECT id, CASE WHEN sale_type = 'MLS' AND confidence = 'REJECTED' THEN 'REJECTED' WHEN sale_type = 'MLS' THEN 'HEURISTIC_SOLD' ELSE status END AS status FROM props")
def b21(t: Tables) -> DataFrame:
    mls = F.col("sale_type") == "MLS"
    return t.props.select("id", F.when(mls & (F.col("confidence") == "REJECTED"), "REJECTED").when(mls, "HEURISTIC_SOLD").otherwise(F.col("status")).alias("status"))


@query("b22_route_pruning", f"SELECT s.route_id, string_agg(s.address_hash, ',' ORDER BY pos) AS hashes, count(*) AS house_count FROM stops s WHERE address_hash IN (SELECT address_hash FROM props WHERE sold_date >= TIMESTAMP '{AS_OF_PROPS}' - INTERVAL 12 MONTH) GROUP BY s.route_id")
def b22(t: Tables) -> DataFrame:
    kept = t.props.filter(F.col("sold_date") >= F.add_months(F.lit(AS_OF_PROPS).cast("timestamp"), -12)).select("address_hash")
    left = t.stops.join(kept, "address_hash", "left_semi").groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("pos", "address_hash"))).alias("s"))
    return left.select("route_id", F.array_join(F.transform("s", lambda x: x["address_hash"]), ",").alias("hashes"), F.size("s").cast("long").alias("house_count"))


@query("b23_unassign", "SELECT id, CASE WHEN owner_id = 7 THEN NULL ELSE owner_id END AS owner FROM props")
def b23(t: Tables) -> DataFrame:
    return t.props.select("id", F.when(F.col("owner_id") != 7, F.col("owner_id")).alias("owner"))


@query("b24_route_merge", "SELECT address_hash, min(route_id * 1000 + pos) AS first_place FROM stops WHERE route_id < 50 GROUP BY address_hash")
def b24(t: Tables) -> DataFrame:
    some = t.stops.filter("route_id < 50").withColumn("first_place", F.col("route_id") * 1000 + F.col("pos"))
    return ordered.keep_first(some, ["address_hash"], ["first_place"]).select("address_hash", "first_place")


@query("b26_restore", "SELECT id, true AS route_active FROM props WHERE owner_id = 7 AND NOT route_active")
def b26(t: Tables) -> DataFrame:
    return t.props.filter("owner_id = 7 AND NOT route_active").select("id", F.lit(True).alias("route_active"))
