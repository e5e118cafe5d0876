"""Queries of the A family over the driver's tables: entity scans and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.operators import joins
from acreline.plans.base import Tables
from acreline.plans.catalog import query


@query("a05_candidate_scan", "SELECT id, price FROM props WHERE owner_id = 7 AND route_active AND price BETWEEN 100000 AND 400000 ORDER BY sold_date DESC NULLS LAST, id LIMIT 100")
def a05(t: Tables) -> DataFrame:
    rows = t.props.filter((F.col("owner_id") == 7) & F.col("route_active") & F.col("price").between(100_000, 400_000))
    return rows.orderBy(F.desc_nulls_last("sold_date"), "id").limit(100).select("id", "price")


@query("a06_point_lookup", "SELECT s.pos, p.id FROM stops s JOIN props p USING (address_hash) WHERE s.route_id = 3")
def a06(t: Tables) -> DataFrame:
    return joins.in_order(t.stops.filter("route_id = 3"), t.props.select("address_hash", "id"), "address_hash").select("pos", "id")


@query("a07_entity_scan", "SELECT id FROM props WHERE property_type IS NOT DISTINCT FROM NULL AND state IN ('SC', 'GA') ORDER BY price DESC, id LIMIT 25")
def a07(t: Tables) -> DataFrame:
    return t.props.filter(F.col("property_type").eqNullSafe(F.lit(None)) & F.col("state").isin("SC", "GA")).orderBy(F.desc("price"), "id").limit(25).select("id")


@query("a23_year_histogram", "SELECT CAST(year(o_orderdate) AS INTEGER) AS sold_year, count(*) AS n FROM orders WHERE o_orderpriority LIKE '%HIGH%' OR o_orderstatus LIKE '%HIGH%' GROUP BY 1")
def a23(t: Tables) -> DataFrame:
    hit = F.exists(F.array("o_orderpriority", "o_orderstatus"), lambda c: c.contains("HIGH"))
    return t.raw("orders").filter(hit).groupBy(F.year("o_orderdate").alias("sold_year")).agg(F.count("*").alias("n"))


@query("a22_zip_ranges", "SELECT 'SC' AS state, lpad(CAST(unnest(range(29600, 29640)) AS VARCHAR), 5, '0') AS zip_code UNION ALL SELECT 'MA', lpad(CAST(unnest(range(1001, 1021)) AS VARCHAR), 5, '0')")
def a22(t: Tables) -> DataFrame:
    from acreline.sources.portal import zip_ranges

    return zip_ranges(t.spark, [("SC", 29600, 29639), ("MA", 1001, 1020)])


@query("a26_introspection", "SELECT column_name AS name FROM (DESCRIBE SELECT * FROM orders)")
def a26(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(c,) for c in t.raw("orders").columns], "name string")
