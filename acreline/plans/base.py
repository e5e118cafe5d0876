"""The engine's roles over the driver's tables: properties, interaction log, members, route stops, listings.

Each role exists twice, as a DataFrame and as a DuckDB common table expression, from the
same integer arithmetic, so every query can be held against SQL on the same files.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Instants that everything relative is measured from.
AS_OF = "2024-01-31 00:00:00"
AS_OF_PROPS = "2001-08-02 00:00:00"

SQL = """
props AS (
  SELECT o_orderkey AS id, 'H' || o_orderkey AS address_hash, 'L' || (o_orderkey * 3) AS legacy_hash,
    CAST(1 + (o_orderkey * 7919) % 400 AS INTEGER) AS house_number,
    'Maple ' || (o_orderkey % 61) || CASE o_orderkey % 3 WHEN 0 THEN ' Avenue' WHEN 1 THEN ' Road' ELSE ' Lane' END AS street_name,
    'City' || (o_custkey % 12) AS city,
    CASE o_custkey % 6 WHEN 0 THEN 'TX' WHEN 1 THEN 'UT' WHEN 2 THEN 'SC' WHEN 3 THEN 'GA' WHEN 4 THEN 'NC' ELSE 'FL' END AS state,
    '296' || lpad(CAST(o_custkey % 40 AS VARCHAR), 2, '0') AS zip_code,
    34.5e0 + CAST((o_orderkey * 7919) % 10007 AS DOUBLE) / 10007e0 * 0.2e0 AS lat,
    -82.65e0 + CAST((o_orderkey * 104729) % 10009 AS DOUBLE) / 10009e0 * 0.2e0 AS lng,
    o_totalprice AS price,
    CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice * (0.5e0 + CAST(o_orderkey % 10 AS DOUBLE) * 0.5e0) END AS assessed,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS sold_date,
    CASE WHEN o_orderkey % 10 = 9 THEN 'REJECTED' WHEN o_orderstatus = 'F' THEN 'SOLD' WHEN o_orderstatus = 'O' THEN 'HEURISTIC_SOLD' ELSE 'MLS_PENDING' END AS status,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'verified' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'low' ELSE 'REJECTED' END AS confidence,
    CASE o_orderkey % 4 WHEN 0 THEN 'DEED' WHEN 1 THEN 'MLS' WHEN 2 THEN 'DEED_CONFIRMED' ELSE 'CORPORATE' END AS sale_type,
    CASE o_orderkey % 7 WHEN 0 THEN 'Single Family' WHEN 1 THEN 'Condo' WHEN 2 THEN 'Townhouse' WHEN 3 THEN 'Multi-Family' WHEN 4 THEN 'Commercial' WHEN 5 THEN 'Vacant Land' END AS property_type,
    o_orderkey % 11 <> 0 AS route_active,
    CAST(1950 + (o_orderkey * 37) % 51 AS INTEGER) AS year_built,
    CAST(800 + (o_orderkey * 53) % 3000 AS DOUBLE) AS sqft, CAST(2000 + (o_orderkey * 97) % 20000 AS DOUBLE) AS lot_size,
    o_custkey % 50 AS owner_id, o_custkey AS cust_id
  FROM orders),
logs AS (
  SELECT event_id, user_id AS rep, ts, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
    CASE event_type WHEN 'purchase' THEN 'SOLD' WHEN 'signup' THEN 'QUALIFIED' WHEN 'click' THEN 'CALLBACK' WHEN 'view' THEN 'NO_ANSWER' ELSE 'HARD_NO' END AS status,
    (event_id * 31 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) % 1500 AS pid,
    CASE WHEN event_id % 3 = 0 THEN 'L' || (((event_id * 31 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) % 1500) * 3)
      ELSE 'H' || ((event_id * 31 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) % 1500) END AS address_hash,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 20 AS route_id
  FROM events),
members AS (
  SELECT c_custkey AS member_id, c_name AS name, c_mktsegment AS industry, c_custkey % 2 = 0 AS auto_assign,
    'rep' || c_custkey || '@example.com' AS email, CASE WHEN c_custkey % 9 = 0 THEN 'inactive' ELSE 'active' END AS member_status
  FROM customer),
stops AS (
  SELECT l_orderkey AS route_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS pos,
    l_partkey AS pid, 'H' || l_partkey AS address_hash
  FROM lineitem),
listings AS (
  SELECT o_orderkey AS id, CASE WHEN (o_orderkey * 13) % 200 = 0 THEN NULL ELSE CAST((o_orderkey * 13) % 200 AS BIGINT) END AS dom,
    o_orderdate AS removed, o_orderdate - to_days(CAST((o_orderkey * 37) % 200 AS INTEGER)) AS listed,
    o_orderdate - to_days(CAST(o_orderkey % 9 AS INTEGER)) AS last_seen, CAST(o_orderkey % 5 AS INTEGER) AS n_history, o_totalprice AS price
  FROM orders)
"""


class Tables:
    """The roles over one folder, each built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def props(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        pick = lambda at, names, other=None: F.element_at(F.array(*[F.lit(n) for n in [*names, other]]), (at + 1).cast("int"))
        return self.raw("orders").select(
            k.alias("id"), F.concat(F.lit("H"), k).alias("address_hash"), F.concat(F.lit("L"), k * 3).alias("legacy_hash"),
            (1 + (k * 7919) % 400).cast("int").alias("house_number"),
            F.concat(F.lit("Maple "), k % 61, pick(k % 3, [" Avenue", " Road"], " Lane")).alias("street_name"),
            F.concat(F.lit("City"), c % 12).alias("city"), pick(c % 6, ["TX", "UT", "SC", "GA", "NC"], "FL").alias("state"),
            F.concat(F.lit("296"), F.lpad((c % 40).cast("string"), 2, "0")).alias("zip_code"),
            (F.lit(34.5) + (k * 7919 % 10007).cast("double") / 10007.0 * 0.2).alias("lat"), (F.lit(-82.65) + (k * 104729 % 10009).cast("double") / 10009.0 * 0.2).alias("lng"),
            F.col("o_totalprice").alias("price"), F.when(k % 13 != 0, F.col("o_totalprice") * (F.lit(0.5) + (k % 10).cast("double") * 0.5)).alias("assessed"),
            F.when(k % 17 != 0, F.col("o_orderdate").cast("timestamp")).alias("sold_date"),
            F.when(k % 10 == 9, "REJECTED").when(F.col("o_orderstatus") == "F", "SOLD").when(F.col("o_orderstatus") == "O", "HEURISTIC_SOLD").otherwise("MLS_PENDING").alias("status"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "verified").when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium")
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "low").otherwise("REJECTED").alias("confidence"),
            pick(k % 4, ["DEED", "MLS", "DEED_CONFIRMED"], "CORPORATE").alias("sale_type"),
            pick(k % 7, ["Single Family", "Condo", "Townhouse", "Multi-Family", "Commercial", "Vacant Land"]).alias("property_type"),
            (k % 11 != 0).alias("route_active"), (1950 + (k * 37) % 51).cast("int").alias("year_built"),
            (800 + (k * 53) % 3000).cast("double").alias("sqft"), (2000 + (k * 97) % 20000).cast("double").alias("lot_size"), (c % 50).alias("owner_id"), c.alias("cust_id"),
        )

    @cached_property
    def logs(self) -> DataFrame:
        e = self.raw("events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("pid", (F.col("event_id") * 31 + F.col("k")) % 1500)
        kind = F.col("event_type")
        return e.select(
            "event_id", F.col("user_id").alias("rep"), F.col("ts").cast("timestamp").alias("ts"), "value", "k",
            F.when(kind == "purchase", "SOLD").when(kind == "signup", "QUALIFIED").when(kind == "click", "CALLBACK").when(kind == "view", "NO_ANSWER").otherwise("HARD_NO").alias("status"),
            "pid", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("L"), F.col("pid") * 3)).otherwise(F.concat(F.lit("H"), F.col("pid"))).alias("address_hash"),
            (F.col("k") % 20).alias("route_id"),
        )

    @cached_property
    def members(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(
            k.alias("member_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"), (k % 2 == 0).alias("auto_assign"),
            F.concat(F.lit("rep"), k, F.lit("@example.com")).alias("email"), F.when(k % 9 == 0, "inactive").otherwise("active").alias("member_status"),
        )

    @cached_property
    def stops(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS route_id", "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS pos",
            "l_partkey AS pid", "concat('H', l_partkey) AS address_hash",
        )

    @cached_property
    def listings(self) -> DataFrame:
        k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
        back = lambda n: F.timestamp_add("DAY", (F.lit(0) - n).cast("int"), day)
        return self.raw("orders").select(
            k.alias("id"), F.nullif(k * 13 % 200, F.lit(0)).cast("long").alias("dom"), day.alias("removed"), back(k * 37 % 200).alias("listed"),
            back(k % 9).alias("last_seen"), (k % 5).cast("int").alias("n_history"), F.col("o_totalprice").alias("price"),
        )
