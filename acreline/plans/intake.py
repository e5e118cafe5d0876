"""Queries of what comes in and goes out: files and messages that the query writes from the tables, and reads back through the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.operators.snapshots import VersionedTable
from acreline.plans.base import AS_OF_PROPS, Tables
from acreline.plans.catalog import query
from acreline.plans.rules import NOW
from acreline.sources import portal, scratch

ADDRESS = "house_number || ' ' || street_name"


def _address() -> F.Column:
    return F.concat_ws(" ", "house_number", "street_name")


@query("a08_capped_scan", "SELECT id, price FROM props ORDER BY id LIMIT 20000")
def a08(t: Tables) -> DataFrame:
    """The first 20,000 records by id, as far as the paged reader goes."""
    return t.props.orderBy("id").limit(20_000).select("id", "price")


@query("a12_portal_csv", f"SELECT CAST(id AS VARCHAR) AS mls_id, {ADDRESS} AS address, zip_code, floor(price) AS price, sold_date, CASE WHEN sqft >= 1000 THEN sqft END AS sqft, year_built FROM props")
def a12(t: Tables) -> DataFrame:
    """Portal files with headers in quotes, a disclaimer row, money as text, empty dates and zips with zeros (A9, A11 to A13)."""
    path = scratch.folder(t.spark, "portal")
    some = t.props.select(
        F.lit("PAST SALE").alias("SALE TYPE"), F.date_format("sold_date", "MMMM-d-yyyy").alias("SOLD DATE"), _address().alias("ADDRESS"), F.col("zip_code").alias("ZIP OR POSTAL CODE"),
        F.concat(F.lit("$"), F.format_number(F.floor("price"), 0)).alias("PRICE"), F.when(F.col("sqft") >= 1000, F.col("sqft").cast("string")).alias("SQUARE FEET"),
        F.col("year_built").cast("string").alias("YEAR BUILT"), F.col("id").cast("string").alias("MLS#"),
    )
    note = t.spark.range(1).select(F.lit("In accordance with local rules, some listings are not included").alias("SALE TYPE"))
    some.unionByName(note, allowMissingColumns=True).write.option("header", True).csv(f"{path}/a/b")
    return portal.read_csv(t.spark, path).select("mls_id", "address", "zip_code", "price", "sold_date", "sqft", "year_built")


@query("a10_wrapped_json", f"SELECT {ADDRESS} AS address, price FROM props")
def a10(t: Tables) -> DataFrame:
    """JSON files of which one is an array and others wrap their records by different names."""
    path = scratch.folder(t.spark, "json")
    record = F.struct(_address().alias("addressLine1"), F.col("price").alias("lastSalePrice"))
    kinds = t.props.groupBy((F.col("id") % 5).alias("kind"), F.floor(F.col("id") / 1000).alias("file")).agg(F.to_json(F.collect_list(record)).alias("list"))
    body = F.col("list")
    for i, name in enumerate(portal.WRAPPERS):
        body = F.when(F.col("kind") == i, F.concat(F.lit(f'{{"{name}":'), F.col("list"), F.lit("}"))).otherwise(body)
    # a file of at most a thousand records each, as one line
    kinds.select(body.alias("value")).repartition(8).write.option("lineSep", "\n").text(path)
    lines = t.spark.read.text(path).select("value")
    return portal.records(lines).select(F.col("addressLine1").alias("address"), F.col("lastSalePrice").alias("price"))


@query("a15_nested_listing", f"SELECT id, price, sqft, lot_size, floor(price / sqft * 10 + 0.5) / 10 AS price_per_sqft, {ADDRESS} AS address, city, coalesce(property_type, 'Unknown') AS property_type FROM props")
def a15(t: Tables) -> DataFrame:
    wrapped = F.struct(F.struct(F.col("price").alias("value")).alias("price"), F.struct(F.col("sqft").alias("value")).alias("sqft"), "lot_size", _address().alias("address"), "city", "property_type")
    plain = F.struct("price", "sqft", F.struct(F.col("lot_size").alias("value")).alias("lot_size"), _address().alias("address"), "city", "property_type")
    body = F.when(F.col("id") % 2 == 0, F.to_json(wrapped)).otherwise(F.to_json(plain))
    return portal.parsed(t.props.select("id", body.alias("body")), "body").select("id", *portal.flat_listing(F.col("body")))


@query("a16_webhook", "SELECT id, city, price FROM props")
def a16(t: Tables) -> DataFrame:
    """Webhook bodies in three shapes."""
    from pyspark.sql import types as T

    listed = F.to_json(F.array(F.struct("id", "city", "price")))
    shapes = [("{\"results\":{\"properties\":", "}}"), ("{\"properties\":", "}"), ("{\"data\":", "}")]
    body = F.element_at(F.array(*[F.concat(F.lit(a), listed, F.lit(b)) for a, b in shapes]), (F.col("id") % 3 + 1).cast("int"))
    kind = T.StructType.fromDDL("id long, city string, price double")
    return portal.parsed(t.props.select(body.alias("body")), "body").select(F.explode(portal.unwrap_webhook(F.col("body"), kind)).alias("r")).select("r.*")


@query("a17_verification", f"SELECT id, CASE WHEN id % 8 = 7 THEN NULL ELSE CASE id % 4 WHEN 0 THEN 'SOLD' WHEN 1 THEN 'CLOSED' WHEN 2 THEN 'ACTIVE' ELSE 'PENDING' END END AS status, id % 8 <> 7 AND id % 4 < 2 AS is_sold, CASE WHEN id % 8 <> 7 THEN 'd' || id END AS sold_date, CASE WHEN id % 8 <> 7 THEN price END AS price FROM props")
def a17(t: Tables) -> DataFrame:
    """Responses with the property in seven places, its status in seven, its date and price in four; one in eight is empty."""
    k = F.col("id")

    def nested(path: str, value: F.Column) -> F.Column:
        for name in reversed(path.split(".")):
            value = F.struct(value.alias(name))
        return value

    status = F.element_at(F.array(F.lit("sold"), F.lit("Closed"), F.lit("ACTIVE"), F.lit("pending")), (k % 4 + 1).cast("int"))
    pick = lambda paths, value, by: F.element_at(F.array(*[F.regexp_replace(F.regexp_replace(F.to_json(nested(p, value)), r"^\{", ""), r"\}$", "") for p in paths]), (by % len(paths) + 1).cast("int"))
    # dates and prices stand where the status doesn't, so no name occurs twice
    parts = F.concat_ws(",", pick(portal.STATUS_PATHS[1:], status, k), pick(portal.DATE_PATHS[2:], F.concat(F.lit("d"), k), k), pick(("lastSale.salePrice", "salePrice"), F.col("price"), k))
    record = F.concat(F.lit("{"), parts, F.lit("}"))
    shapes = ['{"results":[', '{"results":{"properties":[', '{"data":{"results":[', '{"data":[', '{"properties":[', '{"property":', "[", '{"error":"none","x":']
    ends = ["]}", "]}}", "]}}", "]}", "]}", "}", "]", "}"]
    at = (k % 8 + 1).cast("int")
    body = F.concat(F.element_at(F.array(*map(F.lit, shapes)), at), record, F.element_at(F.array(*map(F.lit, ends)), at))
    return portal.verification(portal.parsed(t.props.select("id", body.alias("body")), "body"), "body")


@query("a18_address_list", f"SELECT CASE WHEN id % 2 = 0 THEN CAST(id AS INTEGER) END AS number, lower({ADDRESS}) AS address FROM props")
def a18(t: Tables) -> DataFrame:
    path = scratch.folder(t.spark, "addresses")
    line = F.when(F.col("id") % 2 == 0, F.concat_ws(" - ", F.col("id").cast("string"), _address())).otherwise(_address())
    t.props.select(F.explode(F.array(line, F.lit("  "), F.lit("no number here"))).alias("value")).write.text(path)
    return portal.read_addresses(t.spark, path)


@query("a19_route_text", f"SELECT id AS doc, {ADDRESS} AS address, city, state, zip_code AS zip FROM props")
def a19(t: Tables) -> DataFrame:
    """Stop lists of several lines: number, address, blank, age, city."""
    lines = F.array(F.lit("1"), _address(), F.lit(""), F.lit("12d"), F.concat("city", F.lit(", "), "state", F.lit(" "), "zip_code"))
    return portal.route_addresses(t.props.select(F.col("id").alias("doc"), F.posexplode(lines).alias("n", "line")))


@query("a20_boundaries", "SELECT zip_code, 'Polygon' AS kind FROM props GROUP BY 1")
def a20(t: Tables) -> DataFrame:
    path = scratch.folder(t.spark, "boundaries")
    feature = F.struct(F.create_map(F.when(F.col("zip_code") < "29620", "ZCTA5CE10").otherwise("zip"), "zip_code").alias("properties"), F.struct(F.lit("Polygon").alias("type")).alias("geometry"))
    zips = t.props.select("zip_code").distinct()  # a collection a state: some thousand zips
    zips.groupBy(F.substring("zip_code", 1, 4)).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value")).select("value").repartition(4).write.text(path)
    return portal.feature_zips(t.spark, path).distinct()


@query("a21_counties", "SELECT state, array_to_string(list_sort(list(DISTINCT city)), '|') AS names FROM props GROUP BY state")
def a21(t: Tables) -> DataFrame:
    written = t.props.select("state", "city").distinct().groupBy("state").agg(F.array_join(F.transform(F.collect_list("city"), lambda c: F.concat(c, F.lit(" County"))), ", ").alias("text"))
    return written.select("state", F.array_join(F.array_sort(portal.county_list(F.col("text"))), "|").alias("names"))


@query("a24_synthetic_county", "SELECT CAST(i AS BIGINT) AS id, 100 + i * 7 % 900 AS house_number, 200000 + i * 7919 % 300000 AS price, i % 10 < 3 AS recent FROM (SELECT unnest(range(500)) AS i) x")
def a24(t: Tables) -> DataFrame:
    """A made-up county of 500 rows, from arithmetic alone."""
    i = F.col("id")
    return t.spark.range(500).select("id", (100 + i * 7 % 900).alias("house_number"), (200_000 + i * 7919 % 300_000).alias("price"), (i % 10 < 3).alias("recent"))


@query("a25_agent_csv", f"SELECT {ADDRESS} AS address, zip_code, CAST(id % 100 AS DOUBLE) AS smart_score FROM props WHERE state = 'SC' AND zip_code IN ('29602', '29608', '29614') AND id % 100 >= 40")
def a25(t: Tables) -> DataFrame:
    path = scratch.folder(t.spark, "agent")
    some = t.props.select(_address().alias("PROPERTY_ADDRESS"), F.col("state").alias("State"), F.col("zip_code").alias("ZipCode"), F.col("lat").alias("LATITUDE"), F.col("lng").alias("Lng"), (F.col("id") % 100).alias("SMART_SCORE"))
    some.write.option("header", True).csv(path)
    raw = t.spark.read.option("header", True).csv(path)
    return portal.agent_rows(raw, ["29602", "29608", "29614"], "SC", 40).select("address", "zip_code", "smart_score")


@query("b08_insert_absent", "SELECT id FROM props WHERE id % 2 = 0 OR status = 'SOLD'")
def b08(t: Tables) -> DataFrame:
    """Sales are added to the even half where they aren't there yet."""
    held = t.props.filter("id % 2 = 0").select("id")
    return held.unionByName(t.props.filter("status = 'SOLD'").select("id").join(held, "id", "left_anti"))


@query("b09_metrics", "SELECT 'logs' AS name, count(*) AS n FROM logs UNION ALL SELECT 'props', count(*) FROM props")
def b09(t: Tables) -> DataFrame:
    """Each run appends a row of counts to a table."""
    path = scratch.folder(t.spark, "metrics")
    for name, rows in (("logs", t.logs), ("props", t.props)):
        rows.agg(F.lit(name).alias("name"), F.count("*").alias("n")).write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


@query("b12_import", f"SELECT id, {ADDRESS} AS full_address, 'csv_import' AS data_source, CASE WHEN sold_date IS NULL THEN 'UNVERIFIED' ELSE 'ELIGIBLE' END AS original_status FROM props WHERE lat IS NOT NULL AND lng IS NOT NULL")
def b12(t: Tables) -> DataFrame:
    return t.props.filter("lat IS NOT NULL AND lng IS NOT NULL").select("id", _address().alias("full_address"), F.lit("csv_import").alias("data_source"), F.when(F.col("sold_date").isNull(), "UNVERIFIED").otherwise("ELIGIBLE").alias("original_status"))


@query("b13_backup", "SELECT 'listings' AS name, count(*) AS n FROM listings UNION ALL SELECT 'logs', count(*) FROM logs UNION ALL SELECT 'members', count(*) FROM members UNION ALL SELECT 'props', count(*) FROM props")
def b13(t: Tables) -> DataFrame:
    """Four datasets as JSON files, and how many records each backup holds."""
    path, out = scratch.folder(t.spark, "backup"), None
    for name, rows in (("listings", t.listings), ("logs", t.logs), ("members", t.members), ("props", t.props)):
        rows.write.option("compression", "gzip").json(f"{path}/{name}")
        one = t.spark.read.text(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("b15_by_state", "SELECT state, count(*) AS n, max(price) AS high FROM props GROUP BY state")
def b15(t: Tables) -> DataFrame:
    """Files by state, one folder each, and what they hold."""
    path = scratch.folder(t.spark, "states")
    t.props.select("id", "price", "state").write.partitionBy("state").json(path)
    return t.spark.read.schema("id long, price double, state string").json(path).groupBy("state").agg(F.count("*").alias("n"), F.max("price").alias("high"))


@query("b16_summary", "SELECT city, count(*) AS properties, min(price) AS low, max(price) AS high, round(avg(price), 2) AS mean FROM props GROUP BY city")
def b16(t: Tables) -> DataFrame:
    path = scratch.folder(t.spark, "summary")
    summary = t.props.groupBy("city").agg(F.count("*").alias("properties"), F.min("price").alias("low"), F.max("price").alias("high"), F.round(F.avg("price"), 2).alias("mean"))
    summary.write.option("header", True).csv(path)
    return t.spark.read.option("header", True).schema(summary.schema).csv(path)


@query("b27_model_save", "SELECT 'heat' AS name, 2e0 AS value UNION ALL SELECT 'pqi', 1e0")
def b27(t: Tables) -> DataFrame:
    """A model's weights are saved twice; the later ones hold."""
    table = VersionedTable(t.spark, scratch.folder(t.spark, "model"))
    for heat in (1.0, 2.0):
        table.swap(t.spark.createDataFrame([("heat", heat), ("pqi", 1.0)], "name string, value double"))
    return table.read()


@query("m04_delta_plan", f"""WITH prior AS (SELECT zip_code, count(*) AS records, max(sold_date) AS mark, bool_or(status = 'MLS_PENDING') AS stale FROM props WHERE status <> 'REJECTED' GROUP BY zip_code)
SELECT zip_code, CASE WHEN mark < {NOW} - INTERVAL 90 DAY THEN 'full_refresh' WHEN records < 50 THEN 'full_refresh' WHEN stale THEN 'full_refresh' ELSE 'delta_refresh' END AS mode, mark FROM prior""")
def m04(t: Tables) -> DataFrame:
    """How each area is pulled next: only what changed if the pull before is recent, of 50 records or more, and no drift is known."""
    prior = t.props.filter("status <> 'REJECTED'").groupBy("zip_code").agg(F.count("*").alias("records"), F.max("sold_date").alias("mark"), F.bool_or(F.col("status") == "MLS_PENDING").alias("stale"))
    recent = F.col("mark") >= F.expr(f"timestamp'{AS_OF_PROPS}' - INTERVAL 90 DAYS")
    return prior.select("zip_code", F.when(recent & (F.col("records") >= 50) & ~F.col("stale"), "delta_refresh").otherwise("full_refresh").alias("mode"), "mark")


@query("m11_cancel_resume", "SELECT rep, CASE last WHEN 'HARD_NO' THEN CASE WHEN latest >= TIMESTAMP '2024-01-31' - INTERVAL 6 HOUR THEN 'resume' ELSE 'expired' END WHEN 'CALLBACK' THEN 'cancelled' ELSE 'done' END AS state FROM (SELECT rep, arg_max(status, (ts, event_id)) AS last, max(ts) AS latest FROM logs GROUP BY rep) x")
def m11(t: Tables) -> DataFrame:
    """A job that failed in the last six hours is taken up again, a running one is cancelled."""
    jobs = t.logs.groupBy("rep").agg(F.max_by("status", F.struct("ts", "event_id")).alias("last"), F.max("ts").alias("at"))
    late = F.col("at") >= F.expr("timestamp'2024-01-31' - INTERVAL 6 HOURS")
    return jobs.select("rep", F.when((F.col("last") == "HARD_NO") & late, "resume").when(F.col("last") == "HARD_NO", "expired").when(F.col("last") == "CALLBACK", "cancelled").otherwise("done").alias("state"))


@query("m14_verification_queue", f"""WITH answers AS (SELECT pid, arg_max(status, (ts, event_id)) AS result FROM logs GROUP BY pid)
SELECT id, CASE WHEN result = 'SOLD' THEN 'confirmed' WHEN result IN ('HARD_NO', 'QUALIFIED') THEN 'rejected' WHEN sold_date < {NOW} - INTERVAL 30 DAY THEN 'check again' ELSE 'waiting' END AS outcome FROM props LEFT JOIN answers ON pid = id WHERE status = 'MLS_PENDING'""")
def m14(t: Tables) -> DataFrame:
    """Pending properties meet the answers that came for them; those without one for 30 days are asked again."""
    answers = t.logs.groupBy("pid").agg(F.max_by("status", F.struct("ts", "event_id")).alias("result"))
    old = F.col("sold_date") < F.expr(f"timestamp'{AS_OF_PROPS}' - INTERVAL 30 DAYS")
    outcome = F.when(F.col("result") == "SOLD", "confirmed").when(F.col("result").isin("HARD_NO", "QUALIFIED"), "rejected").when(old, "check again").otherwise("waiting")
    return t.props.filter("status = 'MLS_PENDING'").join(answers, F.col("id") == F.col("pid"), "left").select("id", outcome.alias("outcome"))
