"""Sources read what was written; streams give what the batch queries give."""

import json

from pyspark.sql import functions as F

from acreline.operators.snapshots import VersionedTable
from acreline.plans import catalog
from acreline.sources import portal
from acreline.sources.paged import PagedSource
from acreline.streaming import log
from tests.conftest import SF


def fetch_numbers(offset, limit):
    total = 1234
    return [(i, f"{i} Oak St", float(i)) for i in range(offset, min(total, offset + limit))], total


def test_paged_source(spark):
    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged").option("fetch", "tests.test_sources_streaming.fetch_numbers").option("limit", "100").load()
    assert rows.rdd.getNumPartitions() == 13
    assert rows.agg(F.count("*"), F.sum("id")).first()[:2] == (1234, 1233 * 1234 // 2)


def test_portal_csv(spark, tmp_path):
    head = ",".join(f'"{c}"' if "," in c else c for c in portal.PORTAL)
    (tmp_path / "a.csv").write_text(head + "\n" + '"In accordance with local rules, some rows are left out"' + "\n" + 'MLS,June-17-2022,Single,1 Oak St,Pelzer,SC,02969,"$120,500",3,2,x,1500,9000,1990,12,80,,Sold,u,s,1,34.6,-82.5' + "\nMLS,,Vacant Land,2 Oak St,Pelzer,SC,29669,,,,x,,,,,,,,,,,,\n")
    rows = portal.read_csv(spark, str(tmp_path)).orderBy("address").collect()
    assert len(rows) == 2
    assert rows[0].zip_code == "02969" and rows[0].price == 120_500.0 and rows[0].sold_date.isoformat() == "2022-06-17T00:00:00"
    assert rows[1].price is None and rows[1].sold_date is None


def test_json_wrappers(spark, tmp_path):
    one = {"addressLine1": "1 Oak", "lastSalePrice": 5.0}
    for i, body in enumerate(({"properties": [one, one]}, {"data": [one]}, [one, one, one], one)):
        (tmp_path / f"{i}.json").write_text(json.dumps(body))
    assert portal.read_json(spark, str(tmp_path)).filter("addressLine1 = '1 Oak'").count() == 7


def test_address_list(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 - 12 Oak St\njunk\n14 Elm Rd\n")
    assert {(r.number, r.address) for r in portal.read_addresses(spark, str(tmp_path)).collect()} == {(1, "12 oak st"), (None, "14 elm rd")}


def _files(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartitionByRange(3, "event_id").write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), events.schema


def test_day_windows_match_the_batch(spark, tmp_path):
    path, schema = _files(spark, tmp_path)
    counts = log.day_counts(log.read(spark, path, schema), "60 days")
    q = counts.writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("select start, status, n from days").collect()}
    assert got == {(r.start, r.status, r.n) for r in catalog.queries()["m16_day_windows"](spark, SF).collect()}


def test_duplicates_and_sales_state(spark, tmp_path):
    path, schema = _files(spark, tmp_path)
    spark.read.schema(schema).parquet(path).write.mode("append").parquet(path)
    once = log.once(log.read(spark, path, schema, 10), "60 days")
    q = log.completions(once).writeStream.format("memory").queryName("sales").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.user_id: r.n for r in spark.sql("select user_id, max(n) n from sales group by user_id").collect()}
    want = {r.user_id: r["count"] for r in spark.read.parquet(f"{SF}/events.parquet").filter("event_type = 'purchase'").groupBy("user_id").count().collect()}
    assert got == want


def test_upsert_stream(spark, tmp_path):
    path, schema = _files(spark, tmp_path)
    table = VersionedTable(spark, str(tmp_path / "table"))
    q = log.upsert(log.read(spark, path, schema).select("user_id", "ts", "event_id", "status"), table, str(tmp_path / "check"))
    q.awaitTermination(180)
    events = spark.read.parquet(f"{SF}/events.parquet")
    want = {r.user_id: r.last for r in events.groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last")).collect()}
    assert {r.user_id: r.ts for r in table.read().collect()} == want
