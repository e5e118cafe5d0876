"""Queries over the paged record service: page scans with pushed filters, and a pull that is stopped and goes on."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from acreline.plans.base import Tables
from acreline.plans.catalog import query
from acreline.sources.records import SCHEMA, RecordSource
from acreline.sources.scratch import folder
from acreline.streaming import run
from acreline.streaming.buckets import BucketTable

CIRCLES = [(34.56, -82.6, 4.0), (34.6, -82.55, 4.0), (34.66, -82.48, 3.0)]


def _miles(lat: float, lng: float) -> str:
    x, y = f"sin((lat - {lat}e0) * pi() / 360)", f"sin((lng - {lng}e0) * pi() / 360)"
    return f"2 * 3958.8e0 * asin(sqrt({x} * {x} + cos(lat * pi() / 180) * cos({lat}e0 * pi() / 180) * {y} * {y}))"


def _source(t: Tables, **options: object) -> DataFrame:
    spark = run.session(t.spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordSource)
    return spark.read.format("records").options(fetch="acreline.sources.orders_service.fetch", table=f"{t.sf_dir}/orders.parquet", **options).load()


DATED = "FROM (SELECT props.*, o_orderdate, o_orderstatus FROM props JOIN orders ON id = o_orderkey) x"


@query("a01_deed_pages", f"SELECT id, zip_code, price FROM (SELECT *, {_miles(34.6, -82.55)} AS miles {DATED} WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '1993-06-01') y WHERE miles <= 3e0")
def a01(t: Tables) -> DataFrame:
    """A ten-mile scan of deeds of which the service only shows what the filters leave."""
    deeds = _source(t, kind="deed_records", lat=34.6, lng=-82.55, radius=10)
    return deeds.filter((F.col("miles") <= 3.0) & (F.col("sold_date") >= F.lit("1993-06-01").cast("timestamp"))).select("id", "zip_code", "price")


@query("a02_inactive_pages", f"SELECT id, sold_date {DATED.replace('props.*', 'props.* EXCLUDE (sold_date), o_orderdate AS sold_date')} WHERE o_orderstatus = 'O' AND {_miles(34.58, -82.58)} <= 5e0 AND o_orderdate >= DATE '1997-01-01'")
def a02(t: Tables) -> DataFrame:
    return _source(t, kind="listings_records", lat=34.58, lng=-82.58, radius=5, since="1997-01-01").select("id", "sold_date")


@query("a03_zip_pages", f"SELECT zip_code, count(*) AS n, sum(id) AS ids {DATED} WHERE o_orderstatus = 'F' AND zip_code IN ('29601', '29607') GROUP BY zip_code")
def a03(t: Tables) -> DataFrame:
    """Whole zips: the first page tells the number of records, the others are tasks."""
    of = lambda z: _source(t, kind="deed_records", zip=z, limit=50)
    return of("29601").unionByName(of("29607")).groupBy("zip_code").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def pull(t: Tables, table: BucketTable, checkpoint: str, batches: int | None = None, **options: object) -> int:
    """Run the pull until its end, or until `batches` batches are taken; the number of batches taken."""
    spark = run.session(t.spark)
    spark.dataSource.register(RecordSource)
    usual = {"fetch": "acreline.sources.orders_service.fetch", "table": f"{t.sf_dir}/orders.parquet", "circles": json.dumps(CIRCLES)}
    rows = spark.readStream.format("records").options(**usual | options).load()
    taken = []

    def apply(batch: DataFrame, number: int) -> None:
        if batches is not None and len(taken) >= batches:
            raise InterruptedError("stopped")
        table.apply(batch, number)
        taken.append(number)

    query = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply).start()
    try:
        query.processAllAvailable()
    except Exception:
        if batches is None:
            raise
    finally:
        query.stop()
    return len(taken)


IN_CIRCLES = " OR ".join(f"{_miles(lat, lng)} <= {r}e0" for lat, lng, r in CIRCLES)


@query("m01_resumed_pull", f"SELECT id, CASE o_orderstatus WHEN 'F' THEN 'deed_records' ELSE 'listings_records' END AS phase {DATED} WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= DATE '1995-01-01' AND ({IN_CIRCLES})")
def m01(t: Tables) -> DataFrame:
    """A pull over circles in two phases that breaks off in its second batch and is started again."""
    schema = StructType.fromDDL(SCHEMA + ", phase string")
    table = BucketTable(t.spark, folder(t.spark, "pulled"), schema, ["id"], ["phase", "miles"], keep_first=True)
    log = folder(t.spark, "pull-log")
    pull(t, table, log, 2, limit=100, since="1995-01-01")
    pull(t, table, log, limit=100, since="1995-01-01")
    return table.rows().select("id", "phase")
