"""The tables' schemas and how they are laid out: bucketed and sorted by the keys that are joined and looked up on.

A table that is laid out joins another with the same key and buckets without an exchange,
and a lookup by the key reads one bucket. What is joined by another key (an alias, a cell of
the map) has a table of its own, laid out by that key.
"""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from acreline.functions import geo
from acreline.sources.scratch import folder


@dataclasses.dataclass(frozen=True)
class Layout:
    """A table's columns as DDL, the columns it is bucketed by, and those it is sorted by in a bucket."""

    columns: str
    by: tuple[str, ...]
    sort: tuple[str, ...] = ()

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.columns)


PLACE = "lat double, lng double"
LAYOUTS = {
    "properties": Layout(
        f"address_hash string, id long, legacy_hash string, house_number int, street_name string, city string, state string, zip_code string, {PLACE}, price double, assessed double, sold_date timestamp, status string, "
        "confidence string, sale_type string, property_type string, route_active boolean, year_built int, sqft double, lot_size double, owner_id long, cust_id long", ("address_hash",), ("address_hash",)),
    "properties_by_zip": Layout(f"zip_code string, id long, address_hash string, street_name string, house_number int, {PLACE}, price double, status string, sold_date timestamp", ("zip_code",), ("zip_code", "street_name", "house_number")),
    "aliases": Layout("alias string, id long, address_hash string", ("alias",), ("alias",)),
    "logs": Layout("address_hash string, event_id long, rep long, ts timestamp, status string, route_id long", ("address_hash",), ("address_hash", "ts")),
    "properties_by_cell": Layout("cell string, id long, address_hash string", ("cell",), ("cell",)),
    "sales_by_cell": Layout("cell string, n long", ("cell",), ("cell",)),
}


def fitted(rows: DataFrame, layout: Layout) -> DataFrame:
    """The layout's columns in its types: absent ones null, others left out - what a migration does to older rows."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in layout.schema])


def lay_out(rows: DataFrame, name: str, buckets: int = 8, suffix: str | None = None) -> str:
    """Write rows as the named table in the shared folder; the name under which Spark knows it. One file a bucket."""
    layout = LAYOUTS[name]
    table = f"{name}_{suffix or uuid.uuid4().hex}"
    dealt = fitted(rows, layout).repartition(buckets, *layout.by)
    dealt.write.bucketBy(buckets, *layout.by).sortBy(*(layout.sort or layout.by)).option("path", folder(rows.sparkSession, table)).saveAsTable(table)
    return table


def aliases(props: DataFrame) -> DataFrame:
    """A row for each of a property's hashes."""
    names = F.array_distinct(F.filter(F.array("address_hash", "legacy_hash"), lambda x: x.isNotNull()))
    return props.select("id", "address_hash", F.explode(names).alias("alias"))


def cells(props: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(properties by their cell, sales by every cell they count in: their own and the eight about it)."""
    row, col = geo.cell(F.col("lat"), F.col("lng"))
    name = lambda r, c: F.concat_ws("/", r.cast("string"), c.cast("string"))
    sold = props.filter("status = 'SOLD'").groupBy(row.alias("r"), col.alias("c")).agg(F.count("*").alias("n"))
    around = sold.select("n", F.inline(geo.ring(F.col("r"), F.col("c")))).groupBy("r", "c").agg(F.sum("n").alias("n"))
    return props.select(name(row, col).alias("cell"), "id", "address_hash"), around.select(name(F.col("r"), F.col("c")).alias("cell"), "n")


def known_logs(spark: SparkSession, logs: str, alias_table: str) -> DataFrame:
    """Logs with their property's id, by either hash."""
    a = spark.table(alias_table)
    return spark.table(logs).join(a.select("alias", "id"), F.col("address_hash") == F.col("alias")).drop("alias")


def heat_counts(spark: SparkSession, by_cell: str, sales: str) -> DataFrame:
    """id, n_sales of properties with a sale in their own cell or one about it."""
    return spark.table(by_cell).join(spark.table(sales), "cell").select("id", F.col("n").alias("n_sales"))
