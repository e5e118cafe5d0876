"""Sources: portal CSV files, JSON records in their wrappings, address lists, region ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acreline.functions import text

# Columns of the portal's CSV export and the names they are read as.
PORTAL = {
    "SALE TYPE": "sale_type", "SOLD DATE": "sold_date", "PROPERTY TYPE": "property_type", "ADDRESS": "address", "CITY": "city", "STATE OR PROVINCE": "state", "ZIP OR POSTAL CODE": "zip_code",
    "PRICE": "price", "BEDS": "beds", "BATHS": "baths", "LOCATION": "location", "SQUARE FEET": "sqft", "LOT SIZE": "lot_size", "YEAR BUILT": "year_built", "DAYS ON MARKET": "days_on_market",
    "$/SQUARE FEET": "price_per_sqft", "HOA/MONTH": "hoa", "STATUS": "status", "URL": "url", "SOURCE": "source", "MLS#": "mls_id", "LATITUDE": "lat", "LONGITUDE": "lng",
}
NUMBERS = ("price", "beds", "baths", "sqft", "lot_size", "price_per_sqft", "hoa", "lat", "lng")
DATE_FORMATS = ("MMMM-d-yyyy", "yyyy-MM-dd", "M/d/yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parsed_date(c: Column) -> Column:
    """The first format that fits, NULL if none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Portal CSV files below a path; the disclaimer row, which has no address, is left out.

    All columns are read as text, so zip codes keep their zeros and nothing is inferred.
    """
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    names = {c.strip().upper().split(" (")[0]: c for c in raw.columns}
    rows = raw.select(*[(F.col(f"`{names[c]}`") if c in names else F.lit(None).cast("string")).alias(n) for c, n in PORTAL.items()])
    rows = rows.filter(F.coalesce(F.trim("address"), F.lit("")) != "")
    rows = rows.withColumns({n: text.amount(F.col(n)) if n not in ("lat", "lng") else F.expr(f"try_cast({n} AS double)") for n in NUMBERS})
    return rows.withColumns({"year_built": F.expr("try_cast(year_built AS int)"), "days_on_market": F.expr("try_cast(days_on_market AS int)"), "sold_date": parsed_date(F.col("sold_date"))})


RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("addressLine1", "city", "state", "zipCode", "propertyType", "lastSaleDate")] + [T.StructField(n, T.DoubleType()) for n in ("latitude", "longitude", "lastSalePrice", "assessedValue")])
WRAPPERS = ("properties", "data", "items", "results")


def records(bodies: DataFrame, record: T.StructType = RECORD) -> DataFrame:
    """Records of JSON bodies (value), whether bare, in an array, or under one of the usual wrapper names."""
    wrapped = F.from_json("value", T.StructType([T.StructField(w, T.ArrayType(record)) for w in WRAPPERS]))
    listed = F.from_json("value", T.ArrayType(record))
    single = F.array(F.from_json("value", record))
    bare = F.when(F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("["), listed).otherwise(single)
    return bodies.select(F.explode(F.coalesce(*[wrapped[w] for w in WRAPPERS], bare)).alias("r")).select("r.*")


def read_json(spark: SparkSession, path: str, record: T.StructType = RECORD) -> DataFrame:
    """Records of JSON files, each read as one body."""
    return records(spark.read.text(path, wholetext=True), record)


def read_addresses(spark: SparkSession, path: str) -> DataFrame:
    """(number, address) of a list with lines `n - address` or plain ones; lines without a digit are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter(F.col("line").rlike(r"\d"))
    numbered = F.regexp_extract("line", r"^(\d+)\s+-\s+(.*)$", 1)
    return lines.select(F.nullif(numbered, F.lit("")).cast("int").alias("number"), F.lower(F.when(numbered != "", F.regexp_extract("line", r"^(\d+)\s+-\s+(.*)$", 2)).otherwise(F.col("line"))).alias("address"))


def zip_ranges(spark: SparkSession, ranges: list[tuple[str, int, int]]) -> DataFrame:
    """(state, zip_code) of all codes in the given ranges."""
    rows = spark.createDataFrame(ranges, "state string, low int, high int")
    return rows.select("state", F.explode(F.sequence("low", "high")).alias("n")).select("state", F.lpad(F.col("n").cast("string"), 5, "0").alias("zip_code"))


def found(body: Column, paths: Sequence[str], kind: str = "string") -> Column:
    """The first value that stands at one of the paths of a parsed body; missing, null and empty ones are passed over."""

    def at(path: str) -> Column:
        value = F.try_variant_get(body, f"$.{path}" if path[0] != "[" else f"${path}", kind)
        return F.nullif(value, F.lit("")) if kind == "string" else F.when(~F.is_variant_null(value), value) if kind == "variant" else value

    return F.coalesce(*[at(p) for p in paths])


def parsed(rows: DataFrame, column: str) -> DataFrame:
    """rows with the JSON text of a column parsed, once a row, to a VARIANT; null where it is no JSON."""
    return rows.withColumn(column, F.try_parse_json(column))


def unwrap_webhook(payload: Column, record: T.StructType) -> Column:
    """The property list of a parsed webhook body in any of its three shapes."""
    return found(payload, ("results.properties", "properties", "data"), f"array<{record.simpleString()}>")


def value_of(record: Column, name: str) -> Column:
    """A number of a parsed record that stands there plainly or as {"value": ...}."""
    return found(record, (f"{name}.value", name)).try_cast("double")


def flat_listing(record: Column) -> list[Column]:
    """The portal's columns of a nested listing record that is parsed."""
    price, sqft = value_of(record, "price"), value_of(record, "sqft")
    plain = lambda n: F.try_variant_get(record, f"$.{n}", "string")
    per_sqft = F.when((price != 0) & (sqft > 0), F.floor(price / sqft * 10 + 0.5) / 10)
    return [price.alias("price"), sqft.alias("sqft"), value_of(record, "lot_size").alias("lot_size"), per_sqft.alias("price_per_sqft"), plain("address").alias("address"), plain("city").alias("city"), F.coalesce(plain("property_type"), F.lit("Unknown")).alias("property_type")]


# Where a verification response may hold its property, status, date and price; the first that is there counts.
RESULT_PATHS = ("results[0]", "results.properties[0]", "data.results[0]", "data[0]", "properties[0]", "property")
STATUS_PATHS = ("listing.status", "listingInfo.status", "mlsInfo.listing_status", "mls.status", "propertyInfo.listingStatus", "propertyInfo.status", "status")
DATE_PATHS = ("listing.soldDate", "lastSale.saleDate", "saleInfo.lastSaleDate", "saleDate")
PRICE_PATHS = ("listing.soldPrice", "lastSale.salePrice", "saleInfo.lastSaleAmount", "salePrice")
SOLD_WORDS = ("SOLD", "CLOSED", "SETTLED")


def verification(rows: DataFrame, response: str) -> DataFrame:
    """rows with the parsed column `response` replaced by status, is_sold, sold_date, price of a verification response in any of its shapes; nulls if it has no property."""
    inner = rows.withColumn(response, found(F.col(response), (*RESULT_PATHS, "[0]"), "variant"))
    at = F.col(response)
    status = F.upper(found(at, STATUS_PATHS))
    return inner.select(
        *[c for c in rows.columns if c != response], status.alias("status"), F.coalesce(status.isin(*SOLD_WORDS), F.lit(False)).alias("is_sold"),
        found(at, DATE_PATHS).alias("sold_date"), found(at, PRICE_PATHS).try_cast("double").alias("price"),
    )


def route_addresses(lines: DataFrame) -> DataFrame:
    """doc, address, city, state, zip of lines (doc, n, line): a line `City, ST 12345` takes the nearest of the three lines before that is no number, age or blank."""
    place = Window.partitionBy("doc").orderBy("n")
    trimmed = lines.withColumn("line", F.trim("line"))
    usable = lambda c: F.when(~c.rlike(r"^\d*[mdy]?$"), c)
    before = F.coalesce(*[usable(F.lag("line", i).over(place)) for i in (1, 2, 3)])
    city = r"^([\w\s]+),\s*(\w{2})\s+(\d{5})$"
    part = lambda i: F.regexp_extract("line", city, i)
    rows = trimmed.withColumn("address", before).filter(F.col("line").rlike(city) & F.col("address").isNotNull())
    return rows.select("doc", "address", F.trim(part(1)).alias("city"), part(2).alias("state"), part(3).alias("zip"))


# Names of columns that agents' files use.
AGENT_NAMES = {
    "address": ("Address", "PROPERTY_ADDRESS"), "city": ("City",), "state": ("State",), "zip_code": ("Zip", "ZipCode"), "lat": ("Lat", "LATITUDE"), "lng": ("Lng", "LONGITUDE"),
    "price": ("Price", "SALE_PRICE"), "smart_score": ("Score", "SMART_SCORE"), "beds": ("Beds",), "baths": ("Baths",), "sqft": ("Sqft",), "year_built": ("YearBuilt", "YEAR_BUILT"),
}


def agent_rows(raw: DataFrame, zips: list[str] | None = None, state: str | None = None, least: float = 0) -> DataFrame:
    """Rows of an agent's file under their usual names; those without address or place, of other zips or states, or scored lower are left out."""
    held = {c.lower(): c for c in raw.columns}
    pick = lambda names: F.coalesce(*[F.nullif(F.col(f"`{held[n.lower()]}`").cast("string"), F.lit("")) for n in names if n.lower() in held], F.lit(None))
    rows = raw.select(*[pick(names).alias(n) for n, names in AGENT_NAMES.items()]).withColumn("smart_score", F.coalesce(F.col("smart_score").try_cast("double"), F.lit(0.0)))
    rows = rows.filter((F.col("smart_score") >= least) & F.col("address").isNotNull() & F.col("lat").isNotNull())
    rows = rows.filter(F.col("zip_code").isin(*zips)) if zips else rows
    return rows.filter(F.col("state") == state) if state else rows


def county_list(text_: Column) -> Column:
    """The names in a comma text, without County, Parish and the like."""
    return F.transform(F.split(text_, ","), lambda c: F.trim(F.regexp_replace(F.trim(c), r"(?i)\s+(county|parish|borough|census area|municipality)$", "")))


def feature_zips(spark: SparkSession, path: str) -> DataFrame:
    """zip_code and geometry type of the features of GeoJSON files."""
    kind = T.StructType.fromDDL("features array<struct<properties:map<string,string>,geometry:struct<type:string>>>")
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)["features"]).alias("f"))
    return whole.select(F.coalesce(F.col("f.properties.ZCTA5CE10"), F.col("f.properties.zip")).alias("zip_code"), F.col("f.geometry.type").alias("kind"))
