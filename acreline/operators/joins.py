"""Joins that a plain equality doesn't say: aliases, order kept, cascades, ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreline.functions import geo, text


def alias_join(logs: DataFrame, props: DataFrame, key: str = "address_hash", aliases: Sequence[str] = ("address_hash", "legacy_hash")) -> DataFrame:
    """logs with the property one of whose aliases they carry: an equality on exploded aliases, never an OR."""
    names = F.array_distinct(F.filter(F.array(*[F.col(a) for a in aliases]), lambda x: x.isNotNull()))
    keyed = props.withColumn("__alias", F.explode(names)).drop(*[c for c in aliases if c == key])
    return logs.join(keyed, logs[key] == keyed["__alias"]).drop("__alias")


def in_order(keys: DataFrame, rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """One row for each requested key that exists, as often and in the order requested."""
    return keys.join(rows, key).orderBy(pos)


def cascade(keys: DataFrame, key: str, tiers: Sequence[DataFrame]) -> DataFrame:
    """Each key's row from the first tier that has it, with the tier's number."""
    found, left = None, keys
    for i, tier in enumerate(tiers):
        hit = left.join(tier, key).withColumn("tier", F.lit(i))
        found = hit if found is None else found.unionByName(hit, allowMissingColumns=True)
        left = left.join(tier, key, "left_anti")
    return found


def address_cascade(asked: DataFrame, props: DataFrame, zips: Sequence[str]) -> DataFrame:
    """asked (n, address) with step and id of the property found: by the same text, else by the hash with the first zip that has it, else by house number and a part of the street.

    The last step takes the first property's text (by id) that holds the street or is held by
    it; of the rows with one text the latest sale is taken, undated ones last. Texts are
    met by equality on text, hash or house number, a row a text.
    """
    lower = F.trim(F.lower("address"))
    want = asked.select("n", "address", lower.alias("__text"))
    order = lambda: F.struct(F.coalesce("sold_date", F.timestamp_seconds(F.lit(0))), -F.col("id"))
    key = F.trim(F.lower(F.concat_ws(" ", "house_number", "street_name")))
    per = props.withColumn("__text", key).groupBy("__text").agg(F.max_by("id", order()).alias("id"), F.min("id").alias("__first"))
    exact = want.join(per.select("__text", "id"), "__text").select("n", F.lit(1).alias("step"), "id")
    left = want.join(exact.select("n"), "n", "left_anti")

    ranked = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), text.hash_normal(F.col("address"), F.lit(z)).alias("__hash")) for i, z in enumerate(zips)])).alias("z")
    hashed = props.select(text.hash_normal(key, F.col("zip_code")).alias("__hash"), "id").groupBy("__hash").agg(F.max("id").alias("id"))  # a later row takes the hash over
    by_hash = left.select("n", ranked).select("n", "z.*").join(hashed, "__hash").groupBy("n").agg(F.min_by("id", "rank").alias("id")).select("n", F.lit(2).alias("step"), "id")
    left = left.join(by_hash.select("n"), "n", "left_anti")

    parts = lambda c: (F.regexp_extract(c, r"^(\S*) ", 1), F.regexp_extract(c, r"^\S* (.*)$", 1))
    a, b = parts("__text")
    some = per.select(a.alias("__house"), b.alias("__street"), "id", "__first").filter("__house <> ''")
    near = left.select("n", a.alias("__house"), b.alias("__part")).filter("__house <> '' AND __part <> ''").join(some, "__house")
    near = near.filter(F.expr("contains(__street, __part) OR contains(__part, __street)"))
    fuzzy = near.groupBy("n").agg(F.min_by("id", "__first").alias("id")).select("n", F.lit(3).alias("step"), "id")
    return exact.unionByName(by_hash).unionByName(fuzzy)


def promote(rows: DataFrame, confirming: DataFrame, key: str, changes: dict[str, Column]) -> DataFrame:
    """Columns changed where the key occurs among the confirming rows."""
    seen = confirming.select(key).distinct().withColumn("__seen", F.lit(True))
    joined = rows.join(seen, key, "left")
    return joined.withColumns({c: F.when(F.col("__seen"), v).otherwise(F.col(c)) for c, v in changes.items()}).drop("__seen")


#: Shares of the radius that nearest neighbours are looked for in, one after the other.
RINGS = (1 / 16, 1 / 4, 1)


def nearest(points: DataFrame, others: DataFrame, miles: float, payload: Sequence[str], key: str = "id") -> DataFrame:
    """Each point with the nearest other within `miles` (up to 64 degrees of latitude): candidates meet by grid cell, own and neighbouring ones.

    Cells are as wide as the radius looked in, so no neighbour within it is missed. A sixteenth
    of the radius comes first, and only points that found none there look farther: where others
    lie dense, cells are small, and where cells are large, others are few.
    """
    found, left = None, points.select(key, F.col("lat").alias("__lat"), F.col("lng").alias("__lng"))
    far = geo.haversine_miles(F.col("__lat"), F.col("__lng"), F.col("lat"), F.col("lng"))
    for share in RINGS:
        tall, wide = miles * share / 68.0, miles * share / 30.0
        cell = lambda lat, lng: (F.floor(F.col(lat) / tall).alias("__r"), F.floor(F.col(lng) / wide).alias("__c"))  # noqa: B023, E731
        spread = left.select(key, "__lat", "__lng", *cell("__lat", "__lng")).select(key, "__lat", "__lng", F.inline(geo.ring(F.col("__r"), F.col("__c")))).withColumnsRenamed({"r": "__r", "c": "__c"})
        held = others.select(*payload, "lat", "lng", *cell("lat", "lng"))
        near = spread.join(held, ["__r", "__c"]).withColumn("miles", far)
        near = near.filter(F.col("miles") < miles if share == 1 else F.col("miles") <= miles * share)
        best = near.groupBy(key).agg(F.min_by(F.struct("miles", *payload), F.struct("miles", *payload)).alias("best")).select(key, "best.*")
        found = best if found is None else found.unionByName(best)
        left = left.join(best, key, "left_anti")
    return found


def latest(rows: DataFrame, key: str, order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Per key the payload of its last row by `order`; partial maxima are taken before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("__last")).select(key, "__last.*")


def first_priority(pairs: DataFrame, key: str, priority: str, *ties: str) -> DataFrame:
    """The pair of least priority for each key."""
    rank = Window.partitionBy(key).orderBy(priority, *ties)
    return pairs.withColumn("__rank", F.row_number().over(rank)).filter("__rank = 1").drop("__rank")


def first_n(rows: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """Per key the first n values by `order`, joined by commas as `first`."""
    rank = Window.partitionBy(key).orderBy(order)
    some = rows.select(key, order, value, F.row_number().over(rank).alias("__rank")).filter(F.col("__rank") <= n)
    return some.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rank", value))), lambda x: x[value]), ",").alias("first"))
