"""Keyed snapshots: idempotent upserts over Parquet, where there is no MERGE.

A merge reads the old snapshot and the new rows once, meets them on the key, and gives the
next snapshot; swapping it in is the caller's write to a new version folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acreline.operators.ordered import keep_first


def merge(old: DataFrame, new: DataFrame, key: str, keep_old: Sequence[str] = (), changed: Column | None = None) -> DataFrame:
    """The next snapshot with `action` (inserted, updated, existed).

    On a conflict a column takes the new value if it isn't NULL, `keep_old` columns never
    do, and nothing changes where `changed` (over o.* and n.*) is not true. New rows must
    have one row a key.
    """
    columns = [c for c in old.columns if c != key]
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    is_new, is_old = F.col(f"o.{key}").isNull(), F.col(f"n.{key}").isNull()
    update = F.lit(True) if changed is None else F.coalesce(changed, F.lit(False))
    out = [F.coalesce(f"o.{key}", f"n.{key}").alias(key)]
    for c in columns:
        later = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        taken = F.col(f"o.{c}") if c in keep_old else F.when(update, F.coalesce(later, F.col(f"o.{c}"))).otherwise(F.col(f"o.{c}"))
        out.append(F.when(is_new, later).otherwise(taken).alias(c))
    action = F.when(is_new, "inserted").when(is_old | ~update, "existed").otherwise("updated")
    return both.select(*out, action.alias("action"))


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(keep_first(new.join(old, key, "left_anti"), [key], [key]).select(*old.columns))


def last_wins(old: DataFrame, new: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Union of both, the last by `order` of each key, new rows after old ones; of equal ones the greatest by the other columns."""
    both = old.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)))
    rest = [F.desc(c) for c in old.columns if c != order and c not in key]
    return keep_first(both, key, [F.desc("__src"), F.desc(order), *rest]).drop("__src")


def delete(rows: DataFrame, predicate: Column) -> DataFrame:
    return rows.filter(~F.coalesce(predicate, F.lit(False)))


def delete_random(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """All but n rows drawn by a seeded hash of the key, the same ones on every run."""
    drawn = rows.select(key).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
    return rows.join(drawn, key, "left_anti")


class VersionedTable:
    """A folder of immutable snapshot versions, and numbered pointers of which the last names the current one.

    Nothing that is in use is ever overwritten: a run that stops before its pointer is
    complete leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _pointer(self) -> tuple[int, str | None]:
        try:
            pointers = self.spark.read.schema("value string, n long").text(f"{self.path}/pointers")
            last = pointers.orderBy(F.desc("n")).limit(1).collect()
        except AnalysisException as e:  # the table has no version yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, None
        return (last[0].n, last[0].value) if last else (0, None)

    def current(self) -> str | None:
        return self._pointer()[1]

    def read(self) -> DataFrame | None:
        version = self.current()
        return self.spark.read.parquet(f"{self.path}/{version}") if version else None

    def swap(self, rows: DataFrame, version: str | None = None) -> str:
        """Write a version and point to it; a version that is already current isn't written again."""
        version = version or f"v-{uuid.uuid4().hex}"
        n, held = self._pointer()
        if held != version:
            rows.write.mode("overwrite").parquet(f"{self.path}/{version}")
            self.spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/pointers/n={n + 1}")
        return version
