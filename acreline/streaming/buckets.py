"""A keyed table that a stream keeps up to date, rewriting only the buckets a batch touches.

Rows lie in `buckets` partitions by a hash of the key and carry the number of the batch that
last changed them. A batch is applied in two steps, each of which can be run again: what it
changes against the table is written to the feed under the batch's number and noted in the
ledger; then the touched buckets are written anew from their rows and the feed's. A batch
that is delivered again finds its number in the ledger and writes the same buckets with the
same rows; a row that is delivered again in another batch changes nothing. The feed can be
read as a stream by whoever follows the table. Rows with a null in their key are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16


class BucketTable:
    """path/table (bucket=...), path/feed (batch=...) and path/ledger; `order` says which of two rows of a key is the later."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: Sequence[str], order: Sequence[str], buckets: int = BUCKETS, keep_first: bool = False) -> None:
        self.spark, self.path, self.key, self.order, self.buckets, self.keep_first = spark, path.rstrip("/"), list(key), list(order), buckets, keep_first
        self.fields = schema.names
        self.schema = StructType([*schema.fields]).add("changed_by", "long")
        self.table, self.feed = f"{self.path}/table", f"{self.path}/feed"

    def _read(self, at: str, schema: StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(at)
        except AnalysisException as e:  # nothing is written yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def rows(self) -> DataFrame:
        return self._read(self.table, StructType([*self.schema.fields]).add("bucket", "integer"))

    def changes(self) -> DataFrame:
        """The feed as a stream: a batch's changed rows, bucket by bucket."""
        return self.spark.readStream.schema(StructType([*self.schema.fields]).add("bucket", "integer").add("batch", "long")).parquet(self.feed)

    def _noted(self, number: int) -> bool:
        return bool(self._read(f"{self.path}/ledger", StructType().add("batch", "long")).filter(F.col("batch") == number).limit(1).count())

    def _best(self, rows: DataFrame) -> DataFrame:
        """A row a key: the later by `order`, or the earlier if the first stays. Equal ones are equal rows."""
        pick = F.min if self.keep_first else F.max
        rest = [c for c in [*self.fields, "changed_by"] if c not in self.key and c not in self.order and c != "changed_by"]
        # of equal rows the one that is there already stays: its batch is the lower
        age = F.col("changed_by") if self.keep_first else -F.col("changed_by")
        best = rows.groupBy(*self.key).agg(pick(F.struct(*self.order, *rest, age.alias("__age"))).alias("__b"))
        return best.select(*[F.col(c) if c in self.key else F.col(f"__b.{c}") for c in self.fields], F.abs("__b.__age").alias("changed_by"))

    def apply(self, batch: DataFrame, number: int) -> None:
        """Take in a batch; for foreachBatch."""
        feed = f"{self.feed}/batch={number}"
        everything = StructType([*self.schema.fields]).add("bucket", "integer")
        if not self._noted(number):
            came = batch.select(*self.fields).dropna(subset=self.key).withColumn("changed_by", F.lit(number).cast("long")).withColumn("bucket", self._bucket()).persist()
            touched = [r.bucket for r in came.select("bucket").distinct().collect()]  # no more than there are buckets
            old = self.rows().filter(F.col("bucket").isin(touched)).select(*self.schema.names)
            after = self._best(old.unionByName(came.select(*self.schema.names)))
            changed = after.filter(F.col("changed_by") == number).withColumn("bucket", self._bucket())
            changed.write.mode("overwrite").partitionBy("bucket").parquet(feed)
            came.unpersist()
            self.spark.createDataFrame([(number,)], "batch long").coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")
        changed = self._read(feed, everything)
        touched = [r.bucket for r in changed.select("bucket").distinct().collect()]
        if not touched:
            return
        held = self.rows().filter(F.col("bucket").isin(touched))
        kept = held.join(changed.select(*self.key), self.key, "left_anti").select(*everything.names)
        out = kept.unionByName(changed.select(*everything.names)).repartition("bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.table)
