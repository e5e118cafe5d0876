"""The interaction log as a stream: windows, dedup, keyed state and idempotent upserts.

Batch queries of the M family give the same results over the same rows; tests hold one
against the other. Event time is a TIMESTAMP, so parquet's time-zone-free one is cast at
the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from acreline.operators.ordered import keep_first
from acreline.operators.snapshots import VersionedTable

STATUS = {"purchase": "SOLD", "signup": "QUALIFIED", "click": "CALLBACK", "view": "NO_ANSWER"}


def read(spark: SparkSession, path: str, schema, files_a_batch: int = 1) -> DataFrame:
    """New files of a folder as log rows."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("event_type")]
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("status", F.coalesce(status, F.lit("HARD_NO")))


def once(rows: DataFrame, late: str = "30 days") -> DataFrame:
    """Each event once, however often it is delivered within the time that late rows are waited for."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def day_counts(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling day windows by status; rows later than the watermark are left out."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")


def completions(rows: DataFrame) -> DataFrame:
    """(user_id, n, last): a row whenever a user's log brings another sale, from state kept by user."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        last = None
        for part in batches:
            sold = part[part["status"] == "SOLD"]
            n += len(sold)
            if len(sold):
                newest = sold["ts"].max()
                last = newest if last is None else max(last, newest)
        state.update((int(n),))
        if last is not None:
            yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last": [last]})

    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, last timestamp", "n long", "update", "NoTimeout")


def upsert(rows: DataFrame, table: VersionedTable, checkpoint: str, key: str = "user_id", order: str = "ts") -> StreamingQuery:
    """Keep the last row of each key in a versioned table, of equal times the greatest by its other columns; a batch that is replayed changes nothing.

    Each batch writes a whole version; BucketTable rewrites only what a batch touches.
    """

    def apply(batch: DataFrame, number: int) -> None:
        version = f"batch-{number}"
        if table.current() == version:
            return
        old = table.read()
        # files may come in any order, so the later row by event time stays, not the later delivered
        rows = batch if old is None else old.unionByName(batch)
        rest = [F.desc(c) for c in rows.columns if c not in (key, order)]
        table.swap(keep_first(rows, [key], [F.desc(order), *rest]), version)

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()
