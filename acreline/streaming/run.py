"""Running a stream over what a folder holds: rows dealt into files in order of arrival, a session with the state store that keyed operators need, and sinks that are read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from acreline.sources.scratch import folder

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(spark: SparkSession) -> SparkSession:
    """A session of the same application with settings of its own; no setting of the caller's changes."""
    out = spark.newSession()
    out.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return out


def deal(rows: DataFrame, number: str, files: int, path: str) -> str:
    """Write the rows to a folder as `files` deliveries, one after the other: `number` (SQL) names the delivery of each row, from 0."""
    numbered = rows.withColumn("__delivery", F.expr(number))
    for i in range(files):
        numbered.filter(F.col("__delivery") == i).drop("__delivery").coalesce(1).write.mode("append").parquet(path)
    return path


def read(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    """The folder's files as a stream, the earlier delivered first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_of(spark: SparkSession, rows: DataFrame, number: str, files: int, name: str) -> DataFrame:
    return read(spark, deal(rows, number, files, folder(spark, name)), rows.schema)


def drained(rows: DataFrame, caller: SparkSession, name: str) -> DataFrame:
    """All that a stream appends until its input is used up, as a table of the caller's session."""
    out = folder(caller, name)
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(caller, f"{name}-log")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return caller.read.schema(rows.schema).parquet(out)


def through(rows: DataFrame, caller: SparkSession, name: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Hand each batch of a stream to a function until its input is used up."""
    query = rows.writeStream.option("checkpointLocation", folder(caller, f"{name}-log")).trigger(availableNow=True).foreachBatch(apply).start()
    query.awaitTermination()
