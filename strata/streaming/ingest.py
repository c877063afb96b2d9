"""Streams of new rows into keyed tables.

Files that arrive in a folder are read once each by a stream with a checkpoint; every batch keeps the last row of each
key and is merged into the table as a new version. A batch that is run again after a failure finds its number in the
version log and changes nothing.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType, TimestampType

from strata.operators import dataflow
from strata.runtime import scratch


class KeyedTable:
    """A table with one row for each key, in versions named by the batch that made them."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: list[str], order: str):
        self.spark, self.root, self.schema, self.key, self.order = spark, root, schema, key, order
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def last(self) -> int:
        if not self._fs.exists(self._Path(self.root)):
            return -1
        return max((int(n[6:]) for s in self._fs.listStatus(self._Path(self.root)) if (n := s.getPath().getName()).startswith("batch-") and self._fs.exists(self._Path(f"{self.root}/{n}/_SUCCESS"))), default=-1)

    def read(self) -> DataFrame:
        n = self.last()
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/batch-{n}") if n >= 0 else self.spark.createDataFrame([], self.schema)

    def merge(self, rows: DataFrame, batch: int) -> None:
        if batch <= self.last():
            return
        merged = dataflow.upsert(self.read(), rows.select(*self.schema.fieldNames()), self.key, self.order)
        merged.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.root}/batch-{batch}")


def ingest(spark: SparkSession, folder: str, target: KeyedTable, checkpoint: str, pattern: str = "*.parquet", per_batch: int = 1000) -> None:
    """Take all files that are there and weren't taken before, then stop."""
    stream = spark.readStream.schema(target.schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).parquet(folder)
    query = stream.writeStream.foreachBatch(lambda df, n: target.merge(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total): tumbling counts over event time; rows later than the watermark are dropped by a stream."""
    grouped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


WINDOWS = StructType().add("window_start", TimestampType()).add("event_type", StringType()).add("n", LongType()).add("total", DoubleType())


def stream_windows(spark: SparkSession, folder: str, schema: StructType, target: str, checkpoint: str, per_batch: int = 1000, late: str = "10 minutes") -> DataFrame:
    """windowed_counts of all files that are there and weren't taken before, merged into the table at target: a window's latest
    counts are the highest. Rows of windows that the watermark has left behind are dropped."""
    counts = KeyedTable(spark, target, WINDOWS, ["window_start", "event_type"], "n")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", per_batch).parquet(folder)
    query = windowed_counts(stream, late).writeStream.outputMode("update").foreachBatch(lambda df, n: counts.merge(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return counts.read()


def fresh_paths(spark: SparkSession) -> tuple[str, str]:
    base = scratch(spark, "stream")
    return os.path.join(base, "table"), os.path.join(base, "checkpoint")
