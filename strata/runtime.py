"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + os.path.join(tempfile.gettempdir(), f"strata-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise df once in the shared folder, so that later rounds don't recompute it and a lost executor loses nothing."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def stored(spark: SparkSession, df: DataFrame, name: str) -> Iterator[DataFrame]:
    """df read back from compressed files in the shared folder, which are gone afterwards; a checkpoint would hold the same rows uncompressed."""
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fingerprint(df: DataFrame, *cols: str) -> tuple[int, int]:
    """Count and order-free hash of a frame: equal frames have equal fingerprints."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*cols)).alias("h")).first()
    return row["n"], row["h"] or 0


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of df, an upper bound for scans and filters of files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """Hint a broadcast only where the estimate is under limit; otherwise the planner chooses, with a shuffle as the way beyond it."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def null_safe_key(*cols: Column | str) -> Column:
    """One string key of several columns in which a null differs from every text."""
    parts = [F.coalesce(F.concat(F.lit("="), (F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("~")) for c in cols]
    return F.concat_ws("\x1f", *parts)


def publish(spark: SparkSession, path: str, data: bytes) -> bool:
    """Make the file path with these bytes, whole or not at all; False, with nothing changed, if it is there already.

    The bytes are written beside it and renamed without overwriting, as Spark's own streaming logs are.
    """
    fs = spark._jvm.org.apache.hadoop.fs
    target = fs.Path(path)
    tmp = fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    files = fs.FileContext.getFileContext(target.getParent().toUri(), spark._jsc.hadoopConfiguration())
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(tmp, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    plain = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        files.rename(tmp, target, plain)
        return True
    except Exception as e:  # noqa: BLE001
        system.delete(tmp, False)
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
