"""Queries of symbol extraction and of streams over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import model
from strata.functions.symbols import extract_symbols, symbol_tables
from strata.runtime import table
from strata.streaming.ingest import KeyedTable, fresh_paths, ingest, stream_windows


def _texts(spark: SparkSession, d: str) -> DataFrame:
    t = model.corpus_tables(spark, d)
    return t["code_docs"].join(t["blobs"].select(F.col("id").alias("doc_id"), "language"), "doc_id").select(F.col("doc_id").alias("blob_id"), "language", "content")


def x_symbols(spark: SparkSession, d: str) -> DataFrame:
    return symbol_tables(extract_symbols(_texts(spark, d)))[0].distinct()


def x_refs(spark: SparkSession, d: str) -> DataFrame:
    return symbol_tables(extract_symbols(_texts(spark, d)))[1].distinct()


def st_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Commits read as a stream of files and merged by hash; the same rows as the last of each hash in the table."""
    schema = model.SCHEMAS["commits"]
    folder, checkpoint = fresh_paths(spark)
    target = KeyedTable(spark, folder, schema, ["hash"], "timestamp")
    ingest(spark, f"{d}/commits.parque[t]", target, checkpoint)  # a pattern: the table may be a file or a folder
    return target.read().select("hash", "repo_id", "timestamp", "message")


ST_INGEST_SQL = "SELECT hash, repo_id, timestamp, message FROM (SELECT DISTINCT * FROM commits)"


def st_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events read as a stream and counted in windows; each batch's counts replace those of the batch before."""
    folder, checkpoint = fresh_paths(spark)
    out = stream_windows(spark, f"{d}/events.parque[t]", table(spark, d, "events").schema, folder, checkpoint)
    return out.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


ST_WINDOWS_SQL = "SELECT CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"

QUERIES = {f.__name__: f for f in (x_symbols, x_refs, st_ingest, st_windows)}
SQL = {"st_ingest": ST_INGEST_SQL, "st_windows": ST_WINDOWS_SQL}
