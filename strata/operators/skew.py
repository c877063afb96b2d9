"""Per-key results where a few keys hold most rows.

Map-side combining: each task folds its rows into one partial state per key (Spark's hash aggregate, which spills to a
sort when its table is full), and only these compact states are shuffled. All aggregates used are algebraic - count,
sum, min, max and max_by have mergeable states of fixed size - so that a key with a third of all rows costs its
reducer one state per map task and no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """(key_value, n): rows for each key, repeats included; a null key is a row of its own."""
    return df.groupBy(F.col(key).cast("string").alias("key_value")).agg(F.count(F.lit(1)).alias("n"))


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """(key_value, n) of the keys with at least that share of all rows. Rows without a key count in the total only.

    The total reads no column, only the row counts that the files' footers hold.
    """
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return key_counts(df, key).where(F.col("n") >= F.lit(share) * total).where("key_value IS NOT NULL").select("key_value", "n")


def latest_per_key(df: DataFrame, key: str, order: list[str], take: list[str]) -> DataFrame:
    """For each key its number of rows and the columns take of its last row by order; no key's rows meet in one task.

    Nulls in order come first. Equal orders are told apart by the taken columns, so the result doesn't depend on row order.
    """
    best = F.max(F.struct(*order, *[c for c in take if c not in order])).alias("last")
    done = df.groupBy(F.col(key).alias("key_value")).agg(F.count(F.lit(1)).alias("n"), best)
    return done.select("key_value", "n", *(F.col(f"last.{c}").alias(c) for c in take))


def distinct_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key_value, n_distinct): exact distinct counts in two levels - pairs first, spread over all tasks, then one count per key."""
    pairs = df.select(F.col(key).alias("key_value"), F.col(value).alias("v")).where("v IS NOT NULL").distinct()
    return pairs.groupBy("key_value").agg(F.count(F.lit(1)).alias("n_distinct"))
