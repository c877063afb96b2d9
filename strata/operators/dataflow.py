"""Set-oriented steps of indexing: upserts, replacements, tree differences, diff texts and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.runtime import cut

#: Lines of each side that a diff text holds.
DIFF_LINES = 100


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of both, the last by order for each key; equal orders are told apart by the other columns, nulls first.

    One aggregation with map-side combining: a key that is written very often costs no task its history.
    """
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in key and c != order]
    last = both.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("last"))
    return last.select(*key, *(F.col(f"last.{c}").alias(c) for c in (*rest, order)))


def insert_or_ignore(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Distinct rows of new whose key the old table lacks."""
    return new.dropDuplicates(key).join(old.select(*key).distinct(), key, "left_anti")


def replace_where(old: DataFrame, new: DataFrame, scope: DataFrame, key: list[str]) -> DataFrame:
    """old without the rows in scope (distinct keys), and the rows of new in scope."""
    return old.join(scope, key, "left_anti").unionByName(new.join(scope, key, "left_semi"))


def tree_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, path, old_blob_id, new_blob_id, change) of the paths that differ between two snapshots (key, path, blob_id).

    One full outer join; a file under two paths is two files.
    """
    old = before.select(key, "path", F.col("blob_id").alias("old_blob_id"))
    new = after.select(key, "path", F.col("blob_id").alias("new_blob_id"))
    both = old.join(new, [key, "path"], "full").where(~F.col("old_blob_id").eqNullSafe(F.col("new_blob_id")))
    change = F.when(F.col("old_blob_id").isNull(), "added").when(F.col("new_blob_id").isNull(), "deleted").otherwise("modified")
    return both.withColumn("change", change)


def _side(content: Column | str, sign: str) -> Column:
    lines = F.transform(F.slice(F.split(content, "\n", -1), 1, DIFF_LINES), lambda x: F.concat(F.lit(sign), x, F.lit("\n")))
    return F.coalesce(F.array_join(lines, ""), F.lit(""))


def diff_text(path: Column, old: Column | str, new: Column | str) -> Column:
    """Searchable text of a change: a header that names the path, then the first lines of both sides. A null side has none."""
    return F.concat(F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"), _side(old, "-"), _side(new, "+"))


def counters(tables: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """(name, n): rows of each table."""
    out = None
    for n in names:
        one = tables[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


#: Numbers of a block of a series, as a power of 2: what is listed at once. Blocks that a task makes, where the series is long, and the most tasks.
BLOCK_BITS, BLOCKS, MOST_TASKS = 16, 256, 2_000


def counted_series(rows: DataFrame, key: str, counted: str) -> DataFrame:
    """(n, count) for every whole number n from the smallest to the largest key of rows: how many of its rows have a value in counted.

    What comes out has as many rows as that range has numbers. Only the counts and the first numbers of blocks are shuffled: each of them makes itself and, with a zero,
    all numbers up to the next, in tasks as many as the range asks for. An array of the whole series, as sequence makes it, has a limit.
    """
    spark = rows.sparkSession
    counts = cut(rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("n")).agg(F.count(counted).alias("count")))
    lo, hi = counts.agg(F.min("n"), F.max("n")).first()
    if lo is None:
        return counts
    first, end = lo >> BLOCK_BITS, (hi >> BLOCK_BITS) + 1
    parts = min(end - first, max(int(spark.conf.get("spark.sql.shuffle.partitions")), min((end - first) // BLOCKS, MOST_TASKS)))
    starts = spark.range(first, end).select(F.greatest(F.lit(lo), F.shiftleft("id", BLOCK_BITS)).alias("n"), F.lit(0).cast("long").alias("count"))
    marks = counts.union(starts).withColumn("block", F.shiftright("n", BLOCK_BITS)).repartition(parts, "block")
    # a start that is a key too comes before it, and makes nothing
    upto = F.lead("n").over(Window.partitionBy("block").orderBy("n", "count")) - 1
    spans = marks.withColumn("last", F.coalesce(upto, F.least(F.lit(hi), F.shiftleft("block", BLOCK_BITS) + ((1 << BLOCK_BITS) - 1)))).where("last >= n")
    made = spans.select(F.explode(F.sequence("n", "last")).alias("i"), "n", "count")
    return made.select(F.col("i").alias("n"), F.when(F.col("i") == F.col("n"), F.col("count")).otherwise(F.lit(0).cast("long")).alias("count"))
