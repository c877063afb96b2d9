"""Containment joins over source positions.

A position lies in an interval from (line, col) up to, not including, (end_line, end_col). Positions meet intervals by blob and
block of lines, an equi-join, and the innermost container is an aggregate with map-side combining.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Powers of two into which lines are cut: enough for files of 30 million lines.
LEVELS = 24


def _tiles() -> str:
    """The aligned blocks of lines, two a level at most, that make up the lines strictly between a span's first and last."""
    lo, hi = "shiftright(line + shiftleft(1, {k}), {k})", "shiftright(end_line, {k})"
    here, above = (lo.format(k="k"), hi.format(k="k")), (lo.format(k="k + 1"), hi.format(k="k + 1"))
    fits = f"x >= {here[0]} AND x < {here[1]} AND NOT ({above[0]} < {above[1]} AND x >= 2 * {above[0]} AND x < 2 * {above[1]})"
    return f"flatten(transform(sequence(0, {LEVELS}), k -> transform(filter(array_distinct(array({here[0]}, {here[0]} + 1, {here[1]} - 1)), x -> {fits}), x -> named_struct('level', k, 'tile', x))))"


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(ref_id, symbol_id): the innermost span (id, blob_id, line, col, end_line, end_col) around each point (id, blob_id, line, col).

    Of spans around a point the one that begins last is innermost; of several that begin there, the one that ends first.
    Points outside all spans are left out. Lines count from 0 or more.

    A span is cut into aligned blocks of lines, and each block keeps only its innermost span, since all of the block is inside
    it; a line asks the blocks it lies in. So the work grows with lines and spans, not with their product, in a blob with
    most rows too. Only on a span's own first and last line points are compared with it one by one.
    """
    p = points.select(F.col("id").alias("ref_id"), "blob_id", F.col("line").alias("pl"), F.col("col").alias("pc")).where("pl IS NOT NULL")
    s = spans.where("line IS NOT NULL AND end_line IS NOT NULL").select(F.col("id").alias("symbol_id"), "blob_id", "line", "col", "end_line", "end_col")
    s = s.withColumn("rank", F.struct("line", "col", (-F.col("end_line")).alias("end"), "symbol_id"))
    blocks = s.where("line + 1 < end_line").select("blob_id", "rank", F.explode(F.expr(_tiles())).alias("t")).groupBy("blob_id", "t.level", "t.tile").agg(F.max("rank").alias("rank"))
    lines = p.select("blob_id", "pl").distinct().select("blob_id", "pl", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")).withColumn("tile", F.expr("shiftright(pl, level)"))
    whole = lines.join(blocks, ["blob_id", "level", "tile"]).groupBy("blob_id", "pl").agg(F.max("rank").alias("rank"))
    edges = s.select("*", F.explode(F.array_distinct(F.array("line", "end_line"))).alias("pl"))
    inside = p.join(edges, ["blob_id", "pl"]).where("(pl > line OR (pl = line AND pc >= col)) AND (pl < end_line OR (pl = end_line AND pc < end_col))").select("ref_id", "rank")
    found = p.join(whole, ["blob_id", "pl"]).select("ref_id", "rank").union(inside)
    return found.groupBy("ref_id").agg(F.max("rank").alias("rank")).select("ref_id", F.col("rank.symbol_id").alias("symbol_id"))


def nesting(spans: DataFrame) -> DataFrame:
    """(symbol_id, container_id): the smallest span strictly around each span of the same blob."""
    a = spans.select(F.col("id").alias("symbol_id"), "blob_id", "line", "col", "end_line", "end_col")
    b = spans.select(F.col("id").alias("container_id"), "blob_id", F.col("line").alias("l2"), F.col("col").alias("c2"), F.col("end_line").alias("e2"), F.col("end_col").alias("f2"))
    around = a.join(b, "blob_id").where("symbol_id <> container_id AND (l2 < line OR (l2 = line AND c2 <= col)) AND (e2 > end_line OR (e2 = end_line AND f2 >= end_col)) AND NOT (l2 = line AND c2 = col AND e2 = end_line AND f2 = end_col)")
    return around.groupBy("symbol_id").agg(F.max_by("container_id", F.struct("l2", "c2", -F.col("e2"), "container_id")).alias("container_id"))
