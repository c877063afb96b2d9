"""Queries of the core operators over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import hierarchy as H
from strata.operators import incremental as I
from strata.operators import skew as S
from strata.runtime import cut, scratch, table


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return H.clean_edges(table(spark, d, "commit_parents"), "commit_id", "parent_id"), H.clean_edges(table(spark, d, "symbols"), "id", "parent_id")


def _over_graphs(spark: SparkSession, d: str, walk: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """walk over both graphs, its rows with the graph they are of.

    Both are walked as one graph, so that each round costs one job: node ids doubled, symbols odd. Where an id is too far
    from zero to be doubled, as hashes are, each graph is walked by itself.
    """
    c, s = _edges(spark, d)
    ends = c.union(s).agg(F.min(F.least("child", "parent")).alias("low"), F.max(F.greatest("child", "parent")).alias("high")).first()
    if ends["low"] is not None and not -(1 << 62) <= ends["low"] <= ends["high"] < 1 << 62:
        return walk(c).withColumn("graph", F.lit("commit")).unionByName(walk(s).withColumn("graph", F.lit("symbol")))
    out = walk(c.select(F.col("child") * 2, F.col("parent") * 2).union(s.select(F.col("child") * 2 + 1, F.col("parent") * 2 + 1)).toDF("child", "parent"))
    graph = F.when(F.col("node") % 2 == 0, "commit").otherwise("symbol").alias("graph")
    half = lambda c: F.shiftright(c, 1).alias(c) if c in ("node", "below_node", "loop", "root") else F.transform(c, lambda x: F.shiftright(x, 1)).alias(c) if c in ("path", "back_edges") else c
    return out.select(graph, *map(half, out.columns))


def _without_links(spark: SparkSession, d: str, *columns: tuple[str, str, str]) -> DataFrame:
    """(graph, node_id) of the ids in columns (graph, table, column) that are in no link of their graph."""
    ids = reduce(DataFrame.union, [table(spark, d, t).select(F.lit(graph).alias("graph"), F.col(c).cast("long").alias("node_id")) for graph, t, c in columns]).where("node_id IS NOT NULL").distinct()
    linked = reduce(DataFrame.union, [e.select(F.lit(graph).alias("graph"), F.col(c).alias("node_id")) for graph, e in zip(("commit", "symbol"), _edges(spark, d)) for c in ("child", "parent")])
    return ids.join(linked, ["graph", "node_id"], "left_anti")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _over_graphs(spark, d, H.loop_nodes).select("graph", F.col("node").alias("node_id"))


P1_FOUND_SQL = """
WITH RECURSIVE e AS (
  SELECT DISTINCT 'commit' AS graph, commit_id AS child, parent_id AS parent FROM commit_parents WHERE commit_id IS NOT NULL AND parent_id IS NOT NULL
  UNION SELECT 'symbol', id, parent_id FROM symbols WHERE id IS NOT NULL AND parent_id IS NOT NULL),
r AS (SELECT graph, parent AS top, child AS id FROM e UNION SELECT r.graph, r.top, e.child FROM r JOIN e ON e.graph = r.graph AND e.parent = r.id)
SELECT graph, id AS node_id FROM r WHERE top = id
"""


def p1_nodes(spark: SparkSession, d: str) -> DataFrame:
    """All that is known of every node. descendants counts over all parent links; tree_descendants, like root, depth, path, pre and post, over the smallest parents."""
    line = lambda c, mark: F.array_join(F.col(c).cast("array<string>"), mark).alias(c)
    out = _over_graphs(spark, d, lambda e: H.full_paths(cut(H.hierarchy(e))))
    return out.select("graph", F.col("node").alias("node_id"), "loop", "root", F.col("depth").cast("long").alias("depth"), line("path", "/"), "pre", "post", F.col("below").alias("descendants"), F.col("descendants").alias("tree_descendants"), line("back_edges", ","))


P1_NODES_SQL = """
WITH RECURSIVE e AS (
  SELECT DISTINCT 'commit' AS graph, commit_id AS child, parent_id AS parent FROM commit_parents WHERE commit_id IS NOT NULL AND parent_id IS NOT NULL
  UNION SELECT 'symbol', id, parent_id FROM symbols WHERE id IS NOT NULL AND parent_id IS NOT NULL),
n AS (SELECT graph, child AS id FROM e UNION SELECT graph, parent FROM e),
r AS (SELECT graph, parent AS top, child AS id FROM e UNION SELECT r.graph, r.top, e.child FROM r JOIN e ON e.graph = r.graph AND e.parent = r.id),
b AS (SELECT graph, top AS id, count(*) FILTER (WHERE id <> top) AS descendants FROM r GROUP BY ALL),
s AS (SELECT x.graph, x.id, min(x.top) AS loop FROM r x JOIN r y ON y.graph = x.graph AND y.top = x.id AND y.id = x.top GROUP BY ALL),
k AS (SELECT e.graph, e.child AS id, string_agg(CAST(e.parent AS VARCHAR), ',' ORDER BY e.parent) AS back_edges FROM e JOIN s u ON u.graph = e.graph AND u.id = e.child JOIN s v ON v.graph = e.graph AND v.id = e.parent
      WHERE u.loop = v.loop AND e.parent <= e.child GROUP BY ALL),
m AS (SELECT graph, child, min(parent) AS parent FROM e GROUP BY ALL),
t AS (
  SELECT n.graph, n.id, n.id AS root, CAST(0 AS BIGINT) AS depth, [n.id] AS path FROM n LEFT JOIN m ON m.graph = n.graph AND m.child = n.id WHERE m.child IS NULL
  UNION ALL SELECT m.graph, m.child, t.root, t.depth + 1, list_append(t.path, m.child) FROM t JOIN m ON m.graph = t.graph AND m.parent = t.id),
d AS (SELECT graph, above AS id, count(*) - 1 AS tree_descendants FROM (SELECT graph, unnest(path) AS above FROM t) GROUP BY ALL),
o AS (SELECT t.*, row_number() OVER (PARTITION BY graph, root ORDER BY path) - 1 AS pre FROM t)
SELECT n.graph, n.id AS node_id, s.loop, o.root, o.depth, list_aggregate(o.path, 'string_agg', '/') AS path, o.pre, o.pre + d.tree_descendants AS post, coalesce(b.descendants, 0) AS descendants, d.tree_descendants, coalesce(k.back_edges, '') AS back_edges
FROM n LEFT JOIN s ON s.graph = n.graph AND s.id = n.id LEFT JOIN o ON o.graph = n.graph AND o.id = n.id LEFT JOIN d ON d.graph = n.graph AND d.id = n.id LEFT JOIN b ON b.graph = n.graph AND b.id = n.id LEFT JOIN k ON k.graph = n.graph AND k.id = n.id
"""


def p1_every(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p1_nodes, and one for each commit and symbol without a link: a root with nothing under it."""
    alone = _without_links(spark, d, ("commit", "commits", "id"), ("commit", "commit_parents", "commit_id"), ("commit", "commit_parents", "parent_id"), ("symbol", "symbols", "id"), ("symbol", "symbols", "parent_id"))
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    return p1_nodes(spark, d).union(alone.select("graph", "node_id", none, "node_id", zero, F.col("node_id").cast("string"), zero, zero, zero, zero, F.lit("")))


P1_EVERY_SQL = P1_NODES_SQL.replace(
    "UNION SELECT graph, parent FROM e),",
    """UNION SELECT graph, parent FROM e UNION SELECT 'commit', id FROM commits WHERE id IS NOT NULL UNION SELECT 'commit', commit_id FROM commit_parents WHERE commit_id IS NOT NULL
      UNION SELECT 'commit', parent_id FROM commit_parents WHERE parent_id IS NOT NULL UNION SELECT 'symbol', id FROM symbols WHERE id IS NOT NULL UNION SELECT 'symbol', parent_id FROM symbols WHERE parent_id IS NOT NULL),""",
)


def p1_depth(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth and descendants, all in the tree of smallest parents, of every node that has a root there; p1_descendants follows all parents."""
    out = _over_graphs(spark, d, H.hierarchy).where("root IS NOT NULL")
    # a parent whose only child is null is a root all the same
    alone = _without_links(spark, d, ("commit", "commit_parents", "parent_id"), ("symbol", "symbols", "parent_id")).select("graph", "node_id", "node_id", F.lit(0).cast("long"), F.lit(0).cast("long"))
    return out.select("graph", F.col("node").alias("node_id"), "root", F.col("depth").cast("long").alias("depth"), F.col("descendants").cast("long").alias("descendants")).union(alone)


P1_DEPTH_SQL = """
WITH RECURSIVE e AS (
  SELECT 'commit' AS graph, commit_id AS child, min(parent_id) AS parent FROM commit_parents WHERE parent_id IS NOT NULL GROUP BY commit_id
  UNION ALL SELECT 'symbol', id, min(parent_id) FROM symbols WHERE parent_id IS NOT NULL GROUP BY id),
n AS (SELECT graph, child AS id FROM e UNION SELECT graph, parent FROM e UNION
      SELECT 'commit', parent_id FROM commit_parents WHERE parent_id IS NOT NULL UNION SELECT 'symbol', parent_id FROM symbols WHERE parent_id IS NOT NULL),
t AS (
  SELECT n.graph, n.id, n.id AS root, CAST(0 AS BIGINT) AS depth, [n.id] AS path FROM n LEFT JOIN e ON e.graph = n.graph AND e.child = n.id WHERE e.child IS NULL
  UNION ALL SELECT e.graph, e.child, t.root, t.depth + 1, list_append(t.path, e.child) FROM t JOIN e ON e.graph = t.graph AND e.parent = t.id)
SELECT a.graph, a.id AS node_id, a.root, a.depth, count(b.id) - 1 AS descendants
FROM t a JOIN (SELECT graph, id, unnest(path) AS above FROM t) b ON b.graph = a.graph AND b.above = a.id GROUP BY ALL
"""


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """For every node of a link, on loops or not, the number of other nodes that reach it over any of their parents. p1_every has the commits and symbols without a link too, p1_pairs the descendants themselves."""
    return _over_graphs(spark, d, H.hierarchy).select("graph", F.col("node").alias("node_id"), F.col("below").alias("descendants"))


P1_DESCENDANTS_SQL = """
WITH RECURSIVE e AS (
  SELECT DISTINCT 'commit' AS graph, commit_id AS child, parent_id AS parent FROM commit_parents WHERE commit_id IS NOT NULL AND parent_id IS NOT NULL
  UNION SELECT 'symbol', id, parent_id FROM symbols WHERE id IS NOT NULL AND parent_id IS NOT NULL),
r AS (SELECT graph, parent AS top, child AS id FROM e UNION SELECT r.graph, r.top, e.child FROM r JOIN e ON e.graph = r.graph AND e.parent = r.id),
n AS (SELECT graph, child AS id FROM e UNION SELECT graph, parent FROM e)
SELECT n.graph, n.id AS node_id, count(r.id) AS descendants FROM n LEFT JOIN r ON r.graph = n.graph AND r.top = n.id AND r.id <> n.id GROUP BY ALL
"""


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every node with each other node that reaches it over any of their parents, on loops or not."""
    return _over_graphs(spark, d, H.all_descendants).select("graph", F.col("node").alias("node_id"), F.col("below_node").alias("descendant_id"))


P1_PAIRS_SQL = """
WITH RECURSIVE e AS (
  SELECT DISTINCT 'commit' AS graph, commit_id AS child, parent_id AS parent FROM commit_parents WHERE commit_id IS NOT NULL AND parent_id IS NOT NULL
  UNION SELECT 'symbol', id, parent_id FROM symbols WHERE id IS NOT NULL AND parent_id IS NOT NULL),
r AS (SELECT graph, parent AS top, child AS id FROM e UNION SELECT r.graph, r.top, e.child FROM r JOIN e ON e.graph = r.graph AND e.parent = r.id)
SELECT graph, top AS node_id, id AS descendant_id FROM r WHERE id <> top
"""


def _state(spark: SparkSession, d: str) -> I.StateStore:
    """A state store whose first version is what the succeeded runs have written."""
    store = I.StateStore(spark, scratch(spark, "state"))
    store.commit(I.state_of_runs(table(spark, d, "index_run_log"), table(spark, d, "run_records")))
    return store


def _records(spark: SparkSession, d: str) -> DataFrame:
    commits = I.hashed(table(spark, d, "commits"), "commit", F.col("hash"), ["timestamp"])
    return commits.union(I.hashed(table(spark, d, "refs"), "ref", F.concat(F.col("repo_id").cast("string"), F.lit(":"), "name"), ["commit_id"]))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).pending(_records(spark, d)).select("record_kind", "record_key").distinct()


def p2_after(spark: SparkSession, d: str) -> DataFrame:
    """Records that are still to do after a run that processed all of them and committed: none but those whose key has several values."""
    store, records = _state(spark, d), _records(spark, d)
    store.commit(store.pending(records, 1), 1)
    return store.pending(records).groupBy("record_kind").agg(F.count(F.lit(1)).alias("n"))


P2_AFTER_SQL = """
WITH p AS (SELECT DISTINCT 'commit' AS record_kind, hash AS record_key, timestamp AS v FROM commits WHERE hash IS NOT NULL
           UNION SELECT 'ref', CAST(repo_id AS VARCHAR) || ':' || name, commit_id FROM refs WHERE repo_id IS NOT NULL AND name IS NOT NULL)
SELECT record_kind, sum(n - 1)::BIGINT AS n FROM (SELECT record_kind, record_key, count(*) AS n FROM p GROUP BY ALL) WHERE n > 1 GROUP BY record_kind
"""

P2_FOUND_SQL = """
WITH ok AS (SELECT run_id FROM index_run_log GROUP BY run_id HAVING arg_max(status, logged_at) = 'ok'),
w AS (SELECT r.*, row_number() OVER (PARTITION BY record_kind, record_key ORDER BY run_id DESC) AS k FROM run_records r WHERE run_id IN (SELECT run_id FROM ok)),
p AS (SELECT DISTINCT 'commit' AS record_kind, hash AS record_key, timestamp AS v FROM commits
      UNION SELECT 'ref', CAST(repo_id AS VARCHAR) || ':' || name, commit_id FROM refs)
SELECT DISTINCT p.record_kind, p.record_key FROM p LEFT JOIN (SELECT * FROM w WHERE k = 1) w ON w.record_kind = p.record_kind AND w.record_key = p.record_key
WHERE w.record_key IS NULL OR p.v IS DISTINCT FROM w.record_value
"""

HEAVY_SHARE = 0.025
HEAVY_FIELDS = (("file_revs", "blob_id"), ("commits", "repo_id"), ("symbol_refs", "ref_name"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t, c in HEAVY_FIELDS:
        part = S.heavy_keys(table(spark, d, t), c, HEAVY_SHARE).select(F.lit(f"{t}.{c}").alias("field_name"), "key_value")
        out = part if out is None else out.union(part)
    return out


P5_FOUND_SQL = " UNION ALL ".join(f"SELECT '{t}.{c}' AS field_name, CAST({c} AS VARCHAR) AS key_value FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM {t})" for t, c in HEAVY_FIELDS)


def p5_latest(spark: SparkSession, d: str) -> DataFrame:
    """For each repository its commits, distinct authors and the latest commit (highest timestamp, then hash)."""
    commits = table(spark, d, "commits")
    last = S.latest_per_key(commits, "repo_id", ["timestamp", "hash"], ["hash"])
    people = S.distinct_per_key(commits, "repo_id", "author")
    return last.join(people, "key_value", "left").select(F.col("key_value").alias("repo_id"), F.col("n").alias("n_commits"), F.col("hash").alias("last_hash"), F.coalesce("n_distinct", F.lit(0)).alias("n_authors"))


P5_LATEST_SQL = """
SELECT repo_id, count(*) AS n_commits, max_by(hash, {'t': coalesce(timestamp, -9223372036854775807), 'h': hash}) AS last_hash, count(DISTINCT author) AS n_authors FROM commits GROUP BY repo_id
"""


def p5_calls(spark: SparkSession, d: str) -> DataFrame:
    """For each callee name its references, the blobs it occurs in and its first place."""
    refs = table(spark, d, "symbol_refs")
    counts = refs.groupBy("ref_name").agg(F.count(F.lit(1)).alias("n_refs"), F.min("id").alias("first_id"))
    blobs = S.distinct_per_key(refs, "ref_name", "blob_id").withColumnRenamed("key_value", "ref_name")
    return counts.join(blobs, "ref_name").select("ref_name", "n_refs", "first_id", F.col("n_distinct").alias("n_blobs"))


P5_CALLS_SQL = "SELECT ref_name, count(*) AS n_refs, min(id) AS first_id, count(DISTINCT blob_id) AS n_blobs FROM symbol_refs GROUP BY ref_name"

QUERIES = {"p1_found": p1_found, "p1_nodes": p1_nodes, "p1_depth": p1_depth, "p1_descendants": p1_descendants, "p1_every": p1_every, "p1_pairs": p1_pairs, "p2_found": p2_found, "p2_after": p2_after, "p5_found": p5_found, "p5_latest": p5_latest, "p5_calls": p5_calls}
SQL = {"p1_found": P1_FOUND_SQL, "p1_nodes": P1_NODES_SQL, "p1_depth": P1_DEPTH_SQL, "p1_descendants": P1_DESCENDANTS_SQL, "p1_every": P1_EVERY_SQL, "p1_pairs": P1_PAIRS_SQL, "p2_found": P2_FOUND_SQL, "p2_after": P2_AFTER_SQL, "p5_found": P5_FOUND_SQL, "p5_latest": P5_LATEST_SQL, "p5_calls": P5_CALLS_SQL}
