import random

import pytest

from strata import core_queries, sql_queries
from strata.operators import hierarchy as H


def brute(edges):
    """Nodes on a loop, by reachability."""
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    out = set()
    for s in up:
        seen, todo = set(), list(up[s])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        if s in seen:
            out.add(s)
    return out


def frame(spark, edges):
    return H.clean_edges(spark.createDataFrame(edges, "c long, p long"), "c", "p")


CASES = {
    "empty": [],
    "nulls_only": [(1, None), (None, 2)],
    "self": [(1, 1), (1, 1), (2, 1)],
    "chain_into_loop": [(i, i + 1) for i in range(1, 30)] + [(30, 20), (20, 25)],
    "merge": [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (6, 1)],
    "two_loops_joined": [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (5, 5), (4, 9)],
    "large_loop": [(i, i % 40 + 1) for i in range(1, 41)] + [(100 + i, 1 + i) for i in range(20)],
}
for seed in range(3):
    r = random.Random(seed)
    CASES[f"random{seed}"] = [(r.randint(1, 60), r.randint(1, 60)) for _ in range(70)]


@pytest.mark.parametrize("name", CASES)
def test_loops_in_one_task_and_distributed(spark, name):
    edges = CASES[name]
    want = brute([(c, p) for c, p in edges if c is not None and p is not None])
    df = frame(spark, edges)
    assert {r.node for r in H.loop_nodes(df).collect()} == want
    if name in ("chain_into_loop", "two_loops_joined", "random0", "large_loop", "self"):
        assert {r.node for r in H.loop_nodes(df, max_component=4).collect()} == want


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randint(1, 300), r.randint(1, 300)) for _ in range(220)]
    got = {x.node: x.component for x in H.connected_components(frame(spark, edges)).collect()}
    up = {n: n for n in {x for e in edges for x in e}}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    assert got == {n: find(n) for n in up}


def test_tree_columns(spark):
    rows = {r.node: r for r in H.hierarchy(frame(spark, [(2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (7, 8), (8, 7), (9, 8)])).collect()}
    assert rows[5].path == [1, 2, 4, 5] and rows[5].depth == 3 and rows[5].root == 1
    assert rows[1].descendants == 4 and rows[2].descendants == 2 and rows[3].descendants == 0
    assert {n for n, r in rows.items() if r.root == 1 and rows[2].pre < r.pre <= rows[2].post} == {4, 5}
    assert rows[9].root is None and rows[9].depth is None and rows[9].loop is None
    assert rows[7].loop == rows[8].loop == 7 and (rows[7].back_edges or rows[8].back_edges)


def test_long_chain_paths_in_blocks(spark):
    n = 700
    edges = [(i + 1, i) for i in range(1, n)]
    for bound in (H.MAX_COMPONENT, 100):
        rows = {r.node: r for r in H.hierarchy(frame(spark, edges), max_component=bound).collect()}
        assert rows[n].depth == n - 1 and rows[n].root == 1 and len(rows) == n
        assert all(rows[k].descendants == n - k for k in (1, 2, 255, 256, 257, 511, 513, n))
        path, node = [], n
        while node is not None:
            path = list(rows[node].path) + path
            node = rows[node].path_anchor
        assert path == list(range(1, n + 1))
        assert all(len(r.path) <= H.PATH_BLOCK for r in rows.values())


def test_walk_of_a_long_chain_is_lean():
    """Half a million edges in one component are walked in 300 MB."""
    import os
    import subprocess
    import sys

    code = (
        "import numpy as np, resource; from strata.operators import hierarchy as H; n = 500_000\n"
        "base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "last = None\n"
        "for last in H.walk_component(np.arange(1, n), np.arange(n - 1)): pass\n"
        "assert last[0] == n - 1 and last[3] == n - 1 and len(last[4]) == (n - 1) % H.PATH_BLOCK + 1\n"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert int(out.stdout) < 300, out.stdout


def test_descendants_and_clashing_columns(spark):
    df = spark.createDataFrame([(2, 1, "x", 5), (3, 2, "y", 6), (4, 3, None, 7), (3, 4, "z", 8)], "id long, parent_id long, node string, component int")
    edges = H.clean_edges(df, "id", "parent_id")
    assert {r.node for r in H.loop_nodes(edges).collect()} == {3, 4}
    got = {r.node for r in H.descendants_of(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {2, 3, 4}


def test_distributed_tree_equals_the_walk(spark, monkeypatch):
    monkeypatch.setattr(H, "PATH_BLOCK", 4)
    r = random.Random(11)
    edges = [(i, max(1, i - r.randint(1, 3))) for i in range(2, 60)] + [(60, r.randint(1, 59)), (60, 3), (71, 70), (70, 71), (72, 71)]
    df = frame(spark, edges)

    def whole(found):
        rows = {x.node: x for x in found.collect()}

        def path(n):
            return [] if n is None or rows[n].path is None else path(rows[n].path_anchor) + list(rows[n].path)

        return {(n, x.loop, x.root, x.depth, tuple(path(n)), x.descendants, x.pre, x.post, tuple(x.back_edges)) for n, x in rows.items()}

    # the tasks of the walk keep the usual block of 256
    assert whole(H.hierarchy(df)) == whole(H.hierarchy(df, max_component=10))
    every = lambda rows: sorted(map(str, H.full_paths(rows.drop("component")).collect()))
    assert every(H.hierarchy(df)) == every(H.hierarchy(df, max_component=10))


@pytest.mark.parametrize("bound", [H.MAX_COMPONENT, 10])
def test_below_follows_all_parents(spark, monkeypatch, bound):
    monkeypatch.setattr(H, "MERGE_BITS", 3)
    r = random.Random(5)
    edges = [e for name in ("merge", "two_loops_joined") for e in [(c + 1000 * len(name), p + 1000 * len(name)) for c, p in CASES[name]]]
    edges += [(i, max(1, i - r.randint(1, 8))) for i in range(2, 30) for _ in range(2)] + [(20, 24), (600, 29), (601, 600)]
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    want = dict.fromkeys({x for e in edges for x in e}, 0)
    for s in want:
        seen, todo = set(), list(up.get(s, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        for x in seen - {s}:
            want[x] += 1
    assert {x.node: x.below for x in H.hierarchy(frame(spark, edges), max_component=bound).collect()} == want


def tables(spark, d, commits, commit_parents, symbols):
    for name, rows, schema in (("commits", commits, "id long"), ("commit_parents", commit_parents, "commit_id long, parent_id long"), ("symbols", symbols, "id long, parent_id long")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return str(d)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_every_commit_and_symbol_comes_out(spark, tmp_path):
    """Those without a link too, and all descendants by name."""
    d = tables(spark, tmp_path, [(1,), (2,), (2,), (9,), (None,)], [(2, 1), (2, 1), (3, 2), (3, 1), (4, None), (None, 5)], [(1, None), (2, 1), (7, None), (8, 8), (6, 8)])
    place = ("loop", "root", "depth", "path", "pre", "post", "descendants", "tree_descendants", "back_edges")
    got = {(r.graph, r.node_id): tuple(r[c] for c in place) for r in core_queries.p1_every(spark, d).collect()}
    alone = {("commit", 4), ("commit", 5), ("commit", 9), ("symbol", 7)}
    assert set(got) == alone | {("commit", 1), ("commit", 2), ("commit", 3), ("symbol", 1), ("symbol", 2), ("symbol", 6), ("symbol", 8)}
    assert all(got[g, n] == (None, n, 0, str(n), 0, 0, 0, 0, "") for g, n in alone)
    assert got["commit", 3] == (None, 1, 1, "1/3", 2, 2, 0, 0, "") and got["commit", 1][6] == 2 and got["symbol", 8] == (8, None, None, None, None, None, 1, None, "8")
    assert rows_of(core_queries.p1_nodes(spark, d)) == [r for r in rows_of(core_queries.p1_every(spark, d)) if r[:2] not in alone]
    assert rows_of(core_queries.p1_pairs(spark, d)) == [("commit", 1, 2), ("commit", 1, 3), ("commit", 2, 3), ("symbol", 1, 2), ("symbol", 8, 6)]
    assert ("commit", 5, 5, 0, 0) in rows_of(core_queries.p1_depth(spark, d))


def test_ids_of_all_longs(spark, tmp_path):
    """Ids that are hashes lie anywhere among the longs, too far from zero to be doubled."""
    top, low = 2**63 - 1, -(2**63)
    d = tables(spark, tmp_path, [(top,)], [(2**62, top), (top, low), (5, 5), (2**62, 3)], [(top, 2**62), (2**62, top), (4, low)])
    assert rows_of(core_queries.p1_found(spark, d)) == [("commit", 5), ("symbol", 2**62), ("symbol", top)]
    assert {(g, n): k for g, n, k in rows_of(core_queries.p1_descendants(spark, d))} == {("commit", 2**62): 0, ("commit", top): 1, ("commit", low): 2, ("commit", 5): 0, ("commit", 3): 1, ("symbol", top): 1, ("symbol", 2**62): 1, ("symbol", 4): 0, ("symbol", low): 1}
    assert {(r.graph, r.node_id): (r.loop, r.root, r.path) for r in core_queries.p1_nodes(spark, d).collect()}["commit", top] == (None, low, f"{low}/{top}")
    assert len(rows_of(core_queries.p1_depth(spark, d))) == 6
    assert rows_of(core_queries.p1_pairs(spark, d)) == sorted([("commit", top, 2**62), ("commit", low, top), ("commit", low, 2**62), ("commit", 3, 2**62), ("symbol", 2**62, top), ("symbol", top, 2**62), ("symbol", low, 4)], key=str)


@pytest.mark.parametrize("name", CASES)
def test_all_descendants(spark, name):
    edges = [e for e in CASES[name] if None not in e]
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    want = set()
    for s in up:
        seen, todo = set(), list(up[s])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        want |= {(x, s) for x in seen - {s}}
    got = [tuple(r) for r in H.all_descendants(frame(spark, CASES[name])).collect()]
    assert len(got) == len(want) and set(got) == want


#: Trees, merges, loops, ways into loops, self-loops, repeated edges and edges without a child or a parent.
CLIMBS = {
    "odd": [(1, 2), (2, 3), (3, None), (4, 4), (5, 4), (6, 7), (7, 8), (8, 6), (9, 6), (10, 9), (None, 1), (None, 99), (None, None), (11, 12), (11, 13), (12, 14), (13, 14), (14, 15), (15, 12), (16, 11), (16, 11), (20, 21), (20, 21), (-5, -9), (-9, 2**62)],
    "chain": [(i, i + 1) for i in range(1, 40)],
    "none": [(None, None), (1, None)],
}
for seed in range(3):
    r = random.Random(seed)
    CLIMBS[f"random{seed}"] = [(r.choice([*range(1, 13), None]), r.choice([*range(1, 13), None])) for _ in range(14)]


@pytest.mark.parametrize("name, bound", [*((n, H.MAX_COMPONENT) for n in CLIMBS), ("odd", 2), ("chain", 2), ("random0", 2)])
def test_climbs_are_the_rows_of_the_recursive_query(spark, name, bound):
    from collections import Counter

    duckdb = pytest.importorskip("duckdb")
    edges = CLIMBS[name]
    con = duckdb.connect()
    con.execute("CREATE TABLE s (id BIGINT, parent_id BIGINT)")
    con.executemany("INSERT INTO s VALUES (?, ?)", edges)
    sql = sql_queries.SQL["r_recursive"]
    want = con.execute("WITH RECURSIVE " + sql[sql.rindex("up(id, above") :].replace("v_symbols", "s")).fetchall()
    got = H.climbed(spark.createDataFrame(edges, "child long, parent long"), bound)
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_climbs_over_whole_components_at_once():
    """Batches are cut at the ends of components only, wherever they are cut themselves."""
    import pyarrow as pa

    comp = [0] * 3 + [7] * 40 + [9] * 2 + [11] * 30
    child = list(range(len(comp)))
    parent = [i + 1 if i + 1 < len(comp) and comp[i + 1] == comp[i] else 1000 + i for i in child]
    want = sum(n * (n + 1) // 2 for n in (3, 40, 2, 30))
    kept, H.CLIMBED = H.CLIMBED, 5
    try:
        for size in (1, 2, 7, 75):
            rows = pa.record_batch([pa.array(x, pa.int64()) for x in (comp, child, parent)], names=["component", "child", "parent"])
            got = [b for b in H._climb(rows.slice(i, size) for i in range(0, len(comp), size))]
            assert sum(b.num_rows for b in got) == want
    finally:
        H.CLIMBED = kept


def test_recursive_query_shuffles_the_table_once(spark, tmp_path):
    """However deep the symbols are; the rows are those of the recursive SQL, repeated rows of the table counting once."""
    from strata import model
    from strata.engine import Engine

    rows = [(i, 1, i - 1 if i % 30 else None, f"n{i}", "f", 1, 1, 1, 1, None, None, None) for i in range(1, 60)]
    rows += [rows[5], (*rows[7][:3], "other name", *rows[7][4:])]
    e = Engine(spark, {"symbols": spark.createDataFrame(rows, model.SCHEMAS["symbols"]).distinct()})
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    got = sql_queries._above(e).collect()
    assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before < 30
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    assert sorted(got) == sorted(e.sql(sql_queries.TEXT["r_recursive"]).collect()) and len(got) > 800
