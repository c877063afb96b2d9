import datetime as dt

import pytest
from pyspark.sql import functions as F

from strata.operators import dataflow, intervals
from strata.operators import incremental as I
from strata.operators import skew as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_new_or_changed_over_runs(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    log = spark.createDataFrame([(1, 1, "running", t(1)), (2, 1, "ok", t(2)), (3, 2, "ok", t(3)), (4, 2, "rolled_back", t(4)), (5, 3, "failed", t(5)), (6, 3, "ok", t(6))], "log_id long, run_id long, status string, logged_at timestamp")
    wrote = spark.createDataFrame([(1, "commit", "a", 10), (1, "commit", "b", None), (2, "commit", "c", 1), (3, "commit", "a", 11), (1, "commit", "gone", 1)], "run_id long, record_kind string, record_key string, record_value long")
    now = spark.createDataFrame([("a", 11), ("a", 11), ("b", None), ("c", 1), ("d", 5), (None, 3)], "hash string, timestamp long")
    found = I.new_or_changed(I.hashed(now, "commit", F.col("hash"), ["timestamp"]), I.state_of_runs(log, wrote))
    assert {r.record_key for r in found.collect()} == {"c", "d", None}
    back = spark.createDataFrame([("a", 10)], "hash string, timestamp long")
    assert I.new_or_changed(I.hashed(back, "commit", F.col("hash"), ["timestamp"]), I.state_of_runs(log, wrote)).count() == 1


def test_state_store_survives_failures(spark, tmp_path, monkeypatch):
    store = I.StateStore(spark, str(tmp_path / "state"), 4)
    cur = lambda data: I.hashed(spark.createDataFrame(data, "k string, v long"), "x", F.col("k"), ["v"])
    first = cur([("a", 1), ("b", 2)])
    assert store.version() == 0 and store.pending(first).count() == 2
    # a run that dies after writing rows, before its version
    with monkeypatch.context() as m:
        m.setattr(I, "publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.commit(store.pending(first))
    assert store.version() == 0 and store.pending(first).count() == 2
    assert store.commit(store.pending(first)) == 1 and store.pending(first).count() == 0
    second = cur([("a", 1), ("b", 3), ("c", 4), (None, 1)])
    todo = store.pending(second)
    assert {r.record_key for r in todo.collect()} == {"b", "c", None}
    with monkeypatch.context() as m:
        m.setattr(I, "publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.commit(todo)
    assert store.version() == 1 and {r.record_key for r in store.pending(second).collect()} == {"b", "c", None}
    assert store.commit(todo) == 2 and [r.record_key for r in store.pending(second).collect()] == [None]
    assert store.pending(cur([("b", 2)])).count() == 1
    assert store.commit(cur([])) == 3 and store.pending(first).count() == 1
    store.vacuum(1)
    assert store.version() == 3 and store.read().count() == 3 and store._versions() == [3]


def test_state_store_refuses_a_beaten_run(spark, tmp_path):
    """Two runs start from one version: the second to commit fails and changes nothing."""
    a, b = (I.StateStore(spark, str(tmp_path / "state"), 4) for _ in range(2))
    cur = lambda data: I.hashed(spark.createDataFrame(data, "k string, v long"), "x", F.col("k"), ["v"])
    assert a.commit(cur([("a", 1)]), 0) == 1
    with pytest.raises(RuntimeError):
        b.commit(cur([("b", 1)]), 0)
    assert [r.record_key for r in b.read().collect()] == ["a"]
    # each bucket not touched is named by the new version as it was
    assert b.commit(cur([(k, 1) for k in "bcdefgh"]), 1) == 2 and a.read().count() == 8
    assert a.commit(cur([("a", 2)]), 2) == 3 and a.read().count() == 8
    assert a.pending(cur([("a", 1)])).count() == 1 and a.pending(cur([("a", 2)])).count() == 0


def test_heavy_keys(spark):
    data = [("hot",)] * 700 + [(None,)] * 100 + [(f"k{i}",) for i in range(200)]
    df = spark.createDataFrame(data, "k string")
    assert [(r.key_value, r.n) for r in S.heavy_keys(df, "k", 0.025).collect()] == [("hot", 700)]
    assert S.heavy_keys(df.limit(0), "k", 0.025).count() == 0
    assert S.key_counts(df, "k").count() == 202


def test_latest_and_distinct_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 5, "a", 1), (1, 5, "b", 1), (1, None, "z", 1), (2, None, "q", 1), (2, None, "q", 1)], "k long, ts long, h string, n int").drop("n")
    got = {r.key_value: (r.n, r.h) for r in S.latest_per_key(df, "k", ["ts", "h"], ["h"]).collect()}
    assert got == {1: (3, "b"), 2: (2, "q")}
    assert {r.key_value: r.n_distinct for r in S.distinct_per_key(df, "k", "h").collect()} == {1: 3, 2: 1}


def test_upsert_replace_and_tree_diff(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "key string, value int, batch int")
    new = spark.createDataFrame([("b", 3, 1), ("c", 4, 1), ("c", 5, 2), ("c", None, 2)], "key string, value int, batch int")
    assert {(r.key, r.value) for r in dataflow.upsert(old, new, ["key"], "batch").collect()} == {("a", 1), ("b", 3), ("c", 5)}
    scope = spark.createDataFrame([("b",)], "key string")
    assert {(r.key, r.value) for r in dataflow.replace_where(old, new, scope, ["key"]).collect()} == {("a", 1), ("b", 3)}
    before = spark.createDataFrame([(1, "x", "1"), (1, "y", "2"), (2, "x", "1")], "repo long, path string, blob_id string")
    after = spark.createDataFrame([(1, "x", "1"), (1, "y", "3"), (1, "z", "4")], "repo long, path string, blob_id string")
    assert rows(dataflow.tree_diff(before, after, "repo").select("repo", "path", "change")) == [(1, "y", "modified"), (1, "z", "added"), (2, "x", "deleted")]


def test_diff_text_caps_lines(spark):
    df = spark.createDataFrame([("p.go", "a\nb", None), ("q.go", None, "\n".join(map(str, range(150))))], "path string, old string, new string")
    got = {r.path: r.t for r in df.select("path", dataflow.diff_text(F.col("path"), "old", "new").alias("t")).collect()}
    assert got["p.go"] == "--- a/p.go\n+++ b/p.go\n-a\n-b\n"
    assert got["q.go"].count("\n+") == 101 and got["q.go"].endswith("+99\n")


def test_innermost_span(spark):
    spans = spark.createDataFrame([(1, 9, 1, 1, 20, 1), (2, 9, 3, 5, 8, 2), (3, 9, 3, 5, 6, 1), (4, 8, 1, 1, 99, 1)], "id long, blob_id long, line int, col int, end_line int, end_col int")
    points = spark.createDataFrame([(10, 9, 4, 1), (11, 9, 7, 1), (12, 9, 3, 4), (13, 9, 20, 1), (14, 7, 1, 1)], "id long, blob_id long, line int, col int")
    assert {r.ref_id: r.symbol_id for r in intervals.innermost(points, spans).collect()} == {10: 3, 11: 2, 12: 1}
    assert {r.symbol_id: r.container_id for r in intervals.nesting(spans).collect()} == {2: 1, 3: 2}


def test_innermost_against_brute_force(spark):
    import random

    r = random.Random(4)
    spans = [(i, r.randint(1, 2), *(a := sorted((r.randint(0, 90), r.randint(0, 9)) for _ in range(2)))[0], *a[1]) for i in range(120)] + [(900, 1, None, 1, 5, 1), (901, 1, 3, 1, None, 1)]
    points = [(i, r.randint(1, 3), r.randint(0, 95), r.randint(0, 9)) for i in range(300)] + [(999, 1, None, 1)]
    want = {}
    for i, b, line, col in points:
        around = [(s[2], s[3], -s[4], s[0]) for s in spans if s[1] == b and line is not None and None not in s and (s[2], s[3]) <= (line, col) < (s[4], s[5])]
        if around:
            want[i] = max(around)[3]
    sp = spark.createDataFrame(spans, "id long, blob_id long, line int, col int, end_line int, end_col int")
    pt = spark.createDataFrame(points, "id long, blob_id long, line int, col int")
    assert {x.ref_id: x.symbol_id for x in intervals.innermost(pt, sp).collect()} == want and len(want) > 100


@pytest.mark.parametrize("table", ["commits", "refs"])
def test_empty_tables(spark, table):
    from strata import model

    assert dataflow.insert_or_ignore(model.empty(spark, table), model.empty(spark, table), ["repo_id"]).count() == 0


def test_entry_imports_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=root, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


@pytest.mark.parametrize(
    "keys",
    [
        [],
        [(None, 1)],
        [(7, None)],
        [(0, 1), (0, 2), (1, 3), (3, None), (None, 4), (3, 5)],
        [(65535, 1), (65536, 2), (65536, None), (200000, 3)],
        [(-70000, 1), (-65536, None), (-1, 1), (5, 1)],
        [(2**63 - 3, 1), (2**63 - 1, 1)],
    ],
)
def test_series_counts_every_number(spark, keys):
    found = [k for k, _ in keys if k is not None]
    want = {n: sum(k == n and v is not None for k, v in keys) for n in (range(min(found), max(found) + 1) if found else ())}
    got = dataflow.counted_series(spark.createDataFrame(keys, "k long, v long"), "k", "v").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == set(want.items())


def test_series_query_over_far_keys(spark):
    """More numbers than an array holds: the series is made block by block, of which any can be asked for."""
    from strata import model, sql_queries
    from strata.engine import Engine

    e = Engine(spark, {"file_revs": spark.createDataFrame([(1, 1, "a", 5), (2, 1, "b", 5), (3, 1, "c", 3_000_000_000)], model.SCHEMAS["file_revs"])})
    got = sql_queries.ROWS["r_series"](e)
    assert [tuple(r) for r in got.limit(1).collect()] and got.columns == ["n", "files"]
    tail = spark.createDataFrame([(k, 1) for k in (0, 2_500_000)], "k long, v long")
    assert dataflow.counted_series(tail, "k", "v").agg(F.count("n"), F.sum("n"), F.sum("count")).first()[:] == (2_500_001, 2_500_000 * 2_500_001 // 2, 2)
