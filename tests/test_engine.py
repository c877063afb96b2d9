import subprocess

import pytest

from strata import model
from strata.engine import RESULT, Engine
from strata.functions import languages as L
from strata.operators import fulltext
from strata.query.parser import parse


@pytest.fixture(scope="module")
def engine(spark):
    data = {
        "repos": [(1, "host.example/test/repo", "/tmp/repo")],
        "commits": [(1, 1, "abc1234567", "alice", "initial commit", 1700000000), (2, 1, "def7890123", "bob", "fix bug in parser", 1700100000), (3, 1, "ghi4567890", "alice", "refactor search module", 1700200000)],
        "refs": [(1, 1, "refs/heads/main", 3)],
        "blobs": [(1, "hash1", "go", True), (2, "hash2", "rust", True)],
        "file_revs": [(1, 3, "main.go", 1), (2, 3, "lib.rs", 2)],
        "diffs": [(7, 3, "main.go", None, 1)],
        "symbols": [(1, 1, None, "main", "function", 1, 1, 5, 1, None, None, None), (2, 1, None, "helper", "function", 7, 1, 10, 1, None, None, None), (3, 2, None, "process", "function", 1, 1, 20, 1, None, "Result", None)],
        "symbol_refs": [(1, 1, 1, "helper", "call", 3, 5), (2, 2, 3, "parse", "call", 10, 5), (3, 2, None, "outside", "call", 30, 5)],
        "code_docs": [(1, "package main\nfunc main() {\n\thelper()\n}\n"), (2, "fn process() -> Result {\n  parse()\n}"), (3, None), (4, "")],
        "diff_docs": [(7, "--- a/main.go\n+++ b/main.go\n+func main() helper\n")],
    }
    return Engine(spark, {n: spark.createDataFrame(rows, model.SCHEMAS[n]) for n, rows in data.items()})


def got(engine, text, *cols):
    return [tuple(r[c] for c in cols) for r in engine.search(text).collect()]


def test_searches(engine):
    assert set(got(engine, "type:commit author:alice", "author")) == {("alice",)}
    assert got(engine, "type:commit refactor", "message") == [("refactor search module",)]
    assert ("main", "function") in got(engine, "type:symbol lang:go main", "symbol_name", "symbol_kind")
    assert {k for (k,) in got(engine, "type:symbol select:symbol.function lang:go helper", "symbol_kind")} == {"function"}
    assert ("main",) in got(engine, "calls:helper", "symbol_name")
    assert ("process",) in got(engine, "returns:Result", "symbol_name")
    assert got(engine, "type:commit author:nonexistent", "author") == []
    assert len(got(engine, "type:commit count:1 author:alice", "author")) == 1
    assert ("parse",) in got(engine, "calledby:process", "symbol_name")
    assert ("main",) not in got(engine, "type:symbol lang:rust process", "symbol_name")
    assert ("initial commit",) not in got(engine, "type:commit after:2023-11-15 author:alice", "message")
    assert got(engine, "helper", "file_path", "language", "content") == [("main.go", "go", "helper()")]
    assert got(engine, "type:diff helper", "commit_hash", "file_path") == [("ghi4567890", "main.go")]
    assert got(engine, r"/proc\w+/", "file_path", "score") == [("lib.rs", 1.0)]
    assert got(engine, "rev:dev helper", "file_path") == []
    assert tuple(engine.search("helper").columns) == RESULT


def test_like_quirks(engine):
    assert got(engine, "type:commit fix_bug", "message") == [("fix bug in parser",)]
    assert got(engine, r"type:commit fix\bug", "message") == []
    assert got(engine, "type:commit author:ALICE case:yes", "author") == []
    assert got(engine, "type:commit author:nobody before:never", "author") == []
    assert got(engine, "type:commit case:yes fix_bug", "message") == [("fix bug in parser",)]
    assert got(engine, "type:commit case:yes fix[bug]", "message") == [] and got(engine, "type:commit case:yes Fix", "message") == []


def test_sql_and_functions(engine):
    assert engine.sql("SELECT count(*) AS n FROM symbols").first()["n"] == 3
    assert [r.blob_id for r in engine.sql("SELECT blob_id FROM code_search('helper')").collect()] == [1]
    assert [r.doc_id for r in engine.sql("SELECT doc_id FROM diff_search('func.main', true)").collect()] == [7]
    for bad in (
        "DROP TABLE x", "INSERT INTO symbols VALUES (1)", "CREATE VIEW v AS SELECT 1", " /* c */ DELETE FROM symbols", "CREATE TABLE t AS SELECT 1", "SET spark.sql.ansi.enabled = false",
        "WITH a AS (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '/tmp/never' USING json SELECT * FROM a", "FROM symbols INSERT OVERWRITE DIRECTORY '/tmp/never' USING json SELECT *", "EXPLAIN INSERT INTO symbols VALUES (1)",
        "CACHE TABLE symbols", "BEGIN DELETE FROM symbols; END", "MERGE INTO a USING b ON a.x = b.x WHEN MATCHED THEN DELETE", "UPDATE symbols SET name = 'x'", "TRUNCATE TABLE symbols", "FROM symbols INSERT INTO a SELECT * INSERT INTO b SELECT *",
    ):
        with pytest.raises(ValueError):
            engine.sql(bad)
    for good in ("SHOW TABLES", "DESCRIBE symbols", "EXPLAIN SELECT 1", "VALUES (1)", "FROM symbols SELECT id", "WITH a AS (SELECT id FROM symbols) SELECT * FROM a WHERE id IN (SELECT id FROM a)", "FROM symbols |> SELECT id"):
        assert engine.sql(good).count() > 0, good
    assert "code_search" in engine.translate("helper").sql


def test_index_equals_scan(engine):
    stored = engine.with_indexes("code")
    for text in ("helper", '"func main"', "ma*", "mian~1", "+helper -process", "main OR parse"):
        assert got(stored, text, "file_path", "score") == got(engine, text, "file_path", "score")


def test_clauses():
    items = fulltext.clauses(parse('fmt.Sprintf +must -not near~2 heavy^3 wi*d?').groups[0])
    assert [(c.words, c.sign, c.fuzzy, c.boost, c.wildcard) for c in items] == [(("fmt", "sprintf"), "", 0, 1.0, ""), (("must",), "+", 0, 1.0, ""), (("not",), "-", 0, 1.0, ""), (("near",), "", 2, 1.0, ""), (("heavy",), "", 0, 3.0, ""), ((), "", 0, 1.0, "^wi.*d.$")]


@pytest.mark.parametrize("path, want", [("main.rs", "rust"), ("a/b.PY", "python"), ("foo.bar.rs", "rust"), ("header.h", "c"), ("header.hpp", "cpp"), ("Makefile", None), ("x.tsx", "tsx"), ("a.b/c", None), (".rs", "rust"), ("x.unknown", None)])
def test_languages(spark, path, want):
    assert L.detect(path) == want
    assert spark.createDataFrame([(path,)], "p string").select(L.language_of("p").alias("l")).first()["l"] == want


def test_repo_names(spark):
    for url in ("https://host.example/a/b", "https://host.example/a/b/", "https://host.example/a/b.git", "git://host.example/a/b.git/", "http://host.example/a/b"):
        assert L.repo_name(url) == "host.example/a/b" and L.repo_dir(url) == "host.example/a/b.git"
        assert spark.createDataFrame([(url,)], "u string").select(L.repo_name_of("u").alias("n")).first()["n"] == "host.example/a/b"
    for bad in ("https://", "", "  /"):
        with pytest.raises(ValueError, match="invalid repo URL"):
            L.repo_name(bad)


def test_index_a_repository(spark, tmp_path):
    from strata.plans.indexing import index_repo, parse_symbols, unreferenced_file_revs

    src = tmp_path / "src"
    src.mkdir()

    def git(*a):
        subprocess.run(["git", "-C", str(src), "-c", "user.name=Ann", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)

    git("init", "-q", "-b", "main")
    (src / "a.py").write_text("def f(x):\n    return g(x)\n")
    (src / "bin.dat").write_bytes(b"\xff\xfe\x00")
    git("add", ".")
    git("commit", "-qm", "one")
    (src / "a.py").write_text("def f(x):\n    return h(x)\n")
    git("rm", "-q", "bin.dat")
    git("commit", "-qam", "two")
    root, url = str(tmp_path / "store"), f"file://{src}"
    first = index_repo(spark, root, url)
    assert (first.new_commits, first.new_blobs, first.new_diffs) == (2, 3, 4)
    assert parse_symbols(spark, root).symbols == 2 and parse_symbols(spark, root).blobs_parsed == 0
    assert index_repo(spark, root, url).new_commits == 0
    (src / "b.go").write_text("package b\n\nfunc hello() { f() }\n")
    git("add", ".")
    git("commit", "-qm", "three")
    again = index_repo(spark, root, url)
    assert (again.new_commits, again.new_diffs) == (1, 1)
    parse_symbols(spark, root)
    e = Engine.open(spark, root)
    assert e.tables["commit_parents"].count() == 2 and e.tables["commits"].count() == 3
    assert {r.file_path for r in e.search("return").collect()} == {"a.py"}
    assert {r.symbol_name for r in e.search("calls:f").collect()} == {"hello"}
    assert e.search("type:diff bin").count() == 2
    assert unreferenced_file_revs(e.tables).count() >= 1
    # a second repository: no file of the first is written again or left out
    other = tmp_path / "other"
    subprocess.run(["git", "clone", "-q", str(src), str(other)], check=True, capture_output=True)
    from strata.sources.store import Store

    before = Store(spark, root).manifest()
    assert index_repo(spark, root, f"file://{other}").new_commits == 3
    after = Store(spark, root).manifest()
    assert all(set(before[t]) <= set(after[t]) for t in before)
    assert index_repo(spark, root, url).new_commits == 0
    last = Store(spark, root).manifest()
    mine = lambda m, t: {p for p in m[t] if p in before[t]}
    assert mine(last, "refs") == set() and len(last["refs"]) == len(after["refs"]) == 2 and len(last["repos"]) == 2
    e = Engine.open(spark, root)
    assert e.tables["repos"].count() == 2 and e.tables["commits"].count() == 6 and e.tables["blobs"].where("parsed").count() >= 2


def test_stream_merges_once(spark, tmp_path):
    from strata.streaming.ingest import KeyedTable, ingest

    schema = model.SCHEMAS["commits"]
    src, table = str(tmp_path / "in"), KeyedTable(spark, str(tmp_path / "t"), schema, ["hash"], "timestamp")
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    put([(1, 1, "a", "x", "m", 1), (2, 1, "b", "x", "m", 2)])
    ingest(spark, src, table, str(tmp_path / "c"))
    put([(1, 1, "a", "y", "m", 3), (1, 1, "a", "old", "m", 0)])
    ingest(spark, src, table, str(tmp_path / "c"))
    assert {(r.hash, r.author) for r in table.read().collect()} == {("a", "y"), ("b", "x")}
    before = table.last()
    table.merge(spark.createDataFrame([(9, 1, "z", "x", "m", 9)], schema), before)
    assert table.read().count() == 2


def test_cli(engine, capsys):
    from strata import cli

    assert cli.highlight("aBc abc", ["abc"]) == "\x1b[1maBc\x1b[0m \x1b[1mabc\x1b[0m" and cli.highlight("x", []) == "x"

    row = {"commit_hash": "abc", "author": "x", "message": "m\nn"}
    assert cli.render(row) == "abc  x  m"
    assert cli.render({"file_path": "a", "line": 3, "symbol_name": "f", "symbol_kind": "function"}) == "a:3  function f"
    assert cli.data_dir().endswith("strata")


def test_cancel(spark, engine):
    import threading
    import time

    failed = []

    def work():
        with engine.tagged("long-search"):
            try:
                spark.range(0, 10**11, 1, 4).selectExpr("sum(sqrt(id))").collect()
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    t = threading.Thread(target=work)
    t.start()
    for _ in range(40):
        time.sleep(0.5)
        engine.cancel("long-search")
        if not t.is_alive():
            break
    t.join(5)
    assert failed


def test_searches_cut_snippets_after_the_limit(engine):
    """No nested loop in searches, and texts are joined with the few rows that are left only."""
    for e in (engine, engine.with_indexes("code")):
        for df in (e.search("count:2 helper"), e.search("helper OR parse"), e.sql("SELECT * FROM code_search('helper main')")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert [(r.blob_id, r.snippet) for r in e.sql("SELECT * FROM code_search('helper main')").collect()] == [(1, "helper()")]


def test_plans_prune_and_push_down(spark, tmp_path):
    """Metadata searches read only their columns and push their filters into the scan; top-k is no full sort."""
    rows = [(i, i % 3, f"h{i}", "ann" if i % 2 else "bob", "m", i) for i in range(50)]
    spark.createDataFrame(rows, model.SCHEMAS["commits"]).write.parquet(str(tmp_path / "commits"))
    e = Engine(spark, {"commits": spark.read.parquet(str(tmp_path / "commits"))})
    plan = e.search("type:commit author:ann after:2020-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(author), IsNotNull(timestamp)" in plan and "repo_id" not in plan.split("ReadSchema")[1]
    plan = e.sql("SELECT count(*) FROM commits WHERE repo_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(repo_id,1)" in plan and "ReadSchema: struct<repo_id:bigint>" in plan
