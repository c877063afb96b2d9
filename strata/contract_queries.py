"""Fixed cases of the search language, the planner, the renderers, symbol extraction, the store and the indexer.

Each query runs its cases through the engine; its SQL states the expected rows. Those of SYMBOLS and CALLS were made by the
extractor and then read over, corrected and kept; the others were written down beforehand.
"""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import cli, model
from strata.engine import Engine
from strata.functions.languages import repo_dir, repo_name
from strata.functions.symbols import extract_symbols
from strata.operators import dataflow
from strata.query.parser import Filters, QueryError, parse
from strata.query.translate import strategy, translate
from strata.runtime import scratch
from strata.sources.store import Store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _literal(v: object) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _values(columns: str, rows: list[tuple]) -> str:
    """SELECT of fixed rows; columns as in a schema string."""
    kinds = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN"}
    names = [c.split() for c in columns.split(", ")]
    cast = ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in names)
    return f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) t({', '.join(n for n, _ in names)})"


def _cases(name: str, columns: str, rows: list[tuple], given: int, run: Callable) -> None:
    """A query that makes rows of the first columns, the inputs, and of what run makes of them."""
    QUERIES[name] = lambda spark, d: spark.createDataFrame([(*r[:given], *run(*r[:given])) for r in rows], columns)
    SQL[name] = _values(columns, rows)


def _error(e: Exception) -> str:
    return str(e)


# --- the search language ----------------------------------------------------------------------------------------------


def _parsed(text: str) -> tuple:
    try:
        q = parse(text)
    except QueryError as e:
        return None, None, None, None, _error(e)
    base = Filters()
    changed = " ".join(f"{k}={v}" for k, v in sorted(vars(q.filters).items()) if v != getattr(base, k))
    return q.type.value, "|".join(q.texts), q.is_regex, changed, None


_cases(
    "ql_cases",
    "query string, type string, texts string, is_regex boolean, filters string, error string",
    [
        ("crate lift", "code", "crate lift", False, "", None),
        ('lang:rust "oil the hinge" now', "code", "oil the hinge now", False, "lang=rust", None),
        ("language:go x", "code", "x", False, "lang=go", None),
        ("l:c x", "code", "x", False, "lang=c", None),
        ("  a \t b  ", "code", "a b", False, "", None),
        ('open "never closed', "code", "open never closed", False, "", None),
        ("", "code", "", False, "", None),
        ("warm up OR cool down OR", "code", "warm up|cool down", False, "", None),
        ("a or b", "code", "a or b", False, "", None),
        ("repo:yard@dev x", "code", "x", False, "repo=yard rev=dev", None),
        ("-repo:a file:*.go -file:old -lang:c rev:v1 x", "code", "x", False, "file=*.go not_file=old not_lang=c not_repo=a rev=v1", None),
        ("revision:main x", "code", "x", False, "rev=main", None),
        ("type:diff author:ann -author:bob before:2024-02-01 after:2023-02-01 x", "diff", "x", False, "after=2023-02-01 author=ann before=2024-02-01 not_author=bob", None),
        ("type:commit message:fix -message:wip", "commit", "", False, "message=fix not_message=wip", None),
        ("type:symbol select:symbol.struct x", "symbol", "x", False, "select=symbol select_kind=struct", None),
        ("select:repo x", "code", "x", False, "select=repo", None),
        ("calls:a", "code", "", False, "calls=a", None),
        ("calledby:a returns:b", "code", "", False, "calledby=a returns=b", None),
        ("count:12 case:yes x", "code", "x", False, "case=True count=12", None),
        ("case:no x", "code", "x", False, "", None),
        ("lang:go lang:rust x", "code", "x", False, "lang=rust", None),
        ("-word x", "code", "-word x", False, "", None),
        ("http://host.example/a x", "code", "http://host.example/a x", False, "", None),
        ("colour:red x", "code", "colour:red x", False, "", None),
        ('"type:diff"', "code", "type:diff", False, "", None),
        ("/lift\\d+/", "code", "lift\\d+", True, "", None),
        ("/two words/ lang:go", "code", "two words", True, "lang=go", None),
        ("patterntype:regexp a.b", "code", "a.b", True, "", None),
        ("patterntype:literal /a/", "code", "a", True, "", None),
        ("/a/ OR b", "code", "/a/|b", False, "", None),
        ("//", None, None, None, None, "empty regex pattern"),
        ("patterntype:regexp a OR b", None, None, None, None, "regex patterns cannot be combined with OR"),
        ("type:wish x", None, None, None, None, "unknown search type: 'wish'"),
        ("count:0 x", None, None, None, None, "count: must be a positive integer, not '0'"),
        ("count:many x", None, None, None, None, "count: must be a positive integer, not 'many'"),
        ("patterntype:structural x", None, None, None, None, "unsupported pattern type: 'structural'"),
        ("select:colour x", None, None, None, None, "unknown select type: 'colour'"),
        ("-calls:a x", None, None, None, None, "negation not supported for 'calls:'"),
        ("-http:x", None, None, None, None, "negation not supported for 'http:'"),
    ],
    1,
    _parsed,
)


def _planned(text: str) -> tuple:
    try:
        q = parse(text)
        how = strategy(q).value
        t = translate(q)
    except QueryError as e:
        return None, None, None, None, _error(e)
    words = t.sql.replace(",", " ").split()
    sources = " ".join(words[i + 1].split("(")[0] for i, w in enumerate(words) if w in ("FROM", "JOIN"))
    return how, sources, json.dumps(list(t.args.values())), int(words[-1]), None


_CODE, _TREE = "code_search blobs file_revs refs repos", "blobs file_revs refs"
_cases(
    "px_cases",
    "query string, strategy string, sources string, args string, most int, error string",
    [
        ("crate", "bleve_only", _CODE, '["crate", "refs/heads/main"]', 20, None),
        ("/cr.te/ count:5", "bleve_only", _CODE, '["cr.te", "refs/heads/main"]', 5, None),
        ("lang:go crate", "intersect", _CODE, '["crate", "refs/heads/main", "go"]', 20, None),
        ("rev:dev crate", "intersect", _CODE, '["crate", "refs/heads/dev"]', 20, None),
        ("rev:refs/tags/v1 crate", "intersect", _CODE, '["crate", "refs/tags/v1"]', 20, None),
        ("file:a -file:b crate", "intersect", _CODE, '["crate", "refs/heads/main", "%a%", "%b%"]', 20, None),
        ("select:file crate", "intersect", _CODE, '["crate", "refs/heads/main"]', 20, None),
        ("author:ann crate", "bleve_only", _CODE, '["crate", "refs/heads/main"]', 20, None),
        ("type:diff crate", "bleve_only", "diff_search diffs commits", '["crate"]', 20, None),
        ("type:diff author:ann crate", "intersect", "diff_search diffs commits", '["crate", "%ann%"]', 20, None),
        ("type:diff lang:go crate", "bleve_only", "diff_search diffs commits", '["crate"]', 20, None),
        ("type:diff repo:y -repo:z crate", "intersect", "diff_search diffs commits repos", '["crate", "%y%", "%z%"]', 20, None),
        ("type:commit crate OR lid", "sql_only", "commits", '["%crate%", "%lid%"]', 20, None),
        ("type:commit repo:y after:2024-01-01", "sql_only", "commits repos", '["2024-01-01", "%y%"]', 20, None),
        ("type:symbol crate", "sql_only", f"symbols {_TREE}", '["%crate%", "refs/heads/main"]', 20, None),
        ("type:symbol select:symbol.struct lang:go count:3", "sql_only", f"symbols {_TREE}", '["struct", "refs/heads/main", "go"]', 3, None),
        ("returns:int", "sql_only", f"symbols {_TREE}", '["%int%", "refs/heads/main"]', 20, None),
        ("calls:mix", "sql_only", f"symbol_refs symbols {_TREE}", '["%mix%", "refs/heads/main"]', 20, None),
        ("calledby:mix", "sql_only", f"symbols symbol_refs {_TREE}", '["%mix%", "refs/heads/main"]', 20, None),
        ("calls:a calledby:b returns:c", "sql_only", f"symbol_refs symbols {_TREE}", '["%a%", "refs/heads/main"]', 20, None),
        ("lang:go", None, None, None, None, "code search requires a search pattern"),
        ("type:diff author:a", None, None, None, None, "diff search requires a search pattern"),
        ("type:commit", None, None, None, None, "commit search requires a search pattern or at least one filter"),
        ("type:symbol repo:x", None, None, None, None, "symbol search requires a search pattern or filter"),
        ("type:commit /a/", None, None, None, None, "regex patterns are only supported for code and diff search"),
        ("calls:a /b/", None, None, None, None, "regex patterns are only supported for code and diff search"),
    ],
    1,
    _planned,
)

# --- rendering --------------------------------------------------------------------------------------------------------

_cases(
    "cli_cases",
    "row string, text string",
    [
        ('{"commit_hash": "ab12", "author": "ann", "message": "lift\\nmore"}', "ab12  ann  lift"),
        ('{"commit_hash": "ab12"}', "ab12    "),
        ('{"file_path": "a.go", "line": 3, "symbol_name": "Lift", "symbol_kind": "method"}', "a.go:3  method Lift"),
        ('{"repo": "y", "file_path": "a.go", "score": 1.256, "content": "x := 1"}', "y a.go (1.26)\n    x := 1"),
        ('{"commit_hash": "ab12", "file_path": "a.go", "score": 2.0}', "ab12 a.go (2.00)"),
        ('{"file_path": "a.go"}', "a.go"),
        ('{"repo": "y"}', "y"),
    ],
    1,
    lambda row: (cli.render(json.loads(row)),),
)
_cases(
    "cli_highlight",
    "text string, words string, shown string",
    [("Oil the oil", "oil", "\x1b[1mOil\x1b[0m the \x1b[1moil\x1b[0m"), ("a+b", "a+", "\x1b[1ma+\x1b[0mb"), ("none", "", "none")],
    2,
    lambda text, words: (cli.highlight(text, words.split()),),
)


def _named(url: str) -> tuple:
    try:
        return repo_name(url), repo_dir(url), None
    except ValueError as e:
        return None, None, _error(e).split(":")[0]


_cases(
    "fn_repo_cases",
    "url string, name string, dir string, error string",
    [("https://host.example/yard/crane", "host.example/yard/crane", "host.example/yard/crane.git", None), ("git://host.example/yard/crane.git/", "host.example/yard/crane", "host.example/yard/crane.git", None), ("https://", None, None, "invalid repo URL"), ("", None, None, "invalid repo URL")],
    1,
    _named,
)

# --- symbols ----------------------------------------------------------------------------------------------------------

#: Texts of one language each.
SOURCES = {
    "go": 'package depot\n\ntype Crate struct {\n\tweight int\n}\n\ntype Loader interface {\n\tLoad(c Crate) error\n}\n\ntype Grams int\n\nconst limit = 9\n\nfunc (c *Crate) Lift(by int, note string) (int, error) {\n\treturn measure(by), nil\n}\n\nfunc stack(items []Crate) int {\n\tlog.Print("}")\n\treturn weigh(items)\n}\n',
    "rust": 'mod yard {\n    pub enum Gate { Open, Shut }\n}\n\ntrait Swing {\n    fn angle(&self) -> f64;\n}\n\nstruct Hinge<T> { pin: T }\n\nimpl<T: Copy> Swing for Hinge<T> {\n    fn angle(&self) -> f64 {\n        let a = self.turn(2.0);\n        println!("{}", a);\n        a\n    }\n}\n\nfn oil(drops: u8, kind: &str) -> Result<(), String> {\n    pour(drops)\n}\n',
    "python": "import os\n\n@frozen\nclass Kiln(Base):\n    def fire(self, heat: int = 3, *rest) -> bool:\n        def spark():\n            return strike(heat)\n        return spark()\n\nasync def cool(kiln):\n    await kiln.rest(os.getpid())\n",
    "javascript": "import { wax } from './wax.js';\n\nexport class Candle extends Light {\n  burn(hours) {\n    return this.melt(hours);\n  }\n}\n\nconst trim = (wick, cut) => snip(wick);\n\nfunction dip(times) {\n  // not(a, call)\n  wax(`${times} dips`);\n}\n",
    "typescript": "interface Rope {\n  length: number;\n}\n\nenum Knot { Bowline, Hitch }\n\ntype Pair = [Rope, Rope];\n\nabstract class Rigging {\n  tie(a: Rope, k: Knot): Pair {\n    return join(a, k);\n  }\n}\n\nexport function coil(rope: Rope, turns?: number): string {\n  return wind(rope);\n}\n",
    "c": "#include <stdio.h>\n\nenum tint { RED, BLUE };\n\nstruct paint {\n    enum tint t;\n};\n\ntypedef struct paint paint_t;\n\nstatic int mix(const struct paint *a, int parts)\n{\n    if (parts > 1)\n        stir(a);\n    return parts;\n}\n\nvoid coat(void) {\n    mix(0, 2);\n}\n",
    "cpp": "namespace mill {\nclass Wheel {\npublic:\n    double spin(double by) { return clamp(by); }\n};\n}\n\nint mill::run(Wheel w) {\n    return w.spin(1.0);\n}\n",
    "tsx": "type Props = { label: string };\n\nexport function Tile(props: Props): JSX.Element {\n  return render(<b>{props.label}</b>);\n}\n",
    "jsx": "function Lid(props) {\n  return <i>{shut(props)}</i>;\n}\n",
    "fortran": "      SUBROUTINE X\n",
}
#: Their definitions and call sites, places count lines and bytes from 1.
SYMBOLS = [
    ("go", 0, "Crate", "type", 3, 1, 5, 2, -1, "type Crate struct", None, None),
    ("go", 1, "Loader", "type", 7, 1, 9, 2, -1, "type Loader interface", None, None),
    ("go", 2, "Grams", "type", 11, 1, 11, 15, -1, "type Grams int", None, None),
    ("go", 3, "Lift", "method", 15, 1, 17, 2, -1, "func (c *Crate) Lift(by int, note string) (int, error)", "(int, error)", "by int, note string"),
    ("go", 4, "stack", "function", 19, 1, 22, 2, -1, "func stack(items []Crate) int", "int", "items []Crate"),
    ("rust", 0, "yard", "module", 1, 1, 3, 2, -1, "mod yard", None, None),
    ("rust", 1, "Gate", "enum", 2, 5, 2, 33, 0, "pub enum Gate", None, None),
    ("rust", 2, "Swing", "trait", 5, 1, 7, 2, -1, "trait Swing", None, None),
    ("rust", 3, "Hinge", "struct", 9, 1, 9, 27, -1, "struct Hinge<T>", None, None),
    ("rust", 4, "Hinge", "impl", 11, 1, 17, 2, -1, "impl<T: Copy> Swing for Hinge<T>", None, None),
    ("rust", 5, "angle", "function", 12, 5, 16, 6, 4, "fn angle(&self) -> f64", "f64", "&self"),
    ("rust", 6, "oil", "function", 19, 1, 21, 2, -1, "fn oil(drops: u8, kind: &str) -> Result<(), String>", "Result<(), String>", "drops: u8, kind: &str"),
    ("python", 0, "Kiln", "class", 4, 1, 8, 23, -1, "class Kiln(Base)", None, None),
    ("python", 1, "fire", "function", 5, 5, 8, 23, 0, "def fire(self, heat: int = 3, *rest) -> bool", "bool", "self, heat: int = 3, *rest"),
    ("python", 2, "spark", "function", 6, 9, 7, 32, 1, "def spark()", None, ""),
    ("python", 3, "cool", "function", 10, 1, 11, 33, -1, "async def cool(kiln)", None, "kiln"),
    ("javascript", 0, "Candle", "class", 3, 8, 7, 2, -1, "class Candle extends Light", None, None),
    ("javascript", 1, "burn", "method", 4, 3, 6, 4, 0, "burn(hours)", None, "hours"),
    ("javascript", 2, "dip", "function", 11, 1, 14, 2, -1, "function dip(times)", None, "times"),
    ("typescript", 0, "Rope", "interface", 1, 1, 3, 2, -1, "interface Rope", None, None),
    ("typescript", 1, "Knot", "enum", 5, 1, 5, 29, -1, "enum Knot", None, None),
    ("typescript", 2, "Pair", "type_alias", 7, 1, 7, 26, -1, "type Pair = [Rope, Rope]", None, None),
    ("typescript", 3, "Rigging", "class", 9, 1, 13, 2, -1, "abstract class Rigging", None, None),
    ("typescript", 4, "tie", "method", 10, 3, 12, 4, 3, "tie(a: Rope, k: Knot): Pair", "Pair", "a: Rope, k: Knot"),
    ("typescript", 5, "coil", "function", 15, 8, 17, 2, -1, "function coil(rope: Rope, turns?: number): string", "string", "rope: Rope, turns?: number"),
    ("c", 0, "tint", "enum", 3, 1, 3, 24, -1, "enum tint", None, None),
    ("c", 1, "paint", "struct", 5, 1, 7, 2, -1, "struct paint", None, None),
    ("c", 2, "mix", "function", 11, 1, 16, 2, -1, "static int mix(const struct paint *a, int parts)", "int", "const struct paint *a, int parts"),
    ("c", 3, "coat", "function", 18, 1, 20, 2, -1, "void coat(void)", "void", "void"),
    ("cpp", 0, "mill", "namespace", 1, 1, 6, 2, -1, "namespace mill", None, None),
    ("cpp", 1, "Wheel", "class", 2, 1, 5, 2, 0, "class Wheel", None, None),
    ("cpp", 2, "spin", "function", 4, 5, 4, 49, 1, "double spin(double by)", "double", "double by"),
    ("cpp", 3, "mill::run", "function", 8, 1, 10, 2, -1, "int mill::run(Wheel w)", "int", "Wheel w"),
    ("tsx", 0, "Props", "type_alias", 1, 1, 1, 32, -1, "type Props = { label: string }", None, None),
    ("tsx", 1, "Tile", "function", 3, 8, 5, 2, -1, "function Tile(props: Props): JSX.Element", "JSX.Element", "props: Props"),
    ("jsx", 0, "Lid", "function", 1, 1, 3, 2, -1, "function Lid(props)", None, "props"),
]
CALLS = [
    ("go", 0, "measure", "call", 16, 9, 3),
    ("go", 1, "Print", "call", 20, 2, 4),
    ("go", 2, "weigh", "call", 21, 9, 4),
    ("rust", 0, "turn", "call", 13, 17, 5),
    ("rust", 1, "println", "call", 14, 9, 5),
    ("rust", 2, "pour", "call", 20, 5, 6),
    ("python", 0, "strike", "call", 7, 20, 2),
    ("python", 1, "spark", "call", 8, 16, 1),
    ("python", 2, "rest", "call", 11, 11, 3),
    ("python", 3, "getpid", "call", 11, 21, 3),
    ("javascript", 0, "melt", "call", 5, 12, 1),
    ("javascript", 1, "snip", "call", 9, 29, -1),
    ("javascript", 2, "wax", "call", 13, 3, 2),
    ("typescript", 0, "join", "call", 11, 12, 4),
    ("typescript", 1, "wind", "call", 16, 10, 5),
    ("c", 0, "stir", "call", 14, 9, 2),
    ("c", 1, "mix", "call", 19, 5, 3),
    ("cpp", 0, "clamp", "call", 4, 37, 2),
    ("cpp", 1, "spin", "call", 9, 12, 3),
    ("tsx", 0, "render", "call", 4, 10, 1),
    ("jsx", 0, "shut", "call", 2, 14, 0),
]


_SYMBOL = "language string, idx int, name string, kind string, line int, col int, end_line int, end_col int, parent_idx int, signature string, return_type string, params string"
_REF = "language string, idx int, name string, kind string, line int, col int, inside int"


def _sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(SOURCES.items())] + [(90, "go", None), (91, None, "package x")], "blob_id long, language string, content string")


def x_cases(spark: SparkSession, d: str) -> DataFrame:
    found = extract_symbols(_sources(spark)).join(_sources(spark).select("blob_id", "language"), "blob_id").where("NOT is_ref")
    return found.select(*(c.split()[0] for c in _SYMBOL.split(", ")))


def x_calls(spark: SparkSession, d: str) -> DataFrame:
    found = extract_symbols(_sources(spark)).join(_sources(spark).select("blob_id", "language"), "blob_id").where("is_ref")
    return found.select("language", "idx", "name", "kind", "line", "col", F.col("parent_idx").alias("inside"))


def x_lateral(spark: SparkSession, d: str) -> DataFrame:
    """The same symbols by the table function of SQL, joined laterally to each text."""
    e = Engine.over_corpus(spark, d)
    _sources(spark).createOrReplaceTempView("sources")
    return e.sql("SELECT s.language, x.idx, x.name, x.kind, x.line, x.col, x.end_line, x.end_col, x.parent_idx, x.signature, x.return_type, x.params FROM sources s, LATERAL extract_symbols(s.content, s.language) x WHERE NOT x.is_ref")


QUERIES |= {"x_cases": x_cases, "x_calls": x_calls, "x_lateral": x_lateral}
SQL |= {"x_cases": _values(_SYMBOL, SYMBOLS), "x_calls": _values(_REF, CALLS), "x_lateral": _values(_SYMBOL, SYMBOLS)}

# --- the store and the indexer ----------------------------------------------------------------------------------------


def sk_store(spark: SparkSession, d: str) -> DataFrame:
    """Commits written to a store in two versions and refs replaced, as read back; a part that no version names stays unseen."""
    t = model.corpus_tables(spark, d)
    root = scratch(spark, "store")
    store = Store(spark, root)
    commits = t["commits"]
    store.commit({"commits": commits.where("id % 2 = 0"), "refs": t["refs"]})
    commits.limit(5).write.parquet(f"{root}/tables/commits/add-9-lost")
    store.commit({"commits": commits.where("id % 2 <> 0 OR id IS NULL")}, {"refs": t["refs"].where("name = 'refs/heads/main'")})
    again = Store(spark, root)
    rows = again.read("commits").select(F.lit("commit").alias("what"), "id", "hash")
    refs = again.read("refs").select(F.lit("ref").alias("what"), "id", "name")
    older = spark.createDataFrame([("version", again.version(), os.path.basename(again.repos_dir))], "what string, id long, hash string")
    return rows.union(refs).union(older).union(again.read("symbols").select(F.lit("symbol"), "id", "name"))


QUERIES["sk_store"] = sk_store
SQL["sk_store"] = f"{model.oracle_views()} SELECT 'commit' AS what, id, hash FROM v_commits UNION ALL SELECT 'ref', id, name FROM v_refs WHERE name = 'refs/heads/main' UNION ALL SELECT 'version', 2, 'repos'"


def _repository(path: str) -> Callable:
    os.makedirs(path)
    env = {**os.environ, "GIT_AUTHOR_DATE": "2024-03-01T10:00:00Z", "GIT_COMMITTER_DATE": "2024-03-01T10:00:00Z", "GIT_CONFIG_NOSYSTEM": "1"}

    def git(*args: str, **files: str | None) -> None:
        for name, text in files.items():
            file = os.path.join(path, name.replace("__", "."))
            if text is None:
                os.remove(file)
            else:
                with open(file, "wb") as f:
                    f.write(text.encode("latin-1"))
        subprocess.run(["git", "-C", path, "-c", "user.name=Ann", "-c", "user.email=ann@host.example", *args], check=True, capture_output=True, env=env)

    git("init", "-q", "-b", "main")
    git("add", ".", crane__py="def lift(load):\n    return weigh(load)\n", yard__go="package yard\n\nfunc open() int { return lift() }\n", raw__bin="\xff\xfe\x00")
    git("commit", "-qm", "first load")
    git("add", "-A", crane__py="def lift(load):\n    return hoist(load)\n", raw__bin=None, note__txt="")
    git("commit", "-qm", "second load")
    return git


def ix_repository(spark: SparkSession, d: str) -> DataFrame:
    """A repository indexed, and once more after a commit on a new branch: rows that each run adds, then tables and searches."""
    from strata.plans.indexing import index_repo, parse_symbols, unreferenced_file_revs

    base = scratch(spark, "repository")
    git = _repository(base.removeprefix("file://") + "/source")
    root, url = f"{base}/store", f"file://{base.removeprefix('file://')}/source"
    out: list[tuple] = []

    def run(step: str) -> None:
        a, b = index_repo(spark, root, url), parse_symbols(spark, root)
        out.extend((step, k, v) for k, v in {**vars(a), "blobs_parsed": b.blobs_parsed, "symbols": b.symbols, "refs_found": b.refs_found}.items())

    run("first")
    git("checkout", "-qb", "wide")
    git("add", ".", gate__rs="fn swing() {\n    oil(1);\n}\n")
    git("commit", "-qm", "third load")
    run("grown")
    e = Engine.open(spark, root)
    out += [("table", r["name"], r["n"]) for r in dataflow.counters(e.tables, ["repos", "commits", "commit_parents", "refs", "blobs", "file_revs", "diffs", "symbols", "symbol_refs", "code_docs", "diff_docs"]).collect()]
    out.append(("table", "unreferenced", unreferenced_file_revs(e.tables).count()))
    for text in ("hoist", "rev:wide oil", "calls:lift", "type:diff weigh", "type:commit load", "lang:python"):
        try:
            out.append(("search", text, e.search(text).count()))
        except QueryError:
            out.append(("search", text, -1))
    return spark.createDataFrame(out, "step string, name string, n long")


#: What a run of ix_repository must give: git's own HEAD counts as a ref, empty and binary files have no text, and a file that is
#: deleted or changed has one diff row.
REPOSITORY = [
    ("first", "refs", 2), ("first", "new_commits", 2), ("first", "new_blobs", 5), ("first", "new_diffs", 6), ("first", "blobs_parsed", 3), ("first", "symbols", 3), ("first", "refs_found", 3),
    ("grown", "refs", 3), ("grown", "new_commits", 1), ("grown", "new_blobs", 1), ("grown", "new_diffs", 1), ("grown", "blobs_parsed", 1), ("grown", "symbols", 1), ("grown", "refs_found", 1),
    ("table", "repos", 1), ("table", "commits", 3), ("table", "commit_parents", 2), ("table", "refs", 3), ("table", "blobs", 6), ("table", "file_revs", 7), ("table", "diffs", 7), ("table", "symbols", 4), ("table", "symbol_refs", 4), ("table", "code_docs", 4), ("table", "diff_docs", 7), ("table", "unreferenced", 0),
    ("search", "hoist", 1), ("search", "rev:wide oil", 1), ("search", "calls:lift", 1), ("search", "type:diff weigh", 2), ("search", "type:commit load", 3), ("search", "lang:python", -1),
]
QUERIES["ix_repository"] = ix_repository
SQL["ix_repository"] = _values("step string, name string, n long", REPOSITORY)
