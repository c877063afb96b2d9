"""Command line: index, search and sql."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys

from pyspark.sql import SparkSession


def data_dir() -> str:
    """Folder of the store: XDG_DATA_HOME, else .local/share in the home folder."""
    return os.path.join(os.environ.get("XDG_DATA_HOME") or os.path.join(os.path.expanduser("~"), ".local", "share"), "strata")


def session() -> SparkSession:
    return SparkSession.builder.appName("strata").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def highlight(text: str, words: list[str]) -> str:
    """text with the words, in any case, in bold for a terminal."""
    found = re.compile("|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) or r"(?!)", re.I)
    return found.sub(lambda m: f"\x1b[1m{m.group()}\x1b[0m", text)


def render(row: dict) -> str:
    """One result as text."""
    if row.get("commit_hash") and not row.get("file_path"):
        return f"{row['commit_hash']}  {row.get('author') or ''}  {(row.get('message') or '').splitlines()[0] if row.get('message') else ''}"
    if row.get("symbol_name"):
        return f"{row.get('file_path')}:{row.get('line')}  {row.get('symbol_kind')} {row['symbol_name']}"
    if row.get("file_path"):
        head = f"{row['commit_hash']} " if row.get("commit_hash") else f"{row.get('repo') or ''} "
        score = f" ({row['score']:.2f})" if row.get("score") is not None else ""
        body = f"\n    {row['content']}" if row.get("content") else ""
        return f"{head.lstrip()}{row['file_path']}{score}{body}"
    return row.get("repo") or ""


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="strata")
    top.add_argument("--root", default=data_dir())
    cmds = top.add_subparsers(dest="command", required=True)
    index = cmds.add_parser("index")
    index.add_argument("url")
    index.add_argument("--depth", type=int, default=10_000)
    search = cmds.add_parser("search")
    search.add_argument("query", nargs="+")
    search.add_argument("--sql", action="store_true")
    search.add_argument("--json", action="store_true")
    search.add_argument("--count", type=int, default=0)
    sql = cmds.add_parser("sql")
    sql.add_argument("statement")
    a = top.parse_args(argv)
    from strata.engine import Engine
    from strata.query.parser import parse

    spark = session()
    if a.command == "index":
        from strata.plans.indexing import index_repo, parse_symbols

        say = lambda m: print(m, file=sys.stderr)
        index_repo(spark, a.root, a.url, a.depth, say)
        parse_symbols(spark, a.root, say)
        return 0
    engine = Engine.open(spark, a.root)
    if a.command == "sql":
        df = engine.sql(a.statement)
        print("\t".join(df.columns))
        for row in df.toLocalIterator():
            print("\t".join("NULL" if v is None else str(v) for v in row))
        return 0
    # a count in the query itself wins, as it comes later
    text = (f"count:{a.count} " if a.count else "") + " ".join(a.query)
    if a.sql:
        t = engine.translate(text)
        print(text, json.dumps(t.args), t.sql, sep="\n")
        return 0
    q = parse(text)
    rows = [{k: v for k, v in r.asDict().items() if v is not None} for r in engine.search(text).collect()]
    if sys.stdout.isatty() and not a.json and not q.is_regex:
        words = [w for t in q.texts for w in t.split()]
        rows = [r | {"content": highlight(r["content"], words)} if r.get("content") else r for r in rows]
    print(json.dumps(rows, indent=2, ensure_ascii=False) if a.json else "\n".join(map(render, rows)) or "no results")
    return 0


if __name__ == "__main__":
    sys.exit(main())
