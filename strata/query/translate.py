"""Typed queries to parameterised Spark SQL, one template for each kind of search.

Text searches read their ranked hits from a relation named by ``hits``: the table function of the same search when the
SQL is only shown, a temporary view when it is run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from strata.query.parser import Filters, ParsedQuery, QueryError, SearchType, Strategy

DEFAULT_LIMIT = 20
#: An escape character that no pattern holds: backslashes then stand for themselves.
_ESCAPE = "\x01"


@dataclass
class Translated:
    sql: str
    args: dict[str, object]
    type: SearchType


@dataclass
class _Parts:
    """Joins, conditions and bound values of one statement under construction."""

    joins: list[str] = field(default_factory=list)
    conds: list[str] = field(default_factory=list)
    args: dict[str, object] = field(default_factory=dict)

    def bind(self, value: object) -> str:
        name = f"p{len(self.args) + 1}"
        self.args[name] = value
        return f":{name}"

    def join(self, text: str) -> None:
        if text not in self.joins:
            self.joins.append(text)

    def both(self, column: str, yes: str, no: str, case: bool) -> None:
        if yes:
            self.conds.append(pattern_clause(self, column, yes, case))
        if no:
            self.conds.append(f"NOT ({pattern_clause(self, column, no, case)})")

    def where(self) -> str:
        return " AND ".join(["1 = 1", *self.conds])


def glob_to_regex(pattern: str) -> str:
    """A shell pattern over whole strings as a regular expression of Java and RE2: * and ? cross slashes, [..] is a class."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", at + 2 if pattern[at + 1 : at + 2] != "^" else at + 3)
            if end < 0:
                out.append(r"[^\s\S]")  # an unclosed class matches nothing
                break
            body = pattern[at + 1 : end]
            body = ("^" if body.startswith("^") else "") + re.sub(r"([\\\[\]&])", r"\\\1", body.removeprefix("^"))
            out.append(f"[{body}]")
            at = end
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", c) if c.isascii() else c)
        at += 1
    return f"(?s)^{''.join(out)}$"


def has_wildcard(pattern: str) -> bool:
    return "*" in pattern or "?" in pattern


def pattern_clause(p: _Parts, column: str, pattern: str, case: bool) -> str:
    """Substring, or whole-string glob if the pattern has a wildcard; % and _ of a substring pattern act as wildcards too."""
    if has_wildcard(pattern):
        return f"{column} RLIKE {p.bind(glob_to_regex(pattern))}" if case else f"lower({column}) RLIKE {p.bind(glob_to_regex(pattern.lower()))}"
    return f"{column} {'LIKE' if case else 'ILIKE'} {p.bind(f'%{pattern}%')} ESCAPE '{_ESCAPE}'"


def any_pattern(p: _Parts, column: str, patterns: list[str], case: bool) -> str:
    parts = [pattern_clause(p, column, x, case) for x in patterns if x]
    return "1 = 1" if not parts else parts[0] if len(parts) == 1 else f"({' OR '.join(parts)})"


def ref_name(rev: str) -> str:
    return "refs/heads/main" if not rev else rev if rev.startswith("refs/") else f"refs/heads/{rev}"


def _repo(p: _Parts, f: Filters, key: str) -> None:
    if f.repo or f.not_repo:
        p.join(f"JOIN repos rp ON rp.id = {key}")
        p.both("rp.name", f.repo, f.not_repo, f.case)


def _lang(p: _Parts, f: Filters) -> None:
    if f.lang:
        p.conds.append(f"b.language = {p.bind(f.lang)}")
    if f.not_lang:
        p.conds.append(f"b.language != {p.bind(f.not_lang)}")


def _time(p: _Parts, f: Filters) -> None:
    for value, op in ((f.before, "<"), (f.after, ">")):
        if value:
            p.conds.append(f"c.timestamp {op} unix_seconds(try_cast({p.bind(value)} AS timestamp))")


def _limit(f: Filters) -> str:
    return f"LIMIT {f.count or DEFAULT_LIMIT}"


def _no_regex(q: ParsedQuery) -> None:
    if q.is_regex:
        raise QueryError("regex patterns are only supported for code and diff search")


def _hits(q: ParsedQuery, p: _Parts, hits: str | None) -> str:
    return hits or f"{q.type.value}_search({p.bind(q.pattern)}{', true' if q.is_regex else ''})"


def _code(q: ParsedQuery, hits: str | None) -> Translated:
    if q.empty:
        raise QueryError("code search requires a search pattern")
    p, f = _Parts(), q.filters
    source = _hits(q, p, hits)
    p.joins += ["JOIN blobs b ON b.id = h.doc_id", "JOIN file_revs fr ON fr.blob_id = b.id", "JOIN refs r ON r.commit_id = fr.commit_id", "JOIN repos rp ON rp.id = r.repo_id"]
    p.conds.append(f"r.name = {p.bind(ref_name(f.rev))}")
    p.both("rp.name", f.repo, f.not_repo, f.case)
    p.both("fr.path", f.file, f.not_file, f.case)
    _lang(p, f)
    body = f"FROM {source} h {' '.join(p.joins)} WHERE {p.where()}"
    if f.select == "repo":
        sql = f"SELECT DISTINCT rp.name AS repo {body} ORDER BY repo {_limit(f)}"
    elif f.select == "file":
        sql = f"SELECT DISTINCT fr.path AS file_path {body} ORDER BY file_path {_limit(f)}"
    else:
        sql = f"SELECT fr.path AS file_path, b.language, rp.name AS repo, max(h.score) AS score, max_by(h.snippet, h.score) AS content {body} GROUP BY fr.path, b.language, rp.name ORDER BY score DESC, file_path, repo {_limit(f)}"
    return Translated(sql, p.args, q.type)


def _diff(q: ParsedQuery, hits: str | None) -> Translated:
    if q.empty:
        raise QueryError("diff search requires a search pattern")
    p, f = _Parts(), q.filters
    source = _hits(q, p, hits)
    p.joins += ["JOIN diffs d ON d.id = h.doc_id", "JOIN commits c ON c.id = d.commit_id"]
    _repo(p, f, "c.repo_id")
    p.both("d.path", f.file, f.not_file, f.case)
    p.both("c.author", f.author, f.not_author, f.case)
    _time(p, f)
    body = f"FROM {source} h {' '.join(p.joins)} WHERE {p.where()}"
    if f.select == "file":
        sql = f"SELECT DISTINCT d.path AS file_path {body} ORDER BY file_path {_limit(f)}"
    else:
        sql = f"SELECT substring(c.hash, 1, 10) AS commit_hash, c.author, substring(c.message, 1, 80) AS message, d.path AS file_path, h.score, h.snippet AS content {body} ORDER BY score DESC, h.doc_id {_limit(f)}"
    return Translated(sql, p.args, q.type)


def _commit(q: ParsedQuery) -> Translated:
    _no_regex(q)
    p, f = _Parts(), q.filters
    if not q.empty:
        p.conds.append(any_pattern(p, "c.message", q.texts, f.case))
    p.both("c.message", f.message, f.not_message, f.case)
    p.both("c.author", f.author, f.not_author, f.case)
    _time(p, f)
    _repo(p, f, "c.repo_id")
    if not p.conds:
        raise QueryError("commit search requires a search pattern or at least one filter")
    sql = f"SELECT substring(c.hash, 1, 10) AS commit_hash, c.author, substring(c.message, 1, 80) AS message FROM commits c {' '.join(p.joins)} WHERE {p.where()} ORDER BY c.timestamp DESC NULLS LAST, c.hash {_limit(f)}"
    return Translated(sql, p.args, q.type)


_TREE = ["JOIN file_revs fr ON fr.blob_id = b.id", "JOIN refs r ON r.commit_id = fr.commit_id"]


def _tree_filters(p: _Parts, f: Filters) -> None:
    p.conds.append(f"r.name = {p.bind(ref_name(f.rev))}")
    _repo(p, f, "r.repo_id")
    p.both("fr.path", f.file, f.not_file, f.case)
    _lang(p, f)


def _symbol(q: ParsedQuery) -> Translated:
    _no_regex(q)
    p, f = _Parts(), q.filters
    p.joins += ["JOIN blobs b ON b.id = s.blob_id", *_TREE]
    if q.empty and not (f.lang or f.file or f.returns or f.select_kind):
        raise QueryError("symbol search requires a search pattern or filter")
    if not q.empty:
        p.conds.append(any_pattern(p, "s.name", q.texts, f.case))
    if f.select_kind:
        p.conds.append(f"s.kind = {p.bind(f.select_kind)}")
    if f.returns:
        p.conds.append(pattern_clause(p, "s.return_type", f.returns, f.case))
        p.conds.append("s.kind IN ('function', 'method')")
    _tree_filters(p, f)
    sql = f"SELECT fr.path AS file_path, s.name AS symbol_name, s.kind AS symbol_kind, s.line FROM symbols s {' '.join(p.joins)} WHERE {p.where()} ORDER BY file_path, s.line, symbol_name, symbol_kind, s.id, r.id {_limit(f)}"
    return Translated(sql, p.args, SearchType.SYMBOL)


def _callers(q: ParsedQuery) -> Translated:
    _no_regex(q)
    p, f = _Parts(), q.filters
    p.joins += ["JOIN symbols s ON s.id = sr.symbol_id", "JOIN blobs b ON b.id = sr.blob_id", *_TREE]
    p.conds += [pattern_clause(p, "sr.ref_name", f.calls, f.case), "sr.kind = 'call'", "s.kind = 'function'"]
    _tree_filters(p, f)
    sql = f"SELECT DISTINCT fr.path AS file_path, s.name AS symbol_name, s.kind AS symbol_kind, s.line FROM symbol_refs sr {' '.join(p.joins)} WHERE {p.where()} ORDER BY file_path, line, symbol_name, symbol_kind {_limit(f)}"
    return Translated(sql, p.args, SearchType.SYMBOL)


def _callees(q: ParsedQuery) -> Translated:
    _no_regex(q)
    p, f = _Parts(), q.filters
    p.joins += ["JOIN symbol_refs sr ON sr.symbol_id = s.id AND sr.blob_id = s.blob_id", "JOIN blobs b ON b.id = s.blob_id", *_TREE]
    p.conds += [pattern_clause(p, "s.name", f.calledby, f.case), "sr.kind = 'call'", "s.kind = 'function'"]
    _tree_filters(p, f)
    sql = f"SELECT DISTINCT fr.path AS file_path, sr.ref_name AS symbol_name, sr.kind AS symbol_kind, sr.line FROM symbols s {' '.join(p.joins)} WHERE {p.where()} ORDER BY line, file_path, symbol_name, symbol_kind {_limit(f)}"
    return Translated(sql, p.args, SearchType.SYMBOL)


def translate(q: ParsedQuery, hits: str | None = None) -> Translated:
    """calls: goes before calledby:, that before returns:, and these before type:."""
    f = q.filters
    if f.calls:
        return _callers(q)
    if f.calledby:
        return _callees(q)
    if f.returns or q.type is SearchType.SYMBOL:
        return _symbol(q)
    if q.type is SearchType.COMMIT:
        return _commit(q)
    return _code(q, hits) if q.type is SearchType.CODE else _diff(q, hits)


def strategy(q: ParsedQuery) -> Strategy:
    """Where the rows come from: metadata alone, the text index alone, or both."""
    f = q.filters
    if f.calls or f.calledby or f.returns or q.type in (SearchType.COMMIT, SearchType.SYMBOL):
        return Strategy.SQL_ONLY
    if q.empty:
        raise QueryError(f"{q.type.value} search requires a search pattern")
    shared = (f.repo, f.not_repo, f.file, f.not_file, f.select)
    own = (f.lang, f.not_lang, f.rev) if q.type is SearchType.CODE else (f.author, f.not_author, f.before, f.after)
    return Strategy.INTERSECT if any((*shared, *own)) else Strategy.TEXT_ONLY
