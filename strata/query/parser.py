"""Search strings to a typed query.

Blanks and tabs separate tokens; a double quote opens a phrase that runs to the next quote or the end. ``key:value``
tokens with a known key are filters, everything else is searched for, and an upper-case OR starts a new group.
"""

from __future__ import annotations

import enum
from dataclasses import dataclass, field


class QueryError(ValueError):
    """The search string can't be understood."""


class SearchType(enum.Enum):
    CODE = "code"
    DIFF = "diff"
    COMMIT = "commit"
    SYMBOL = "symbol"


class Strategy(enum.Enum):
    SQL_ONLY = "sql_only"
    TEXT_ONLY = "bleve_only"
    INTERSECT = "intersect"


@dataclass(frozen=True)
class Term:
    text: str
    phrase: bool = False


@dataclass
class Filters:
    repo: str = ""
    not_repo: str = ""
    file: str = ""
    not_file: str = ""
    lang: str = ""
    not_lang: str = ""
    rev: str = ""
    count: int = 0
    case: bool = False
    author: str = ""
    not_author: str = ""
    before: str = ""
    after: str = ""
    message: str = ""
    not_message: str = ""
    select: str = ""
    select_kind: str = ""
    calls: str = ""
    calledby: str = ""
    returns: str = ""


@dataclass
class ParsedQuery:
    groups: list[list[Term]] = field(default_factory=list)
    type: SearchType = SearchType.CODE
    is_regex: bool = False
    filters: Filters = field(default_factory=Filters)

    @property
    def texts(self) -> list[str]:
        """One string for each OR group: its terms with single blanks between."""
        return [" ".join(t.text for t in g) for g in self.groups]

    @property
    def pattern(self) -> str:
        return " OR ".join(self.texts)

    @property
    def empty(self) -> bool:
        return not any(self.texts)


def tokenize(text: str) -> list[Term]:
    out: list[Term] = []
    word, at = "", 0
    while at < len(text):
        c = text[at]
        if c == '"':
            if word:
                out.append(Term(word))
                word = ""
            end = text.find('"', at + 1)
            end = len(text) if end < 0 else end
            out.append(Term(text[at + 1 : end], True))
            at = end
        elif c in " \t":
            if word:
                out.append(Term(word))
                word = ""
        else:
            word += c
        at += 1
    if word:
        out.append(Term(word))
    return out


_ALIASES = {"language": "lang", "l": "lang", "revision": "rev"}
#: Filters that take a minus, and the field that holds the negated pattern.
_NEGATED = {"repo": "not_repo", "file": "not_file", "lang": "not_lang", "author": "not_author", "message": "not_message"}
_PLAIN = {"repo", "file", "lang", "rev", "author", "before", "after", "message", "calls", "calledby", "returns"}
_KNOWN = _PLAIN | {"type", "count", "case", "patterntype", "select"}


def _positive(value: str) -> int:
    if not value.isascii() or not value.isdigit() or int(value) <= 0:
        raise QueryError(f"count: must be a positive integer, not {value!r}")
    return int(value)


def _apply(q: ParsedQuery, key: str, value: str) -> bool:
    """Set a filter; True if the pattern is a regular expression from now on."""
    f = q.filters
    if key == "type":
        try:
            q.type = SearchType(value)
        except ValueError:
            raise QueryError(f"unknown search type: {value!r}") from None
    elif key == "count":
        f.count = _positive(value)
    elif key == "case":
        f.case = value == "yes"
    elif key == "patterntype":
        if value not in ("literal", "keyword", "regexp"):
            raise QueryError(f"unsupported pattern type: {value!r}")
        return value == "regexp"
    elif key == "select":
        head, _, kind = value.partition(".")
        if value not in ("repo", "file", "symbol") and not (head == "symbol" and kind):
            raise QueryError(f"unknown select type: {value!r}")
        f.select, f.select_kind = head, kind
    elif key == "repo":
        f.repo, at, rev = value.partition("@")
        if at:
            f.rev = rev
    else:
        setattr(f, key, value)
    return False


def parse(text: str) -> ParsedQuery:
    q = ParsedQuery()
    groups: list[list[Term]] = [[]]
    regex = False
    for t in tokenize(text):
        if not t.phrase and t.text == "OR":
            groups.append([])
            continue
        key, colon, value = ("", "", "") if t.phrase else t.text.partition(":")
        minus = key.startswith("-")
        name = _ALIASES.get(key.lstrip("-") if minus else key, key.lstrip("-") if minus else key)
        if colon and minus:
            if name not in _NEGATED:
                raise QueryError(f"negation not supported for '{name}:'")
            setattr(q.filters, _NEGATED[name], value)
        elif colon and name in _KNOWN:
            regex = _apply(q, name, value) or regex
        else:
            groups[-1].append(t)
    q.groups = [g for g in groups if g]
    if not regex and len(q.groups) == 1 and len(q.groups[0]) >= 1 and not any(t.phrase for t in q.groups[0]):
        whole = q.texts[0]
        if len(whole) >= 2 and whole[0] == whole[-1] == "/":
            if len(whole) == 2:
                raise QueryError("empty regex pattern")
            q.groups, regex = [[Term(whole[1:-1])]], True
    if regex and len(q.groups) > 1:
        raise QueryError("regex patterns cannot be combined with OR")
    q.is_regex = regex
    return q
