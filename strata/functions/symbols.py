"""Definitions and call sites of source texts in nine languages.

Python is read by its own parser. The other languages are read from a copy of the text in which comments and literals are
blank and brackets are paired: heads of definitions are found by pattern, their extents by the pairs. Positions are lines
and byte columns from 1. Everything happens inside one map over the texts; no row of a text is shuffled.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

LANGUAGES = ("go", "rust", "python", "javascript", "jsx", "typescript", "tsx", "c", "cpp")


@dataclass
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    signature: str
    return_type: str | None = None
    params: str | None = None
    parent: int = -1
    at: tuple[int, int, int, int] = (0, 0, 0, 0)


@dataclass
class Ref:
    name: str
    start: int
    kind: str = "call"
    inside: int = -1
    at: tuple[int, int] = (0, 0)


@dataclass
class Found:
    symbols: list[Symbol] = field(default_factory=list)
    refs: list[Ref] = field(default_factory=list)


_C_BLANK = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\.)+'"
_BLANKS = {
    "c": re.compile(r"^[ \t]*#(?:[^\n\\]|\\[\s\S])*|" + _C_BLANK, re.M),
    "go": re.compile(_C_BLANK + r"|`[^`]*`?"),
    "rust": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|b?r(#*)\"[\s\S]*?(?:\"\1|\Z)|b?\"(?:[^\"\\]|\\[\s\S])*\"?|b?'(?:[^'\\\n]|\\[^\n]+?)'"),
    "script": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?|`(?:[^`\\]|\\[\s\S])*`?|(?<=[=(,:\[!&|?{};])\s*/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*"),
}
_FAMILY = {"c": "c", "cpp": "c", "go": "go", "rust": "rust", "javascript": "script", "jsx": "script", "typescript": "script", "tsx": "script"}


def blank(text: str, family: str) -> str:
    """text with comments, literals and preprocessor lines replaced by blanks of the same length."""
    return _BLANKS[family].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


class Code:
    """A blanked text with its bracket pairs and line starts."""

    def __init__(self, text: str, family: str):
        self.text, self.code = text, blank(text, family)
        self.close: dict[int, int] = {}
        self.open: dict[int, int] = {}
        stack: list[int] = []
        want = {")": "(", "]": "[", "}": "{"}
        for m in re.finditer(r"[()\[\]{}]", self.code):
            c, i = m.group(), m.start()
            if c in "([{":
                stack.append(i)
            elif stack and self.code[stack[-1]] == want[c]:
                j = stack.pop()
                self.close[j], self.open[i] = i, j

    def past_angles(self, at: int) -> int:
        """Behind the generic parameters at at, if there are any."""
        if self.code[at : at + 1] != "<":
            return at
        depth = 0
        for m in re.finditer(r"[<>(){};]|->|=>", self.code[at:]):
            t = m.group()
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return at + m.end()
            elif t in "{};":
                break
        return at

    def skip(self, at: int) -> int:
        return re.compile(r"\s*").match(self.code, at).end()

    def body(self, at: int, stops: str = ";") -> int:
        """The first brace at this level from at, or -1 before a stop."""
        while at < len(self.code):
            c = self.code[at]
            if c == "{":
                return at
            if c in stops or c in ")]}":
                return -1
            at = self.close.get(at, at) + 1 if c in "([" else at + 1
        return -1

    def end_of(self, brace: int) -> int:
        return self.close.get(brace, len(self.code) - 1) + 1

    def squeeze(self, a: int, b: int) -> str:
        return re.sub(r"\s+", " ", self.text[a:b]).strip()


def _inner(c: Code, paren: int) -> str:
    return c.squeeze(paren + 1, c.close.get(paren, paren + 1))


def _make(c: Code, name: str, kind: str, start: int, brace: int, end: int, ret: str | None = None, params: str | None = None) -> Symbol:
    return Symbol(name, kind, start, end, c.squeeze(start, brace if brace >= 0 else end).rstrip(";").rstrip(), ret or None, params)


def _go(c: Code) -> list[Symbol]:
    out = []
    for m in re.finditer(r"^[ \t]*func\b\s*", c.code, re.M):
        at, kind = m.end(), "function"
        if c.code[at : at + 1] == "(":
            at, kind = c.skip(c.close.get(at, at) + 1), "method"
        n = re.compile(r"[^\W\d]\w*").match(c.code, at)
        if not n:
            continue
        at = c.skip(n.end())
        if c.code[at : at + 1] == "[":
            at = c.skip(c.close.get(at, at) + 1)
        if c.code[at : at + 1] != "(" or at not in c.close:
            continue
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        rest = c.close[at] + 1
        line_end = c.code.find("\n", rest)
        brace = c.body(rest, "")
        while brace >= 0 and re.search(r"\b(?:interface|struct)\s*$", c.code[rest:brace]):
            brace = c.body(c.end_of(brace), "")
        if brace < 0 or (line_end >= 0 and c.code[rest:line_end].strip() == "" and brace > line_end):
            brace, end = -1, line_end if line_end >= 0 else len(c.code)
        else:
            end = c.end_of(brace)
        out.append(_make(c, n.group(), kind, start, brace, end, c.squeeze(rest, brace if brace >= 0 else end), _inner(c, at)))
    spec = re.compile(r"([^\W\d]\w*)(?:\[[^\]\n]*\])?[ \t]*=?[ \t]*(?=[\w*\[(<])")
    for m in re.finditer(r"^[ \t]*type\b[ \t]*", c.code, re.M):
        heads = [m.end()]
        if c.code[m.end() : m.end() + 1] == "(":
            inside, heads = c.code[m.end() + 1 : c.close.get(m.end(), m.end())], []
            depth = 0
            for line in re.finditer(r"[^\n]*\n?", inside):
                if not depth and line.group().strip():
                    heads.append(m.end() + 1 + line.start() + len(line.group()) - len(line.group().lstrip()))
                depth += len(re.findall(r"[({\[]", line.group())) - len(re.findall(r"[)}\]]", line.group()))
        for h in heads:
            if n := spec.match(c.code, h):
                line_end = c.code.find("\n", n.end())
                line_end = len(c.code) if line_end < 0 else line_end
                brace = c.code.find("{", n.end(), line_end)
                end = c.end_of(brace) if brace >= 0 else len(c.code[:line_end].rstrip())
                start = m.start() + len(m.group()) - len(m.group().lstrip()) if len(heads) == 1 and c.code[m.end() : m.end() + 1] != "(" else h
                out.append(_make(c, n.group(1), "type", start, brace, end))
    return out


_RUST_HEAD = re.compile(r"(?<![\w.])(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|auto|extern(?:\s+\"[^\"]*\")?|extern\s+)\s+)*(fn|struct|enum|union|trait|impl|const|static|mod|type)\b(?!\s*[!])")


def _rust(c: Code) -> list[Symbol]:
    out = []
    for m in _RUST_HEAD.finditer(c.code):
        word, at = m.group(1), c.skip(m.end())
        if word in ("type", "union"):
            continue
        if word == "impl":
            at = c.skip(c.past_angles(at))
            brace = c.body(at, ";")
            if brace < 0 or re.search(r"[=(,&<>:+|]\s*$", c.code[max(0, m.start() - 20) : m.start()]):
                continue
            head = c.code[at:brace]
            target = re.split(r"\bwhere\b", re.split(r"\bfor\b", head)[-1])[0].strip()
            n = re.match(r"(?:&\s*)?(?:mut\s+)?(?:[\w]+\s*::\s*)*([^\W\d]\w*)", target)
            if n:
                out.append(_make(c, n.group(1), "impl", m.start(), brace, c.end_of(brace)))
            continue
        n = re.compile(r"(?:mut\s+)?(?:r#)?([^\W\d]\w*)").match(c.code, at)
        if not n or word == "const" and n.group(1) in ("fn", "unsafe", "async", "extern"):
            continue
        if word == "fn":
            paren = c.skip(c.past_angles(c.skip(n.end())))
            if c.code[paren : paren + 1] != "(" or paren not in c.close:
                continue
            rest = c.close[paren] + 1
            brace = c.body(rest, ";")
            semi = c.code.find(";", rest)
            end = c.end_of(brace) if brace >= 0 else (semi + 1 if semi >= 0 else len(c.code))
            if brace < 0:
                continue
            head = re.split(r"\bwhere\b", c.code[rest:brace])[0]
            arrow = head.find("->")
            out.append(_make(c, n.group(1), "function", m.start(), brace, end, c.squeeze(rest + arrow + 2, rest + len(head)) if arrow >= 0 else None, _inner(c, paren)))
            continue
        kind = {"mod": "module"}.get(word, word)
        if word in ("const", "static"):
            if not re.match(r"\s*:", c.code[n.end() :]):
                continue
            at2 = n.end()
            while at2 < len(c.code) and c.code[at2] != ";":
                at2 = c.close.get(at2, at2) + 1
            out.append(_make(c, n.group(1), kind, m.start(), -1, min(at2 + 1, len(c.code))))
            continue
        brace = c.body(n.end(), ";")
        semi = c.code.find(";", n.end())
        end = c.end_of(brace) if brace >= 0 else (semi + 1 if semi >= 0 else len(c.code))
        out.append(_make(c, n.group(1), kind, m.start(), brace, end))
    return out


_NOT_CALLS = frozenset("if for while switch catch return function func fn match loop else do typeof sizeof await new delete throw in of case super with assert defined alignof decltype static_assert not and or print_ elif except lambda yield raise del from import struct enum union impl trait class interface type var let const void int char".split())


def _script(c: Code, typed: bool) -> list[Symbol]:
    out = []

    def fn(name: str, kind: str, start: int, paren: int) -> None:
        if c.code[paren : paren + 1] != "(" or paren not in c.close:
            return
        rest = c.skip(c.close[paren] + 1)
        ret = None
        if typed and c.code[rest : rest + 1] == ":":
            at = c.skip(rest + 1)
            # an object type may open the return type: its brace isn't the body
            first = c.end_of(at) if c.code[at : at + 1] == "{" else at
            brace = c.body(first, ";")
            stop = brace if brace >= 0 else first
            ret = c.squeeze(rest + 1, stop)
        else:
            brace = rest if c.code[rest : rest + 1] == "{" else -1
        if brace >= 0:
            out.append(_make(c, name, kind, start, brace, c.end_of(brace), ret, _inner(c, paren)))

    for m in re.finditer(r"(?<![\w$.])(?:async\s+)?function\b\s*\*?\s*([A-Za-z_$][\w$]*)\s*", c.code):
        fn(m.group(1), "function", m.start(), c.skip(c.past_angles(m.end())))
    for m in re.finditer(r"(?<![\w$.])(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)", c.code):
        brace = c.body(m.end(), ";")
        if brace < 0:
            continue
        out.append(_make(c, m.group(1), "class", m.start(), brace, c.end_of(brace)))
        head = re.compile(r"(?:(?:public|private|protected|static|readonly|abstract|override|async|get|set)\s+)*\*?\s*(#?[A-Za-z_$][\w$]*)\s*\??\s*(?=[<(])")
        at, last = brace + 1, c.end_of(brace) - 1
        while at < last:
            at = c.skip(at)
            n = head.match(c.code, at)
            if n and n.group(1) not in _NOT_CALLS | {"constructor_"}:
                paren = c.skip(c.past_angles(n.end()))
                before = len(out)
                fn(n.group(1), "method", at, paren)
                if len(out) > before:
                    at = out[-1].end
                    continue
            nxt = re.compile(r"[;\n{(\[]").search(c.code, at)
            if not nxt or nxt.start() >= last:
                break
            at = c.close.get(nxt.start(), nxt.start()) + 1
    if typed:
        for word, kind in (("interface", "interface"), ("enum", "enum"), ("type", "type_alias")):
            for m in re.finditer(rf"(?<![\w$.])(?:const\s+)?{word}\s+([A-Za-z_$][\w$]*)", c.code):
                if word == "type":
                    eq = c.skip(c.past_angles(c.skip(m.end())))
                    if c.code[eq : eq + 1] != "=":
                        continue
                    at = eq
                    while at < len(c.code) and c.code[at] not in ";\n":
                        at = c.close.get(at, at) + 1
                    out.append(_make(c, m.group(1), kind, m.start(), -1, at + (c.code[at : at + 1] == ";")))
                else:
                    brace = c.body(m.end(), ";")
                    if brace >= 0:
                        out.append(_make(c, m.group(1), kind, m.start(), brace, c.end_of(brace)))
    return out


def _c(c: Code, plus: bool) -> list[Symbol]:
    out = []
    words = "struct|enum|class|namespace" if plus else "struct|enum"
    for m in re.finditer(rf"(?<![\w.])({words})\s+(?:class\s+)?([A-Za-z_]\w*(?:::\w+)*)", c.code):
        if m.group(1) == "class" and re.search(r"(?:enum|<|,)\s*$", c.code[: m.start()][-12:]):
            continue
        brace = re.compile(r"\s*(?:final\s*)?(?::[^;{}()]*)?\{").match(c.code, m.end())
        if brace:
            out.append(_make(c, m.group(2), m.group(1), m.start(), brace.end() - 1, c.end_of(brace.end() - 1)))
    name = r"(?:[A-Za-z_]\w*::)*~?[A-Za-z_]\w*" if plus else r"[A-Za-z_]\w*"
    for m in re.finditer(rf"({name})\s*\(", c.code):
        paren = m.end() - 1
        if paren not in c.close or m.group(1).split("::")[-1] in _NOT_CALLS:
            continue
        tail = re.compile(r"\s*(?:const|noexcept|override|final|\s)*(?:->\s*[\w:<>*& ]+)?\s*(?::\s*[^;{}]*)?\{" if plus else r"\s*\{").match(c.code, c.close[paren] + 1)
        if not tail:
            continue
        left = re.compile(r"[^;{}]*\Z").search(c.code[: m.start()])
        head = left.group() if left else ""
        lead = len(head) - len(head.lstrip())
        start = m.start() - len(head) + lead
        before = head.strip()
        if "(" in before or "=" in before or (not before and not (plus and "::" in m.group(1))):
            continue
        if re.fullmatch(r"(?:public|private|protected)\s*:", before):
            continue
        if plus and (label := re.match(r"(?:(?:public|private|protected)\s*:\s*)+", before)):
            start += label.end()
            before = before[label.end() :]
        before = re.sub(r"\b(?:static|extern|inline|register|_Noreturn|virtual|explicit|constexpr)\b\s*", "", before)
        short = m.group(1).split("::")[-1] if not plus else m.group(1)
        out.append(_make(c, short, "function", start, tail.end() - 1, c.end_of(tail.end() - 1), before, _inner(c, paren)))
    return out


def _chain_start(c: Code, at: int) -> int:
    """Where the call expression around a name begins: before the objects and calls it hangs on."""
    while True:
        dot = re.compile(r"(?:\.|->|::|\?\.)\s*\Z").search(c.code[max(0, at - 12) : at])
        if not dot:
            return at
        at -= len(dot.group())
        at = len(c.code[:at].rstrip())
        while at and c.code[at - 1] in ")]":
            at = c.open.get(at - 1, at - 1)
        word = re.compile(r"[\w$!?]*\Z").search(c.code[max(0, at - 200) : at])
        if not word.group():
            return at
        at -= len(word.group())


def _calls(c: Code, lang: str, defs: list[Symbol]) -> list[Ref]:
    heads = {(s.name.split("::")[-1], s.start) for s in defs}
    out = []
    generic = r"(?:::\s*<[^<>(){};]*(?:<[^<>]*>[^<>(){};]*)*>)?" if lang == "rust" else ""
    for m in re.finditer(rf"(?<![\w$])([A-Za-z_$][\w$]*){generic}\s*\(", c.code):
        name = m.group(1)
        if name in _NOT_CALLS:
            continue
        before = c.code[max(0, m.start() - 12) : m.start()].rstrip()
        if lang == "c" and (before.endswith(".") or before.endswith("->")):
            continue
        if re.search(r"(?<![\w$])(?:func|fn|function|new|class|def)\s*\*?$", before) or lang in ("javascript", "jsx", "typescript", "tsx") and any(s.kind == "method" and s.start <= m.start() < s.start + 60 and s.name == name and c.code[m.start() : m.start() + 1] and c.text[s.start : m.start()].count("(") == 0 for s in defs):
            continue
        if lang in ("c", "cpp") and any(n == name and s <= m.start() <= s + 200 and "{" not in c.code[s : m.start()] for n, s in heads):
            continue
        if lang == "go" and re.search(r"\)\s*$", before) and c.code.rfind("func", 0, m.start()) >= c.code.rfind("\n", 0, m.start()) >= 0 and c.code.rfind("{", 0, m.start()) < c.code.rfind("func", 0, m.start()):
            continue
        if lang in ("c", "cpp") and (w := re.search(r"(\w+)\s*[*&]*$", before)) and w.group(1) not in _NOT_CALLS - {"void", "int", "char"} and not before.endswith(("&&", "*=", "&=")) and re.match(r"\s*(?:const\s*)?;", c.code[c.close.get(m.end() - 1, m.end()) + 1 :]) and not re.search(r"[=+/%!?<>|^-]\s*\w+\s*[*&]$", c.code[max(0, m.start() - 60) : m.start()].rstrip()):
            continue
        out.append(Ref(name, _chain_start(c, m.start())))
    # a method named in an interface is no call
    shapes = [(s.start, s.end) for s in defs if s.kind == "interface" or lang == "go" and s.signature.endswith("interface")]
    out = [r for r in out if not any(a <= r.start < b for a, b in shapes)]
    if lang == "rust":
        for m in re.finditer(r"(?<![\w$])([A-Za-z_]\w*)!\s*[(\[{]", c.code):
            if m.group(1) != "macro_rules":
                out.append(Ref(m.group(1), _chain_start(c, m.start())))
    return sorted(out, key=lambda r: r.start)


def _python(text: str) -> Found:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return Found()
    lines = text.splitlines(keepends=True) or [""]
    raw = [line.encode("utf-8", "surrogatepass") for line in ast._splitlines_no_ff(text)] if hasattr(ast, "_splitlines_no_ff") else [line.encode("utf-8", "surrogatepass") for line in lines]
    starts = [0]
    for line in raw:
        starts.append(starts[-1] + len(line))
    data = b"".join(raw)
    place = lambda row, col: starts[row - 1] + col
    squeeze = lambda a, b: re.sub(r"\s+", " ", data[a:b].decode("utf-8", "replace")).strip()
    out = Found()
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            a, b = place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)
            first = node.body[0]
            body = place(first.lineno, first.col_offset)
            if getattr(first, "decorator_list", None):
                body = min(body, place(first.decorator_list[0].lineno, 0))
            head = data[a:body]
            colon = head.rstrip().rfind(b":")
            signature = squeeze(a, a + colon) if colon >= 0 else squeeze(a, body)
            s = Symbol(node.name, "class" if isinstance(node, ast.ClassDef) else "function", a, b, signature, at=(node.lineno, node.col_offset + 1, node.end_lineno, node.end_col_offset + 1))
            if not isinstance(node, ast.ClassDef):
                args = [x for x in (*node.args.posonlyargs, *node.args.args, node.args.vararg, *node.args.kwonlyargs, node.args.kwarg) if x]
                open_ = head.find(b"(", head.find(node.name.encode()))
                stop, depth = open_, 0
                for i in range(open_, len(head)):
                    depth += (head[i : i + 1] in (b"(", b"[", b"{")) - (head[i : i + 1] in (b")", b"]", b"}"))
                    if not depth:
                        stop = i
                        break
                s.params = squeeze(a + open_ + 1, a + stop) if args or stop > open_ else ""
                if node.returns is not None:
                    s.return_type = squeeze(place(node.returns.lineno, node.returns.col_offset), place(node.returns.end_lineno, node.returns.end_col_offset))
            out.symbols.append(s)
        elif isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                out.refs.append(Ref(name, place(node.lineno, node.col_offset), at=(node.lineno, node.col_offset + 1)))
    out.refs.sort(key=lambda r: r.start)
    return out


def extract(text: str, language: str) -> Found | None:
    """Definitions, in order of their places and outer before inner, and call sites of a text; None for other languages.

    Each symbol knows the index of the definition around it, each call site that of the innermost definition it stands in; -1
    for none.
    """
    if language not in LANGUAGES:
        return None
    if language == "python":
        found = _python(text)
    else:
        c = Code(text, _FAMILY[language])
        if language == "go":
            symbols = _go(c)
        elif language == "rust":
            symbols = _rust(c)
        elif language in ("c", "cpp"):
            symbols = _c(c, language == "cpp")
        else:
            symbols = _script(c, language in ("typescript", "tsx"))
        found = Found(symbols, _calls(c, language, symbols))
        _places(text, found)
    found.symbols.sort(key=lambda s: (s.start, -s.end))
    around: list[int] = []
    for i, s in enumerate(found.symbols):
        while around and found.symbols[around[-1]].end <= s.start:
            around.pop()
        s.parent = around[-1] if around else -1
        around.append(i)
    todo, around = iter(sorted(found.refs, key=lambda r: r.start)), []
    nxt = 0
    for r in todo:
        while nxt < len(found.symbols) and found.symbols[nxt].start <= r.start:
            while around and found.symbols[around[-1]].end <= found.symbols[nxt].start:
                around.pop()
            around.append(nxt)
            nxt += 1
        while around and found.symbols[around[-1]].end <= r.start:
            around.pop()
        r.inside = around[-1] if around else -1
    return found


def _places(text: str, found: Found) -> None:
    """Lines and byte columns of all character offsets, in one pass."""
    marks = sorted({x for s in found.symbols for x in (s.start, s.end)} | {r.start for r in found.refs})
    at: dict[int, tuple[int, int]] = {}
    line, begin, last = 1, 0, 0
    for x in marks:
        n = text.count("\n", last, x)
        if n:
            line += n
            begin = text.rfind("\n", 0, x) + 1
        last = x
        at[x] = (line, len(text[begin:x].encode("utf-8", "surrogatepass")) + 1)
    for s in found.symbols:
        s.at = (*at[s.start], *at[s.end])
    for r in found.refs:
        r.at = at[r.start]


SYMBOL_SCHEMA = "blob_id long, is_ref boolean, idx int, parent_idx int, name string, kind string, line int, col int, end_line int, end_col int, signature string, return_type string, params string"
_NAMES = [c.split()[0] for c in SYMBOL_SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]


def _extract_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[] for _ in _NAMES]
        for blob, lang, text in zip(b.column("blob_id").to_pylist(), b.column("language").to_pylist(), b.column("content").to_pylist()):
            found = extract(text, lang)
            if found:
                for i, s in enumerate(found.symbols):
                    for c, v in zip(cols, (blob, False, i, s.parent, s.name, s.kind, *s.at, s.signature, s.return_type, s.params)):
                        c.append(v)
                for i, r in enumerate(found.refs):
                    for c, v in zip(cols, (blob, True, i, r.inside, r.name, r.kind, *r.at, None, None, None, None, None)):
                        c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)


def extract_symbols(texts: DataFrame) -> DataFrame:
    """Definitions and call sites (SYMBOL_SCHEMA) of texts (blob_id, language, content); other languages and nulls have none."""
    return texts.where(F.col("language").isin(*LANGUAGES) & F.col("content").isNotNull()).select("blob_id", "language", "content").mapInArrow(_extract_all, SYMBOL_SCHEMA)


def symbol_tables(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The symbols and symbol_refs tables of extracted rows. Ids are hashes of a row's blob and index, so parents and containers
    need no second pass, and a call site outside all definitions has a null container."""
    sid = lambda idx: F.when(F.col(idx) >= 0, F.xxhash64(F.lit("symbol"), "blob_id", idx))
    symbols = extracted.where("NOT is_ref").select(sid("idx").alias("id"), "blob_id", sid("parent_idx").alias("parent_id"), "name", "kind", "line", "col", "end_line", "end_col", "signature", "return_type", "params")
    refs = extracted.where("is_ref").select(F.xxhash64(F.lit("ref"), "blob_id", "idx").alias("id"), "blob_id", sid("parent_idx").alias("symbol_id"), F.col("name").alias("ref_name"), "kind", "line", "col")
    return symbols, refs


def register_function(spark) -> None:
    """extract_symbols(content, language) as a table function of SQL, for lateral joins; the columns are those of SYMBOL_SCHEMA without the blob."""

    class ExtractSymbols:
        def eval(self, content: str, language: str):
            found = extract(content, language) if content is not None and language is not None else None
            for i, s in enumerate(found.symbols if found else ()):
                yield (False, i, s.parent, s.name, s.kind, *s.at, s.signature, s.return_type, s.params)
            for i, r in enumerate(found.refs if found else ()):
                yield (True, i, r.inside, r.name, r.kind, *r.at, None, None, None, None, None)

    spark.udtf.register("extract_symbols", udtf(ExtractSymbols, returnType=SYMBOL_SCHEMA.partition(", ")[2], useArrow=True))
