"""Source files that do not parse: lexers, the languages, and the per-file check.

Each text is split into tokens by its language's lexical rules and the whole token stream is parsed by LALR(1) tables
built from the bundled grammars (``grammars``, ``lalr``). A file's first unrecoverable error is the first token at which
no derivation of the grammar can go on.
"""

from __future__ import annotations

import functools
import re

import numpy as np

from strata.llm import grammars
from strata.llm.lalr import Tables

#: Token spellings remembered for each language; the memory is emptied when it is full.
MEMO = 50_000


def _either(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


class Track(list):
    """Terminals with the place in the text of each, for reports: append notes where the token now read begins."""

    def __init__(self):
        super().__init__()
        self.at, self.where, self.skipped = 0, [], 0
        self.text = ""

    def append(self, i: int) -> None:
        self.where.append(self.at)
        super().append(i)

    def __iadd__(self, items):
        for i in items:
            self.append(i)
        return self

    def pop(self) -> int:
        self.where.pop()
        return super().pop()


class Language:
    """Lexer and tables of one language. classes: spellings that stand for a class of the grammar."""

    grammar = ""
    prefer: tuple[str, ...] = ()
    binary = ""
    assigning = ""
    classes: dict[str, str] = {}
    trivia = r"(?:[ \t\r\n\f\v]++|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)*+"
    literals = ""
    name = r"[^\W\d]\w*+"
    number = r"(?:0[xX][0-9a-fA-F_]++|0[bB][01_]++|0[oO][0-7_]++|(?:\d[\d_]*+(?:\.(?![.\w])|\.\d[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d[\d_]*+)?)(?!\w)"

    def __init__(self):
        self.tables = Tables(self.grammar, self.prefer)
        t = self.tables.term
        spell = {w: t["BOP"] for w in self.binary.split()} | {w: t["ASG"] for w in self.assigning.split()} | {w: t[c] for w, c in self.classes.items()}
        self.known = {w: i for w, i in t.items() if w and not w.isupper()}
        for w, i in spell.items():
            self.known.setdefault(w, i)
        self.memo = dict(self.known)
        marks = [w for w in self.known if not (w[0].isalpha() or w[0] == "_")]
        self.pattern = re.compile(f"{self.trivia}({self.literals}{self.name}|{self.number}|/\\*|{_either(marks)}|\\Z|[\\s\\S])")

    def kind(self, s: str) -> int:
        """Terminal of a token that is no keyword or mark; 0 if it is no token."""
        t, c = self.tables.term, s[0]
        if s[-1] in "\"'`#" and len(s) > 1 and (c in "\"'`" or s[-1] != "#" or '"' in s):
            return t.get("CHAR", t["STR"]) if c == "'" or s[:2] == "b'" else t["STR"]
        if c.isalpha() or c in "_$" or ord(c) > 127 and re.match(r"\w", c):
            return t.get("NAME", 0)
        if c.isdigit() or c == "." and len(s) > 1:
            return t["NUM"]
        return 0

    def ids(self, toks: list[str]) -> list[int]:
        memo, kind = self.memo, self.kind
        if len(memo) > MEMO:
            memo = self.memo = dict(self.known)
        out = []
        for s in toks:
            i = memo.get(s)
            if i is None:
                i = memo[s] = kind(s)
            out.append(i)
        return out

    def tokens(self, text: str, pos: int, track: Track | None):
        """The tokens from pos on; a track is told where each begins before it is handed out."""
        if track is None:
            return self.pattern.findall(text, pos)
        track.text = text

        def each():
            for m in self.pattern.finditer(text, pos):
                track.at = m.start(1)
                yield m.group(1)

        return each()

    def lex(self, text: str, track: Track | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Terminals with the end (1) last, and where an ASI terminal may stand."""
        toks = self.tokens(text, 0, track)
        if track is not None:
            for s in toks:
                if s:
                    track += self.ids([s])
            return np.array([*track, 1], np.int32), None
        if self.pattern.groups > 1:
            toks = [t[0] for t in toks]
        while toks and not toks[-1]:
            toks.pop()
        return np.array([*self.ids(toks), 1], np.int32), None

    def check_many(self, texts: list[str]) -> list[int]:
        """For each text the number of its first bad token, or -1."""
        lexed = [self.lex(t.removeprefix("\ufeff")) for t in texts]
        soft = [s for _, s in lexed] if self.tables.asi else None
        failed, met = self.tables.parse_many([s for s, _ in lexed], soft)
        for i in np.flatnonzero((failed >= 0) & met):
            failed[i] = self.tables.parse_general(*lexed[i])
        return [int(f) for f in failed]


class Json(Language):
    grammar = grammars.JSON
    trivia = r"[ \t\r\n]*+"
    literals = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|'
    number = r"-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?(?!\w)"

    def kind(self, s: str) -> int:
        c = s[0]
        return self.tables.term["STR"] if c == '"' and len(s) > 1 else self.tables.term["NUM"] if c.isdigit() or c == "-" and len(s) > 1 else 0


class Python(Language):
    grammar = grammars.PYTHON
    binary = "// % & ^ << >> == != <= >="
    assigning = "+= -= *= /= //= %= @= &= |= ^= >>= <<= **="
    trivia = r"(?:[ \t\f]++|\\\r?\n)*+"
    literals = (
        r"(?:\#[^\r\n]*+)?(?:(?:\r\n|\r|\n)[ \t\f]*+(?:\#[^\r\n]*+)?)++|\#[^\r\n]*+|"
        r"(?:[rRuUbBfFtT]{0,2})(?:'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''|\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'(?!'')(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*+'|\"(?!\"\")(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*+\")|"
    )
    number = r"(?:0[xX](?:_?[0-9a-fA-F])++|0[bB](?:_?[01])++|0[oO](?:_?[0-7])++|(?:(?:[1-9](?:_?\d)*+|0(?:_?0)*+)(?![\d.eEjJ])|(?:\d(?:_?\d)*+\.?(?:\d(?:_?\d)*+)?|\.\d(?:_?\d)*+)(?:[eE][+-]?\d(?:_?\d)*+)?[jJ]?))(?!\w)"

    def lex(self, text: str, track: Track | None = None) -> tuple[np.ndarray, None]:
        t = self.tables.term
        nl, ind, out_ = t["NL"], t["IN"], t["OUT"]
        memo, kind = self.memo, self.kind
        if len(memo) > MEMO:
            memo = self.memo = dict(self.known)
        out: list[int] = [] if track is None else track
        depth, levels, line = 0, [0], False
        first = re.match(r"(?:[ \t\f]*(?:#[^\r\n]*)?(?:\r\n|\r|\n))*([ \t\f]*)", text)
        begin = self.pattern.match(text, first.start(1)).group(1)
        toks = self.tokens(text, first.start(1), track)
        pending = first.group(1) if first.group(1) and begin and begin[0] not in "#\r\n" else None
        if pending:
            levels.append(len(pending.expandtabs(8)))
            if track is not None:
                track.at = first.start(1)
            out.append(ind)
        for s in toks:
            if not s:
                continue
            c = s[0]
            if c in "#\r\n":
                if depth or not line or (c == "#" and "\n" not in s and "\r" not in s):
                    continue
                out.append(nl)
                if track is not None:
                    track.at += len(s)
                line = False
                rest = re.split(r"[\r\n]", s)[-1]
                if "#" in rest:
                    continue
                width = len(rest.rpartition("\f")[2].expandtabs(8))
                pending = width
                if width > levels[-1]:
                    levels.append(width)
                    out.append(ind)
                else:
                    while width < levels[-1]:
                        levels.pop()
                        out.append(out_)
                    if width != levels[-1]:
                        out.append(0)
                continue
            line = True
            i = memo.get(s)
            if i is None:
                i = memo[s] = kind(s)
            if c in "([{":
                depth += 1
            elif c in ")]}" and depth:
                depth -= 1
            out.append(i)
        # blank lines at the end may have moved the indentation of nothing
        if line:
            out.append(nl)
        while out and out[-1] in (ind, out_):
            out.pop()
        level = sum(1 if i == ind else -1 if i == out_ else 0 for i in out)
        out += [out_] * max(level, 0)
        return np.array([*out, 1], np.int32), None

    def kind(self, s: str) -> int:
        c = s[0]
        if s[-1] in "\"'" and len(s) > 1:
            return self.tables.term["STR"]
        if c.isdigit() or c == "." and len(s) > 1:
            return self.tables.term["NUM"]
        return self.tables.term["NAME"] if s.isidentifier() else 0


class Script(Language):
    """JavaScript modules: regex literals, templates and automatic semicolons need the token before."""

    grammar = grammars.JAVASCRIPT
    binary = "== != === !== <= >= && || ?? ^ % ** << >> >>>"
    assigning = "+= -= *= /= %= **= <<= &= |= ^= &&= ||= ??= >>= >>>="
    classes = {"++": "INC", "--": "INC", "/": "/", "`": "TPL"}
    literals = r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*+'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*+\"|`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+`|#[^\W\d][\w$]*+|"
    name = r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})(?:[\w$]|\\u[0-9a-fA-F]{4})*+"
    number = r"(?:0[xX][0-9a-fA-F_]++n?|0[bB][01_]++n?|0[oO][0-7_]++n?|(?:\d[\d_]*+n|(?:\d[\d_]*+(?:\.[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d[\d_]*+)?))(?![\w$])"
    splits = False
    regex = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*+\])++/\w*+")
    chunk = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(`|\$\{)")

    def __init__(self):
        super().__init__()
        t = self.tables.term
        self.words = {t[w] for w in ("return", "break", "continue", "throw") if w in t}
        ends = ["NAME", "NUM", "STR", "TPL", "TTAIL", "REGEX", "PRIVATE", ")", "]", "}", "this", "super", "null", "true", "false", "INC"]
        ends += [w for w in t if w.isalpha() and w.islower() and w in ("as", "from", "of", "get", "set", "static", "async", "type", "namespace", "module", "declare", "abstract", "readonly", "public", "private", "protected", "override", "is", "infer", "satisfies", "asserts", "unique", "global", "let")]
        self.operand = {t[w] for w in ends}
        self.special = {"{", "}", "`", "/", "/="}

    def kind(self, s: str) -> int:
        t, c = self.tables.term, s[0]
        if c in "'\"" and len(s) > 1:
            return t["STR"]
        if c == "`":
            return t["TPL"] if len(s) > 1 else 0
        if c == "#":
            return t["PRIVATE"] if len(s) > 1 else 0
        if c.isdigit() or c == "." and len(s) > 1 and s[1].isdigit():
            return t["NUM"]
        return t["NAME"] if c.isalpha() or c in "_$\\" and len(s) > 0 and (c != "\\" or len(s) > 1) else 0

    def lex(self, text: str, track: Track | None = None) -> tuple[np.ndarray, np.ndarray]:
        t = self.tables.term
        memo, kind, operand, words, asi = self.memo, self.kind, self.operand, self.words, t["ASI"]
        if len(memo) > MEMO:
            memo = self.memo = dict(self.known)
        inc, close, thead, tmid, ttail, regex_id = t["INC"], t["}"], t["THEAD"], t["TMID"], t["TTAIL"], t["REGEX"]
        out: list[int] = [] if track is None else track
        soft: list[bool] = []
        put, mark, special = out.append, soft.append, self.special
        pos, prev, open_, depth = 0, -1, [], 0
        if text.startswith("#!"):
            pos = (text.find("\n") + 1) or len(text)
        going = True
        while going:
            # the iterator goes on until a regex literal or template moves the position
            for m in self.pattern.finditer(text, pos):
                s = m.group(1)
                if not s:
                    going = False
                    break
                start, end = m.span(1)
                if track is not None:
                    track.at, track.text = start, text
                fresh = start > pos and text.find("\n", pos, start) >= 0
                pos = end
                i = memo.get(s)
                if i is None:
                    i = memo[s] = kind(s)
                moved = False
                if s in special:
                    if s == "{":
                        depth += 1
                    elif s == "}":
                        if open_ and open_[-1] == depth:
                            r = self.chunk.match(text, end)
                            if not r:
                                i = 0
                            else:
                                pos, moved = r.end(), True
                                i = tmid if r.group(1) == "${" else ttail
                                if i == ttail:
                                    open_.pop()
                        else:
                            depth -= 1
                    elif s == "`":
                        r = self.chunk.match(text, end)
                        if not r:
                            i = 0
                        else:
                            pos, moved = r.end(), True
                            open_.append(depth)
                            i = thead
                    elif prev not in operand:
                        if r := self.regex.match(text, start):
                            i, pos, moved = regex_id, r.end(), True
                        else:
                            i = 0
                if fresh and (prev in words or i == inc and prev in operand):
                    put(asi)
                    mark(False)
                put(i)
                mark(fresh or i == close)
                prev = i
                if moved:
                    break
            else:
                going = False
        soft.append(True)
        return np.array([*out, 1], np.int32), np.array(soft, bool)


class TypeScript(Script):
    grammar = grammars.TYPESCRIPT
    prefer = ("Un", "UnN")
    binary = "== != === !== <= && || ?? ^ % ** <<"
    assigning = "+= -= *= /= %= **= <<= &= |= ^= &&= ||= ??="


class Go(Language):
    grammar = grammars.GO
    binary = "== != < <= > >= && || % / << >> &^"
    assigning = "+= -= *= /= %= &= |= ^= <<= >>= &^="
    classes = {"++": "INC", "--": "INC"}
    trivia = r"(?:[ \t\r]++|//[^\n]*+)*+"
    literals = r"\n|/\*(?:[^*]|\*(?!/))*+\*/|`[^`]*+`|\"(?:[^\"\\\n]|\\(?:[abfnrtv\\\"]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}))*+\"|'(?:[^'\\\n]|\\(?:[abfnrtv\\']|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}))'|"
    number = r"(?:0[xX][0-9a-fA-F_]++(?:\.[0-9a-fA-F_]*+)?(?:[pP][+-]?\d[\d_]*+)?|0[bB][01_]++|0[oO][0-7_]++|(?:\d[\d_]*+(?:\.[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d[\d_]*+)?)i?(?!\w)"

    def __init__(self):
        super().__init__()
        t = self.tables.term
        self.enders = {t[w] for w in ("NAME", "NUM", "STR", "CHAR", "INC", "break", "continue", "fallthrough", "return", ")", "]", "}")}

    def lex(self, text: str, track: Track | None = None) -> tuple[np.ndarray, None]:
        memo, kind, enders, semi = self.memo, self.kind, self.enders, self.tables.term[";"]
        if len(memo) > MEMO:
            memo = self.memo = dict(self.known)
        out, prev = [] if track is None else track, 0
        for s in self.tokens(text, 0, track):
            if s == "\n" or s[:2] == "/*" and len(s) > 3 and "\n" in s:
                if prev in enders:
                    out.append(semi)
                    prev = semi
                continue
            if s[:2] == "/*" and len(s) > 3 or not s:
                continue
            i = memo.get(s)
            if i is None:
                i = memo[s] = kind(s)
            out.append(i)
            prev = i
        if prev in enders:
            out.append(semi)
        return np.array([*out, 1], np.int32), None


class Java(Language):
    grammar = grammars.JAVA
    prefer = ("Prim",)
    binary = "== != <= && || ^ % <<"
    assigning = "+= -= *= /= %= &= |= ^= <<="
    classes = {"++": "INC", "--": "INC"} | dict.fromkeys("true false null".split(), "LIT") | dict.fromkeys("boolean byte short int long char float double".split(), "PRIMITIVE")
    literals = r'"""[ \t\f]*+\r?\n(?:[^"\\]|\\[\s\S]|"(?!""))*+"""|"(?:[^"\\\n\r]|\\(?:[btnfrs0-7"\'\\]|u++[0-9a-fA-F]{4}))*+"|\'(?:[^\'\\\n\r]|\\(?:[btnfrs"\'\\]|[0-7]{1,3}|u++[0-9a-fA-F]{4}))\'|'
    name = r"(?:[^\W\d]|\$)[\w$]*+"
    number = r"(?:0[xX][0-9a-fA-F_]*+(?:\.[0-9a-fA-F_]*+)?(?:[pP][+-]?\d[\d_]*+)?|0[bB][01_]++|(?:\d[\d_]*+(?:\.[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d[\d_]*+)?)[lLfFdD]?(?![\w$])"


class CLang(Language):
    grammar = grammars.C
    prefer = ("Prim",)
    binary = "/ % + - << >> < > <= >= == != ^ | && ||"
    assigning = "+= -= *= /= %= <<= >>= &= ^= |="
    classes = {"++": "INC", "--": "INC", "__asm__": "asm", "__const": "const", "__restrict": "restrict", "__restrict__": "restrict", "__volatile__": "volatile", "__typeof__": "typeof"} | dict.fromkeys("void char short int long float double signed unsigned _Bool _Complex _Imaginary".split(), "WORD") | dict.fromkeys("typedef extern auto register inline _Noreturn _Thread_local __inline __inline__ __extension__".split(), "STORAGE")
    trivia = r"(?:[ \t\r\n\f\v]++|\\\r?\n|//(?:[^\n\\]|\\\r?\n|\\)*+|/\*(?:[^*]|\*(?!/))*+\*/|(?:(?<=\n)|(?<![\s\S]))[ \t]*+\#(?:[^\n\\/\"]|\\\r?\n|\\|/\*(?:[^*]|\*(?!/))*+\*/|//[^\n]*+|/|\"(?:[^\"\\\n]|\\[\s\S])*+\"|\")*+)*+"
    literals = r"(?:u8|[uUL])?(?:\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])++')|"
    number = r"\.?\d(?:[eEpP][+-]|[\w.])*+"

    def kind(self, s: str) -> int:
        t = self.tables.term
        if s[-1] == "'" and len(s) > 2:
            return t["CHAR"]
        if s[0].isdigit() or s[0] == "." and len(s) > 1:
            ok = re.fullmatch(r"(?:0[xX][0-9a-fA-F]+|0[bB][01]+|0[0-7]*|[1-9]\d*)[uUlL]{0,3}|(?:\d+\.\d*|\.\d+|\d+(?=[eE]))(?:[eE][+-]?\d+)?[fFlL]?|0[xX][0-9a-fA-F]*\.?[0-9a-fA-F]*[pP][+-]?\d+[fFlL]?", s)
            return t["NUM"] if ok else 0
        return super().kind(s)

    def lex(self, text: str, track: Track | None = None) -> tuple[np.ndarray, None]:
        if "#" in text:
            if track is not None:
                track.skipped = text.count("\n", 0, len(text) - len(text.lstrip()))
            text = re.sub(r"(?<=\n)[ \t]+(?=#)", "", text.lstrip())
        return super().lex(text, track)


class Rust(Language):
    grammar = grammars.RUST
    binary = "== != <= >= ^ % / <<"
    assigning = "+= -= *= /= %= ^= &= |= <<="
    trivia = r"(?:[ \t\r\n\f\v]++|//[^\n]*+|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*+\*/)*+\*/)*+"
    literals = r"[bc]?r(\#*+)\"[\s\S]*?\"\2|[bc]?\"(?:[^\"\\]|\\[\s\S])*+\"|b?'(?:[^'\\\n]|\\(?:[nrt0'\"\\]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))'|'[^\W\d]\w*+|r\#[^\W\d]\w*+|"
    number = r"(?:0x[0-9a-fA-F_]++|0b[01_]++|0o[0-7_]++|\d[\d_]*+(?:\.(?![.\w])|\.\d[\d_]*+)?(?:[eE][+-]?[\d_]++)?)(?:_?(?:[iu](?:8|16|32|64|128|size)|f32|f64))?(?!\w)"

    def kind(self, s: str) -> int:
        t = self.tables.term
        if s[0] == "'" and (len(s) < 3 or s[-1] != "'"):
            return t["LIFE"] if len(s) > 1 else 0
        if s[:2] == "r#" and s[-1] not in '"#':
            return t["NAME"]
        return super().kind(s)

    def lex(self, text: str, track: Track | None = None) -> tuple[np.ndarray, None]:
        if text.startswith("#!") and not text.startswith("#!["):
            text = text[text.find("\n") :] if "\n" in text else ""
        return super().lex(text, track)


CLASSES = {"json": Json, "python": Python, "javascript": Script, "typescript": TypeScript, "go": Go, "java": Java, "c": CLang, "rust": Rust}


@functools.cache
def language(name: str) -> Language:
    """Tables are built once in each process."""
    return CLASSES[name]()


def check_many(name: str, texts: list[str]) -> list[int]:
    """Number of the first bad token of each text in the named language, or -1 where the text is valid."""
    return language(name).check_many(texts)


def line_of(name: str, text: str, at: int) -> int:
    """Line (from 1) on which token number at begins, layout and inserted tokens counted as check_many counts them; the last line for the end of the text."""
    track = Track()
    language(name).lex(text.removeprefix("\ufeff"), track)
    end = len(track.text.rstrip())
    place = min(track.where[at], end) if at < len(track.where) else end
    return track.skipped + track.text.count("\n", 0, place) + 1
