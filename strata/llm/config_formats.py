"""Configuration formats read into key paths with offsets: JSON, YAML, TOML, INI, env and properties files.

The parsers accept whole files and fragments, such as one side of a diff: what doesn't fit is passed over, and closing
marks without an opening one are ignored. Offsets count characters of the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Entry:
    """A scalar: its key path, where it stands (without quotes), whether it was quoted, and the mapping that it is in."""

    path: tuple[str, ...]
    start: int
    end: int
    quoted: bool
    frame: int


@dataclass
class Parsed:
    kind: str
    entries: list[Entry] = field(default_factory=list)
    #: comments and embedded scripts, as (start, end)
    other: list[tuple[int, int]] = field(default_factory=list)
    frames: int = 0

    def frame(self) -> int:
        self.frames += 1
        return self.frames

    def add(self, path: tuple[str, ...], start: int, end: int, quoted: bool, frame: int) -> None:
        if end > start:
            self.entries.append(Entry(path, start, end, quoted, frame))


_TOKEN = re.compile(r'"(?:[^"\\\n]|\\.)*"?|\'(?:[^\'\\\n]|\\.)*\'?|[{}\[\],]|(?://|#)[^\n]*|[:=]|[^\s{}\[\],:="\'][^{}\[\],:=\n]*')


def flow(text: str, at: int, stop: int, out: Parsed, path: tuple[str, ...] = ()) -> int:
    """Read nested braces and brackets from at, with quoted or bare scalars and : or = behind keys. Ends where the first of them closes, or at stop."""
    stack: list[tuple[tuple[str, ...], int]] = []
    base, frame, key = path, out.frame(), None
    for m in _TOKEN.finditer(text, at, stop):
        tok = m.group()
        c = tok[0]
        if c in "{[":
            stack.append((base, frame))
            base, key = (base if key is None else (*base, key)), None
            if c == "{":
                frame = out.frame()
        elif c in "}]":
            if stack:
                base, frame = stack.pop()
                if not stack and path:
                    return m.end()
            key = None
        elif c == ",":
            key = None
        elif c in ":=":
            continue
        elif tok.startswith("//") or c == "#":
            out.other.append((m.start(), m.end()))
        else:
            quoted = c in "\"'"
            a, b = m.start(), m.end()
            if quoted:
                a, b = a + 1, b - (len(tok) > 1 and tok[-1] == c)
            else:
                b = a + len(tok.rstrip())
            rest = m.end()
            while rest < stop and text[rest] in " \t":
                rest += 1
            if rest < stop and text[rest] in ":=" and key is None:
                key = text[a:b]
            else:
                out.add(base if key is None else (*base, key), a, b, quoted, frame)
    return stop


def _quoted(text: str, at: int, stop: int) -> tuple[int, int, int]:
    """(begin, end, behind) of the quoted scalar at at, triple quotes included; one without an end goes to stop."""
    q = text[at]
    if text.startswith(q * 3, at):
        end = text.find(q * 3, at + 3)
        return (at + 3, end, end + 3) if 0 <= end else (at + 3, stop, stop)
    i = at + 1
    while i < len(text):
        if text[i] == "\\" and q == '"':
            i += 2
            continue
        if text[i] == q:
            if q == "'" and text.startswith("''", i):
                i += 2
                continue
            return at + 1, i, i + 1
        i += 1
    return at + 1, stop, stop


def _scalar(text: str, at: int, stop: int, path: tuple[str, ...], out: Parsed, frame: int, marks: str) -> int:
    """Read the value that begins at at, of a line that ends at stop; returns where reading goes on."""
    if at >= stop:
        return stop
    c = text[at]
    if c in "\"'":
        a, b, behind = _quoted(text, at, stop)
        out.add(path, a, b, True, frame)
        end = text.find("\n", behind - 1) if behind > stop else stop
        end = len(text) if end < 0 else end
        if (h := text.find("#", behind, end)) >= 0:
            out.other.append((h, end))
        return end
    if c in "{[":
        end = flow(text, at, len(text), out, path)
        line = text.find("\n", end)
        return len(text) if line < 0 else line
    end = stop
    for mark in marks:
        h = at
        while (h := text.find(mark, h + 1, end)) >= 0:
            if text[h - 1] in " \t":
                out.other.append((h, end))
                end = h
                break
    value = text[at:end].rstrip()
    out.add(path, at, at + len(value), False, frame)
    return stop


_YAML_KEY = re.compile(r"""([ \t]*)((?:-[ \t]+)*)(?:"([^"\n]*)"|'([^'\n]*)'|([^\s#:\[\]{},"'&*!|>%@`][^:#\n]*?))[ \t]*:(?=[ \t\r\n]|$)[ \t]*""")
_YAML_ITEM = re.compile(r"([ \t]*)((?:-[ \t]+)+)")


def yaml(text: str) -> Parsed:
    out = Parsed("yaml")
    stack: list[tuple[int, str | None, int]] = []  # indent, key (None for a list item), frame of its content
    root, at = out.frame(), 0
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        body = text[at:stop].strip()
        if not body or body in ("---", "..."):
            at = stop + 1
            continue
        if body[0] == "#":
            out.other.append((at, stop))
            at = stop + 1
            continue
        m = _YAML_KEY.match(text, at)
        item = _YAML_ITEM.match(text, at)
        indent = len(m.group(1)) if m else len(item.group(1)) if item else len(text[at:stop]) - len(text[at:stop].lstrip())
        dash = (m.group(2) if m else item.group(2) if item else "")
        if not m and not item and stack:
            # a scalar on a line of its own belongs to the key above
            a = at + indent
            path = tuple(k for i, k, _ in stack if k is not None and i < indent)
            at = _scalar(text, a, len(text[:stop].rstrip()) if text[stop - 1] == "\r" else stop, path, out, stack[-1][2], "#") + 1
            continue
        own = indent + len(dash)
        while stack and stack[-1][0] >= (own if not dash else indent + 1):
            stack.pop()
        if dash:
            stack.append((indent + 1 if own > indent + 1 else indent, None, out.frame()))
        path = tuple(k for _, k, _ in stack if k is not None)
        frame = stack[-1][2] if stack else root
        if not m:
            at = _scalar(text, item.end(), stop, path, out, frame, "#") + 1 if item else stop + 1
            continue
        key = next(g for g in m.groups()[2:] if g is not None)
        a = min(m.end(), stop)
        while a < stop and (t := re.match(r"(?:&|!)\S*[ \t]+", text[a:stop])):
            a += t.end()
        path = (*path, key)
        rest = text[a:stop].strip()
        if not rest or rest[0] == "#":
            stack.append((own, key, out.frame()))
            at = stop + 1
        elif rest[0] in "|>":
            # a block: its lines are indented more than its key
            at, lines = stop + 1, []
            while at < len(text):
                end = text.find("\n", at)
                end = len(text) if end < 0 else end
                line = text[at:end]
                if line.strip() and len(line) - len(line.lstrip()) <= indent:
                    break
                if line.strip():
                    lines.append((at + len(line) - len(line.lstrip()), at + len(line.rstrip())))
                at = end + 1
            if len(lines) == 1:
                out.add(path, *lines[0], False, frame)
            else:
                out.other += lines
        elif rest[0] == "*":
            at = stop + 1
        else:
            at = _scalar(text, a, stop, path, out, frame, "#") + 1
    return out


_SECTION = re.compile(r"[ \t]*\[{1,2}([^\]\n]+)\]{1,2}[ \t]*(?:[#;][^\n]*)?\r?$", re.M)
_PAIR = re.compile(r"""[ \t]*(?:export[ \t]+|set[ \t]+|local[ \t]+|readonly[ \t]+)?(?:"([^"\n]+)"|'([^'\n]+)'|([A-Za-z_$][\w$.\-/]*))[ \t]*(?:[:?+]?=|:(?=[ \t]))[ \t]*""")


def pairs(text: str) -> Parsed:
    """TOML, INI, env and properties files: sections, and keys with = or : before their values."""
    out = Parsed("pairs")
    section: tuple[str, ...] = ()
    frame, at = out.frame(), 0
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        body = text[at:stop].strip()
        if not body:
            at = stop + 1
        elif body[0] in "#;!" or body.startswith("//"):
            out.other.append((at, stop))
            at = stop + 1
        elif m := _SECTION.match(text, at):
            section, frame = tuple(k.strip(" \"'") for k in m.group(1).split(".")), out.frame()
            at = stop + 1
        elif (m := _PAIR.match(text, at)) and m.end() <= stop:
            key = next(g for g in m.groups() if g is not None)
            a = m.end()
            if text[a:stop].strip() == "\\" and stop < len(text):
                # the value goes on in the next line
                a = stop + 1
                stop = text.find("\n", a)
                stop = len(text) if stop < 0 else stop
                while a < stop and text[a] in " \t":
                    a += 1
            at = _scalar(text, a, stop, (*section, *(key.split(".") if m.group(3) else (key,))), out, frame, "#;") + 1
        else:
            out.other.append((at, stop))
            at = stop + 1
    return out


_JSON_HEAD = re.compile(r'\s*(?:[{\[]\s*)+(?:"(?:[^"\\\n]|\\.)*"\s*[:,\]]|[\]}]|-?\d[\d.eE+-]*\s*[,\]]|(?:true|false|null)\s*[,\]])')
_JSON_LINE = re.compile(r'\s*(?:[{}\[\]],?|"(?:[^"\\]|\\.)*"\s*:\s*(?:[{\[].*|"(?:[^"\\]|\\.)*",?|[\w.+-]+,?)|"(?:[^"\\]|\\.)*",?)\s*$')
_YAML_LINE = re.compile(r"""\s*(?:-[ \t]+)*(?:"[^"\n]*"|'[^'\n]*'|[A-Za-z_$<.][\w$<>./ -]*):(?:\s[^;]*)?$|\s*-[ \t]+[^;{}()]*$|---\s*$""")
_PAIR_LINE = re.compile(r"""\s*(?:\[{1,2}[\w."' :/-]+\]{1,2}|(?:export[ \t]+)?["']?[A-Za-z_$][\w$.\-/]*["']?[ \t]*=[^=;(){]*(?:[ \t]*[{][^;()]*)?|(?:export[ \t]+)?[A-Za-z_$][\w$.\-/]*[ \t]*=[ \t]*(?:"[^"]*"|'[^']*')[ \t]*(?:[#;].*)?)\s*$""")


def parse(text: str) -> Parsed | None:
    """The text read in the configuration format that it is in, None if it is in none: nine in ten of its lines must fit."""
    if _JSON_HEAD.match(text):
        out = Parsed("json")
        flow(text, 0, len(text), out)
        return out
    lines = [line for line in text.split("\n") if (s := line.strip()) and s[0] not in "#;"]
    if not lines:
        return None
    for fits, read in ((_JSON_LINE, "json"), (_PAIR_LINE, pairs), (_YAML_LINE, yaml)):
        if sum(bool(fits.match(line.rstrip("\r"))) for line in lines) >= 0.9 * len(lines):
            if read == "json":
                if not any(line.lstrip()[0] == '"' for line in lines):
                    continue
                out = Parsed("json")
                flow(text, 0, len(text), out)
                return out
            return read(text)
    if sum(bool(_YAML_LINE.match(line.rstrip("\r"))) for line in lines) >= 0.5 * len(lines) and _only_blocks(lines):
        return yaml(text)
    return None


def _only_blocks(lines: list[str]) -> bool:
    """Whether all lines that are no YAML by themselves lie in blocks, below a line that ends with | or >."""
    block = -1
    for line in lines:
        indent = len(line) - len(line.lstrip())
        if block >= 0 and indent > block:
            continue
        block = -1
        if not _YAML_LINE.match(line.rstrip("\r")):
            return False
        if re.search(r":[ \t]*[|>][+-]?\d*[ \t]*\r?$", line):
            block = indent
    return True
