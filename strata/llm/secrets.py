"""Operator: credentials embedded in source code and configuration.

Texts in a configuration format - JSON, YAML, TOML, INI, env and properties - are parsed into key paths with offsets, each
side of a diff by itself, and a value is judged by all keys above it and by its shape. Program code and prose, comments and
scripts inside configuration included, are read line by line for assignments, call arguments, command options and
connection strings. Values of known credential formats, passwords in URLs, HTTP authorisation headers and private-key
blocks count under any key. Redactions are spliced into the original bytes.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm import config_formats

#: Lower-case strings of which a line must hold one to be read closely (fixed values).
TRIGGERS = (
    "pass", "pwd", "pw=", "pw:", "pw ", "pw\t", "pw(", "pw[", "pw]", "pw\"", "pw'", "pw`", "_pw", "secret", "token", "key", "bearer", "basic ", "kennwort", "contrase", "credential", "authorization", "://", "-u ", "-u=", "--user", "akia", "asia", "aiza", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat_",
    "xox", "sk_live", "sk_test", "rk_live", "rk_test", "glpat-", "_pat_", "npm_", "eyj", "sig=", "sk-", "sg.", "rootpw", "adminpw", "userpw", "dbpw",
)
#: Values of known credential formats.
SHAPES = re.compile(
    r"(?<![A-Za-z0-9_])(?:A(?:KIA|SIA)[0-9A-Z]{16}|AIza[\w-]{35}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{30,}|xox[abeprs]-[A-Za-z0-9-]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|glpat-[\w-]{20,}|[a-z]{2,6}_pat_[A-Za-z0-9]{24,}|npm_[A-Za-z0-9]{36}|SG\.[\w-]{20,}\.[\w-]{20,}|sk-[A-Za-z0-9_-]{32,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]*)(?![A-Za-z0-9])"
)
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
URL = re.compile(r"[A-Za-z][\w+.-]*://[^\s:/@\"'`?#]*:([^\s@/\"'`]+)@")
HEADER = re.compile(r"(?i)\b(?:authorization\s*[:=]\s*[\"']?(?:bearer|basic|token|digest)\s+|x-[a-z-]*(?:key|token|secret)\s*[:=]\s*[\"']?|\bbearer\s+(?=[\w.~+/-]{20}))([\w.~+/=-]{12,})")
OPTION = re.compile(r"(?<!\S)(?:-u|--user)[ =]+[\"']?[^\s:\"']+:([^\s\"'`]+)|(?<!\S)--?(?:password|passwd|pass|pwd|token|secret)[ =]+[\"']?([^\s\"'`;]+)")
QUERY = re.compile(r"[?&](?:access_token|auth_token|token|sig|signature|api_?key|key|secret|client_secret|password)=([^&\s\"'`#;]{12,})")
NETRC = re.compile(r"\blogin\s+\S+\s+password\s+(\S+)")
#: A key, what may stand between it and its value, and the value's begin. Keys may be quoted, subscripts or members.
PAIR = re.compile(
    r"(?P<key>[A-Za-z_$][\w$.-]*)[\"'`]?\]?[ \t]*(?:(?::[ \t]*(?:&'?\w*[ \t]*)?[A-Za-z_][\w<>&' ]*?[ \t]*=(?!=)|\[\][ \t]*=|:=|=>|=(?![=~])|:(?!:))[ \t]*|\([ \t]*(?=[\"'`])|[ \t]+(?=\"))(?P<value>(?:[bru]|@)?(?P<q>\"\"\"|'''|[\"'`])|(?=[^\s\"'`]))"
)
PROSE = re.compile(r"(?i)\b(?:passwords?|passwd|passphrase|passwort|kennwort|pw|pwd|mot de passe|contraseña|secret|token|api[ -]key)\b(?:[^\n\"'`=:;(){}]{0,24}?[:=/]|[ ]+(?:is|was|ist|war|est)\b)?[ \t]*(?P<value>[^\s\"'`()<>{}\[\];,$]{8,})")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_PLACEHOLDER = re.compile(
    r"(?i)^(?:<.*>|\$\{?.*|%\w+%|\{\{.*|\{.*\}|\[.*\]|#\{.*|@.*@|\W*|x+|\*+|(.)\1*|none|null|nil|undefined|true|false|string|str|text|todo.*|tbd|fixme|change[_-]?(?:me|it|this).*|replace[_-]?.*|your[_-].*|my[_-]?(?:password|secret|token|key).*|.*_here|insert.*|enter.*|example.*|dummy.*|placeholder.*|redacted|masked|hidden|password\d?|passwd|secret|token|api[_-]?key|test|sample|empty|default|(?:vault|env|ssm|sm|secret|secrets|aws-sm|gcp-sm|kv|op|file|arn|azure|keyring|keychain)[:.].*|(?:process|os|env|config|settings|secrets|self|this|system|std)\..*)$"
)
_STRONG_KEYS = {"password", "passwords", "passwd", "passwort", "passphrase", "passcode", "pwd", "pw", "pass", "secret", "kennwort", "contrasena", "credential", "credentials", "pgpassword", "mysqlpwd", "rootpw", "adminpw", "dbpassword"}
_NEEDS_SHAPE = {"token", "bearer", "apikey", "authtoken", "accesstoken", "jwt"}
_KEY_KINDS = {"api", "access", "license", "licence", "signing", "private", "secret", "encryption", "client", "auth", "master", "hmac", "deploy", "service", "account", "storage", "shared"}
#: Last words of names that only speak of a credential (fixed values).
_ABOUT = {"prompt", "label", "hint", "field", "message", "name", "id", "type", "policy", "length", "len", "count", "expiry", "expires", "file", "path", "regex", "pattern", "placeholder", "help", "title", "text", "error", "env", "var", "url", "uri", "ref", "hash", "digest", "checksum", "fingerprint", "size", "min", "max", "limit", "ttl", "format", "algorithm", "alg", "header", "param", "column", "required", "reset", "changed", "strength", "validator", "input", "store", "provider", "public", "pub", "description", "caption", "tooltip", "warning", "rule", "rules"}


def key_class(key: str) -> str:
    """strong: its value is a credential if it is a literal; shape: only if the value looks random; '' otherwise."""
    words = [w.lower() for w in _WORDS.findall(key)]
    if not words or words[-1] in _ABOUT or "public" in words or words[0] in ("no", "is", "has", "forgot", "reset"):
        return ""
    if _STRONG_KEYS & set(words) or any(words[i : i + 3] == ["mot", "de", "passe"] for i in range(len(words))):
        return "strong"
    if _NEEDS_SHAPE & set(words) or words[-1] in ("key", "keys") and _KEY_KINDS & set(words[:-1]):
        return "shape"
    return ""


#: Keys that only carry the value of the key above, and keys whose value names what the carrier beside them holds (fixed values).
_CARRIERS = {"value", "val", "default", "data", "current", "plain", "plaintext", "literal", "content", "raw", "new", "old", "primary", "secondary", "string", "stringvalue"}
_NAMES = {"name", "key", "variable", "id", "field"}
#: Keys below which everything that looks random is a credential (fixed values).
_HOLDERS = {"secret", "secrets", "credential", "credentials", "passwords", "tokens", "apikeys"}


def path_class(path: tuple[str, ...], named: str = "") -> str:
    """key_class of the last key; of a carrier that of the key above it, or of named, the name given beside it; below a
    holder of secrets shape for every key that doesn't merely speak of one."""
    for i in range(len(path) - 1, -1, -1):
        if kind := key_class(path[i]):
            return kind
        if path[i].lower() not in _CARRIERS:
            break
        if kind := key_class(named):
            return kind
    words = [w.lower() for w in _WORDS.findall(path[-1])] if path else []
    if words and words[-1] not in _ABOUT and any(_HOLDERS & {w.lower() for w in _WORDS.findall(k)} for k in path[:-1]):
        return "shape"
    return ""


def classes(value: str) -> int:
    return bool(re.search("[a-z]", value)) + bool(re.search("[A-Z]", value)) + bool(re.search(r"\d", value)) + bool(re.search(r"[^\w\s.\-/]", value))


def is_random(value: str) -> bool:
    """Long without spaces, letters and digits mixed, no path and no plain word list."""
    if len(value) < 16 or re.search(r"[\s(){}<>;,$\"']", value) or len(set(value)) < 8:
        return False
    if re.match(r"[a-z]+://|[\w.]+\.(?:com|org|example|net)\b", value) or re.fullmatch(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", value):
        return False
    turns = len(re.findall(r"[a-z][A-Z]|[A-Z][a-z]", value))
    return bool((re.search(r"\d", value) or turns >= 6) and re.search(r"[A-Za-z]", value)) and not re.fullmatch(r"[a-z]+(?:[_.-][a-z]+)*\d{0,4}|[A-Z]+(?:_[A-Z]+)*\d{0,4}", value)


def is_literal_secret(value: str, kind: str, quoted: bool) -> bool:
    if _PLACEHOLDER.match(value) or "${" in value or "{{" in value or len(set(value)) < 4 or re.search(r"(?i)x{6,}|\*{4,}|<[a-z _-]+>", value):
        return False
    if value.startswith("-----"):
        return False
    if kind == "shape":
        return is_random(value)
    if re.search(r"\s", value):
        return False
    if quoted:
        return len(value) >= 6 and (classes(value) >= 2 or is_random(value)) and not re.fullmatch(r"[A-Z_]+|[a-z]+(?:[_./-][a-z]+)+|https?://\S+|/\S*", value)
    if re.search(r"[(){}\[\]<>;,|\\$&*?]|->|::|==|\.\w+\(", value):
        return False
    return len(value) >= 8 and classes(value) >= 3 and not re.fullmatch(r"[A-Za-z_]\w*\d{0,3}(?:\.\w+)*", value) or is_random(value)


def _unquoted_end(line: str, at: int) -> int:
    end = at
    while end < len(line) and line[end] not in " \t;,\"'`)}&" and not (line[end] == "#" and end > at and line[end - 1] in " \t"):
        end += 1
    return end


def line_hits(line: str, pairs: bool = True) -> list[tuple[int, int, str, str]]:
    """(start, end, key, rule) of each credential in a line, by place; without pairs only those that need no key."""
    out: dict[int, tuple[int, int, str, str]] = {}

    def add(a: int, b: int, key: str, rule: str) -> None:
        if b > a and not any(s < b and a < e for s, e, *_ in out.values()):
            out[a] = (a, b, key, rule)

    for m in PRIVATE.finditer(line):
        add(m.start(), m.end(), "", "private-key")
    for m in SHAPES.finditer(line):
        if len(set(m.group())) > 8 and not re.search(r"(?i)x{6,}|example", m.group()):
            add(m.start(), m.end(), "", "format")
    for rule, rx in (("url", URL), ("header", HEADER), ("option", OPTION), ("query", QUERY), ("netrc", NETRC)):
        for m in rx.finditer(line):
            g = m.lastindex or 0
            v = m.group(g)
            if is_literal_secret(v, "strong" if rule in ("url", "option", "netrc") else "shape", True) or rule == "header" and not _PLACEHOLDER.match(v) and len(set(v)) > 7 and re.search(r"\d", v):
                add(m.start(g), m.end(g), "", rule)
    at = 0
    while pairs and (m := PAIR.search(line, at)):
        at = max(m.end("key"), m.start() + 1)
        key = m.group("key")
        kind = key_class(key)
        if not kind:
            # a member chain such as conf.password counts by its last part; go on behind the key
            continue
        if q := m.group("q"):
            a = m.end("value")
            b = a
            while b < len(line) and not line.startswith(q, b):
                b += 2 if line[b] == "\\" else 1
            b = min(b, len(line))
            if is_literal_secret(line[a:b], kind, True):
                add(a, b, key, "pair")
                at = b
        else:
            a = m.end("value")
            b = _unquoted_end(line, a)
            rest = line[b:].strip()
            if is_literal_secret(line[a:b], kind, False) and not rest.startswith(("(", "[", ".")):
                add(a, b, key, "pair")
                at = b
    if pairs and not out:
        for m in PROSE.finditer(line):
            v = m.group("value").rstrip(".,:")
            if classes(v) >= 3 and re.search(r"\d", v) and re.search(r"[!#%+@^&*~?]", v) and is_literal_secret(v, "strong", True) and "://" not in v:
                add(m.start("value"), m.start("value") + len(v), "", "prose")
    return sorted(out.values())


_OPEN_END = re.compile(r"([A-Za-z_$][\w$.-]*)[\"'`]?\]?[ \t]*(?:[:=]|:=|=>)[ \t]*(?:\(|[>|][+-]?|\\|\"|'|`)?[ \t]*\r?$")
_BELOW = re.compile(r"[ \t]+(?:[bru]?([\"'`]))?([^\s\"'`]+)(?:\1[ \t]*[,)]?)?[ \t]*$")
_TABLE = re.compile(r"\r?\n[ \t]*[\"'`]")


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in TRIGGERS:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


Hit = tuple[int, int, str, str]


def code_hits(text: str, automaton) -> list[Hit]:
    """(start, end, key, rule) of every credential of a program or other text that is read by lines."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out, done = [], -1
    for end, _ in automaton.iter(low):
        if end < done:
            continue
        start = text.rfind("\n", 0, end) + 1
        stop = text.find("\n", end)
        stop = len(text) if stop < 0 else stop
        done = stop
        line = text[start:stop].rstrip("\r")
        hits = line_hits(line)
        if hits:
            out += [(start + a, start + b, key, rule) for a, b, key, rule in hits]
        elif (m := _OPEN_END.search(line)) and (kind := key_class(m.group(1))) and stop < len(text):
            nstop = text.find("\n", stop + 1)
            nstop = len(text) if nstop < 0 else nstop
            body = text[stop + 1 : nstop].rstrip("\r")
            n = _BELOW.match(body)
            # more literals below make a table, not a credential
            table = n and n.group(1) and _TABLE.match(text, nstop)
            if n and not table and is_literal_secret(n.group(2), kind, bool(n.group(1))) and not SHAPES.search(body) and not re.match(r"[ \t]+[\w-]+:(?:\s|$)", body):
                out.append((stop + 1 + n.start(2), stop + 1 + n.end(2), m.group(1), "pair"))
    return out


def config_hits(text: str, parsed: config_formats.Parsed, automaton) -> list[Hit]:
    """(start, end, key path, rule) of every credential of a parsed configuration text."""
    out: list[Hit] = []
    spans: list[tuple[int, int]] = []

    def add(a: int, b: int, key: str, rule: str) -> None:
        i = bisect.bisect_left(spans, (a, b))
        if b > a and not (i < len(spans) and spans[i][0] < b) and not (i and spans[i - 1][1] > a):
            spans.insert(i, (a, b))
            out.append((a, b, key, rule))

    names = {e.frame: text[e.start : e.end] for e in parsed.entries if e.path and e.path[-1].lower() in _NAMES}
    where = sorted((e.start, e.end, ".".join(e.path)) for e in parsed.entries)
    # what needs no key: in every line
    at = 0
    for line in text.split("\n"):
        for a, b, _, rule in line_hits(line.rstrip("\r"), False):
            i = bisect.bisect_right(where, (at + a, len(text), "")) - 1
            add(at + a, at + b, where[i][2] if i >= 0 and where[i][1] > at + a else "", rule)
        at += len(line) + 1
    for e in parsed.entries:
        value = text[e.start : e.end]
        if (kind := path_class(e.path, names.get(e.frame, ""))) and is_literal_secret(value, kind, e.quoted):
            add(e.start, e.end, ".".join(e.path), "pair")
        elif any(c in value for c in "=:"):
            # a value that is a text with pairs of its own
            for a, b, key, rule in code_hits(value, automaton):
                add(e.start + a, e.start + b, ".".join((*e.path, key) if key else e.path), rule)
    for a, b in parsed.other:
        for s, t, key, rule in code_hits(text[a:b], automaton):
            add(a + s, a + t, key, rule)
    return sorted(out)


def _sides(text: str) -> Iterator[tuple[str, list[int], list[int]]]:
    """Old and new side of a diff without its signs: (text, begin of each line in it, begin of the line in the diff)."""
    for signs in ("- ", "+ "):
        parts, here, there, at, size = [], [], [], 0, 0
        for i, line in enumerate(text.split("\n")):
            if line[:1] in signs and line and not (i < 2 and line[:4] in ("--- ", "+++ ")):
                parts.append(line[1:])
                here.append(size)
                there.append(at + 1)
                size += len(line)
            at += len(line) + 1
        yield "\n".join(parts), here, there


def plain_hits(text: str, automaton) -> list[Hit]:
    """(start, end, key path, rule) of a text that is no diff: of a configuration format, or of code."""
    if next(automaton.iter(text.lower()), None) is None:
        return []
    parsed = config_formats.parse(text)
    if parsed is not None:
        return config_hits(text, parsed, automaton)
    return [(a, b, key, rule) for a, b, key, rule in code_hits(text, automaton)]


def text_hits(text: str, diff: bool, automaton) -> list[tuple[int, int, int, str, str]]:
    """(line number, start, end, key path, rule) of every credential of a text, by place; offsets count characters of the whole text."""
    if diff:
        found: dict[int, Hit] = {}
        for side, here, there in _sides(text):
            for a, b, key, rule in plain_hits(side, automaton):
                i = bisect.bisect_right(here, a) - 1
                found.setdefault(there[i] + a - here[i], (there[i] + a - here[i], there[i] + b - here[i], key, rule))
        hits = sorted(found.values())
    else:
        hits = plain_hits(text, automaton)
    out, number, counted = [], 1, 0
    for a, b, key, rule in hits:
        number += text.count("\n", counted, a)
        counted = a
        out.append((number, a, b, key, rule))
    return out


_MARK = re.compile(r"-----(END|BEGIN)")
#: Lines of key text with what quotes, comments and diffs put around them: any, and those so long that they are it wherever they stand.
_KEY_LINE, _LONG_KEY_LINE = (re.compile(r"^[ \t+\-#*/>|\"'`]{0,40}(?:%s)(?:\\[nr])*[ \t\"'`+.,;:)\\]{0,20}\r?$" % x, re.M) for x in (r"[A-Za-z0-9+/=]*|(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):.*", r"[A-Za-z0-9+/]{40,}={0,2}"))


def _key_end(text: str, at: int) -> int:
    """Where the text of the private key whose BEGIN ends at at is over: at END, however far; without END at the last line of the form of key text."""
    m = _MARK.search(text, at)
    if m and m.group(1) == "END":
        return m.start()
    stop = m.start() if m else len(text)
    end = text.find("\n", at, stop)
    if end < 0:
        return stop
    while end < stop and (line := _KEY_LINE.match(text, end + 1, stop)):
        end = line.end()
    for line in _LONG_KEY_LINE.finditer(text, end, stop):
        end = line.end()
    return min(end, stop)


def byte_offsets(text: str, places: list[int]) -> list[int]:
    """Offsets of ascending places of a text in its UTF-8 bytes."""
    out, at, size = [], 0, 0
    for p in places:
        size += len(text[at:p].encode("utf-8", "surrogatepass"))
        at = p
        out.append(size)
    return out


def redact(text: str, hits: list[tuple[int, int, int, str, str]]) -> str:
    """text with every credential replaced by REDACTED in its bytes; of a private-key block the lines between its marks, or without END those of the form
    of key text, become x's of the same form. Nothing else changes, so quotes, commas, line numbers and layout stay."""
    cuts, at = [], 0
    for _, a, b, _, rule in sorted(hits, key=lambda h: h[1]):
        if a < at:
            continue
        if rule == "private-key":
            at = _key_end(text, b)
            cuts.append((b, at, re.sub(r"\\n|\\r|[A-Za-z0-9/]", lambda m: m.group() if len(m.group()) > 1 else "x", text[b:at])))
        else:
            at = b
            cuts.append((a, b, "REDACTED"))
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    places = byte_offsets(text, [p for a, b, _ in cuts for p in (a, b)])
    for a, b, (_, _, new) in zip(places[::2], places[1::2], cuts):
        out += [raw[at:a], new.encode("utf-8", "surrogatepass")]
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    auto = _automaton()
    names = ["doc_key", "line_no", "start_byte", "end_byte", "key_path", "rule"]
    for b in batches:
        cols: list[list] = [[] for _ in names]
        for k, index, t in zip(b.column("doc_key").to_pylist(), b.column("index_name").to_pylist(), b.column("content").to_pylist()):
            hits = text_hits(t, index == "diff", auto)
            places = byte_offsets(t, [p for h in hits for p in h[1:3]])
            for (number, _, _, key, rule), s, e in zip(hits, places[::2], places[1::2]):
                for c, v in zip(cols, (k, number, s, e, key, rule)):
                    c.append(v)
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def find_credentials(docs: DataFrame) -> DataFrame:
    """(doc_key, line_no, start_byte, end_byte, key_path, rule) for each credential in docs (doc_key, index_name, content).

    Lines are split at line feeds and counted from 1. Null and empty contents have none; copies of a row give each place
    once. One pass over the texts where they lie: only the found places are shuffled.
    """
    texts = docs.where("content IS NOT NULL").select("doc_key", "index_name", "content")
    return texts.mapInArrow(_spans, "doc_key string, line_no long, start_byte long, end_byte long, key_path string, rule string").distinct()


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    auto = _automaton()
    for b in batches:
        texts, counts = [], []
        for index, t in zip(b.column("index_name").to_pylist(), b.column("content").to_pylist()):
            hits = text_hits(t, index == "diff", auto) if t else []
            texts.append(redact(t, hits) if hits else t)
            counts.append(len(hits))
        yield pa.RecordBatch.from_arrays([b.column("doc_key"), b.column("index_name"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["doc_key", "index_name", "content", "n_redacted"])


def redact_credentials(docs: DataFrame) -> DataFrame:
    """docs (doc_key, index_name, content) with the credentials replaced, and n_redacted. A map without shuffle; null stays null."""
    return docs.select("doc_key", "index_name", "content").mapInArrow(_redacted, "doc_key string, index_name string, content string, n_redacted long")
