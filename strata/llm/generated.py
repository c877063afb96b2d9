"""Operator: generated, minified, vendored and bulk-data files among source files.

Notices are matched by a multi-pattern automaton in the comments at the head and at the foot of a file, where tools write
them; path rules cover vendored and output folders, lockfiles and the endings that tools give. Minified texts and bulk data
under plain names, which say nothing of themselves, are told by the shape of their lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases of which one in a comment says that a tool wrote the file (fixed values, lower case).
GENERATED_PHRASES = (
    "code generated by", "@generated", "autogenerated", "auto-generated", "automatically generated", "automatisch erzeugt", "automatisch generiert", "fichier engendré par", "fichier généré", "généré automatiquement",
    "machine-made by", "machine generated", "machine-generated", "produced automatically", "this file was generated", "this file is generated", "generated by the protocol buffer compiler", "generated automatically", "generado automáticamente",
    "archivo generado", "do not edit", "ne pas modifier", "nicht bearbeiten", "no modificar", "do not modify this file", "do not change it by hand", "manual changes get overwritten", "edits will be lost", "changes will be lost",
)
#: Phrases of which one in a comment says that the file is a third party's (fixed values, lower case).
VENDORED_PHRASES = ("bundled here without changes", "imported, do not", "copied verbatim from the", "vendored from", "this file is vendored", "do not patch locally", "third-party code, do not")
#: Folders that hold third parties' code (fixed values).
VENDOR_DIRS = ("node_modules", "bower_components", "vendor", "third_party", "third-party", "thirdparty", "3rdparty", "godeps", "site-packages", "external", "extern", "externals", "deps", "carthage", "pods", "jspm_packages")
#: Folders that hold what tools write (fixed values).
OUTPUT_DIRS = ("dist", "generated", "gen", "generated-sources", "generated_sources", "__generated__", "build")
#: Endings of names that tools give, and lockfiles (fixed values).
OUTPUT_NAMES = (
    r"\.min\.(?:js|mjs|css|ts)$", r"[.-]bundle\.js$", r"\.chunk\.js$", r"-prod\.js$", r"\.pb\.(?:go|cc|h|rs|c)$", r"\.pb-c\.[ch]$", r"_pb2(?:_grpc)?\.pyi?$", r"_pb\.(?:js|d\.ts|ts)$", r"[._]generated\.[a-z]+$", r"[._]gen\.[a-z]+$", r"\.g\.(?:dart|cs)$", r"\.tab\.(?:gen\.)?[ch]$",
    r"_string(?:\.gen)?\.go$", r"(?:grpc|outerclass)\.(?:generated|gen)\.java$", r"(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|go\.sum|poetry\.lock|composer\.lock|gemfile\.lock)$",
)
#: Languages whose files always count as written by hand.
HAND_LANGUAGES = ("json", "yaml", "markdown", "shell")
#: Lines of this length, dense in marks and poor in spaces, are no hand's work where they make up half of a text.
LONG_LINE = 200
#: Characters from which a table of literals is bulk data; shorter ones are written by hand, whatever else they are. Its share of the text.
DATA_CHARS, DATA_SHARE = 800, 0.7


def path_rule() -> str:
    """One regular expression over lower-case paths (Java and Python)."""
    dirs = "|".join(re.escape(d) for d in VENDOR_DIRS + OUTPUT_DIRS)
    return f"(?:^|/)(?:{dirs})/|" + "|".join(OUTPUT_NAMES)


_COMMENT = re.compile(r"^\s*(?://|#|/?\*|--|;|<!--|%|\"\"\")")
_LITERAL = re.compile(r"(?:-?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[{}\[\](),:\s]|\b[A-Za-z_]\w*\s*:(?!:)|\b(?:true|false|null|None|True|False)\b)+")


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, phrases in (("generated", GENERATED_PHRASES), ("vendored", VENDORED_PHRASES)):
        for p in phrases:
            a.add_word(p, (kind, p))
    a.make_automaton()
    return a


#: Lines that may stand above or between the comments at a file's head: package, import and the like.
_PREAMBLE = re.compile(r"\s*(?:package\b|import\b|from\b.*\bimport\b|use\b|using\b|#\s*(?:include|define|ifndef|ifdef|pragma|if\b|endif)|['\"]use strict['\"]|#!|<\?|mod\b|extern crate|module\b)")


def head_end(text: str) -> int:
    """Where the comments, blank lines and imports that a file begins with are over."""
    at, block = 0, ""
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop].strip()
        if block:
            block = "" if block in line else block
        elif line.startswith("/*"):
            block = "" if "*/" in line[2:] else "*/"
        elif line[:3] in ('"""', "'''"):
            block = "" if line.count(line[:3]) > 1 else line[:3]
        elif line and not _COMMENT.match(line) and not _PREAMBLE.match(line):
            return at
        at = stop + 1
    return len(text)


def foot_begin(text: str) -> int:
    """Where the comments and blank lines that a file ends with begin."""
    at = len(text)
    while at > 0:
        start = text.rfind("\n", 0, at) + 1
        line = text[start:at].strip()
        if line and not _COMMENT.match(line) and not line.endswith("*/"):
            break
        at = start - 1
    return max(at, 0)


def notice_in(text: str, automaton) -> str | None:
    """Kind of the first notice in a comment at the head or foot of the text; one in a string or among program lines is no notice."""
    low = text.lower()
    if len(low) != len(text):
        text = low
    head, foot = head_end(text), foot_begin(text)
    for a, z in ((0, head), (max(head, foot), len(low))):
        for end, (kind, phrase) in automaton.iter(low, a, z):
            start = text.rfind("\n", 0, end) + 1
            if _COMMENT.match(text[start : end + 1]):
                return kind
    return None


def is_minified(text: str) -> bool:
    """Half of the text or more stands in long lines that have few spaces and many program marks."""
    long = "".join(line for line in text.split("\n") if len(line) >= LONG_LINE)
    if not long or len(long) < 0.5 * len(text.strip()):
        return False
    return long.count(" ") < 0.12 * len(long) and sum(map(long.count, "(){}[];,=")) > 0.08 * len(long)


def is_data(text: str) -> bool:
    """Most of a longer text is one run of literals: numbers, strings and the marks between them."""
    if len(text) < DATA_CHARS:
        return False
    most = max((m.end() - m.start() for m in _LITERAL.finditer(text)), default=0)
    return most >= DATA_CHARS and most >= DATA_SHARE * len(text)


def verdict(text: str, automaton) -> str | None:
    if is_minified(text):
        return "minified"
    if found := notice_in(text, automaton):
        return found
    return "data" if is_data(text) else None


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = _automaton()
    for b in batches:
        ids, why = [], []
        for i, t in zip(b.column("blob_id").to_pylist(), b.column("content").to_pylist()):
            if v := verdict(t, a):
                ids.append(i)
                why.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(why, pa.string())], names=["blob_id", "reason"])


def not_hand_written(texts: DataFrame, blobs: DataFrame, file_revs: DataFrame) -> DataFrame:
    """(blob_id, reason) of the texts (blob_id, content) that nobody wrote by hand for this project.

    Reasons: generated or vendored (a notice in a comment), minified, data, or path (any path of the blob lies in a vendored
    or output folder or has a tool's ending). A blob may have several reasons. Null languages in blobs (id, language) and json, yaml, markdown and
    shell always count as hand-written; null and empty texts are never a case by their text. Texts are judged where they lie, and
    only the ids of those that are a case by their text are shuffled; the path rule is one scan of
    file_revs in the JVM, and only the blobs it names are shuffled, once each, however many revisions they have.
    """
    by_text = texts.where("content IS NOT NULL").select("blob_id", "content").mapInArrow(_texts, "blob_id long, reason string")
    by_path = file_revs.where(F.lower("path").rlike(path_rule())).select(F.col("blob_id").cast("long").alias("blob_id")).distinct()
    by_path = texts.select("blob_id").distinct().join(by_path, "blob_id").select("blob_id", F.lit("path").alias("reason"))
    code = blobs.where(F.col("language").isNotNull() & ~F.col("language").isin(*HAND_LANGUAGES)).select(F.col("id").cast("long").alias("blob_id")).distinct()
    return by_text.union(by_path).distinct().join(code, "blob_id", "left_semi")
