"""Language of a path, and names of repositories from their addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of each language (fixed values).
EXTENSIONS = {
    "rust": "rs", "python": "py", "javascript": "js", "typescript": "ts", "tsx": "tsx", "jsx": "jsx", "java": "java", "c": "c h", "cpp": "cpp cc cxx hpp hxx hh", "go": "go", "ruby": "rb", "php": "php", "swift": "swift", "kotlin": "kt kts",
    "scala": "scala", "csharp": "cs", "shell": "sh bash", "sql": "sql", "html": "html htm", "css": "css", "json": "json", "yaml": "yaml yml", "toml": "toml", "xml": "xml", "markdown": "md markdown", "r": "r", "lua": "lua", "zig": "zig",
    "elixir": "ex exs", "erlang": "erl hrl", "haskell": "hs", "ocaml": "ml mli", "perl": "pl pm", "protobuf": "proto", "dart": "dart",
}
BY_EXTENSION = {e: lang for lang, es in EXTENSIONS.items() for e in es.split()}


def detect(path: str) -> str | None:
    """Language by the last extension of the file name, in any case; None if there is none or it is unknown."""
    name = path.rsplit("/", 1)[-1]
    return BY_EXTENSION.get(name.rsplit(".", 1)[1].lower()) if "." in name else None


def language_of(path: Column | str) -> Column:
    """The same as an expression: a map literal, so it stays in the JVM."""
    table = F.create_map(*[F.lit(x) for pair in sorted(BY_EXTENSION.items()) for x in pair])
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.try_element_at(table, ext)


_SCHEMES = ("https://", "http://", "git://")


def _trimmed(url: str) -> str:
    text = url.strip()
    for s in _SCHEMES:
        if text.startswith(s):
            text = text[len(s) :]
            break
    return text.rstrip("/")


def repo_name(url: str) -> str:
    """Name of a repository: its address without scheme, closing slashes and .git."""
    name = _trimmed(url).removesuffix(".git")
    if not name:
        raise ValueError(f"invalid repo URL: {url!r}")
    return name


def repo_dir(url: str) -> str:
    """Folder of its bare clone under the store's repos folder."""
    return repo_name(url) + ".git"


def repo_name_of(url: Column | str) -> Column:
    """repo_name as an expression; null where the address is invalid."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(url), "^(https|http|git)://", ""), "/+$", ""), r"\.git$", "")
    return F.when(bare != "", bare)
