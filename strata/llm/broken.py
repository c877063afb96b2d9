"""Operator: source files that do not parse."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import syntax

#: Texts and characters of one language that are parsed in lockstep.
BATCH_TEXTS, BATCH_CHARS = 4_000, 8_000_000


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(blob_id, content) of the code texts; keys that name no blob and null texts drop out. No shuffle."""
    key = F.regexp_extract("doc_key", r"^blob_(\d+)$", 1).try_cast("long")
    return docs.where("index_name = 'code' AND content IS NOT NULL").select(key.alias("blob_id"), "content").where("blob_id IS NOT NULL")


def code_texts(docs: DataFrame, blobs: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """(blob_id, language, content) of the code texts; blobs without a text and keys that name no blob drop out.

    Exact copies of a row may stay: later steps return distinct keys. The blob side is narrow, so that adaptive execution
    can broadcast it where it is small; the text is moved at most once.
    """
    code = keyed_texts(docs)
    known = blobs.select(F.col("id").cast("long").alias("blob_id"), "language")
    if languages:
        known = known.where(F.col("language").isin(languages))
    return code.join(known.distinct(), "blob_id").select("blob_id", "language", "content")


def _parse(batches: Iterator[pa.RecordBatch], report: bool) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[list, list]] = {}
    size: dict[str, int] = {}

    def flush(lang: str) -> pa.RecordBatch:
        ids, texts = held.pop(lang)
        size.pop(lang)
        at = syntax.check_many(lang, texts)
        bad = [i for i, a in enumerate(at) if a >= 0]
        lines = [syntax.line_of(lang, texts[i], at[i]) if report else None for i in bad]
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in bad], pa.int64()), pa.array([lang] * len(bad), pa.string()), pa.array([at[i] for i in bad], pa.int64()), pa.array(lines, pa.int64())], names=["blob_id", "language", "error_token", "error_line"])

    for b in batches:
        for i, lang, text in zip(b.column("blob_id").to_pylist(), b.column("language").to_pylist(), b.column("content").to_pylist()):
            ids, texts = held.setdefault(lang, ([], []))
            ids.append(i)
            texts.append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if len(ids) >= BATCH_TEXTS or size[lang] >= BATCH_CHARS:
                yield flush(lang)
    for lang in list(held):
        yield flush(lang)


def broken_files(texts: DataFrame, report: bool = True) -> DataFrame:
    """(blob_id, language, error_token, error_line) for each text of (blob_id, language, content) that isn't valid in its language.

    error_token counts tokens from 0 up to the first at which no parse can go on; error_line is that token's line, the
    last one if the text ends too early, null unless report. Null texts and languages without a grammar are left out; an empty text is valid in all languages but json
    and go, whose grammars demand more. Copies of a row give one row.
    """
    known = texts.where(F.col("language").isin(list(syntax.CLASSES)) & F.col("content").isNotNull()).select("blob_id", "language", "content")
    return known.mapInArrow(lambda it: _parse(it, report), "blob_id long, language string, error_token long, error_line long").distinct()


def rates(bad: DataFrame, texts: DataFrame, file_revs: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo_id, language, n_files, n_bad): different blobs of each repository and language, and how many don't parse.

    Copies and revisions are reduced to distinct (repository, blob) pairs before they meet the verdicts, so that a blob with
    most revisions weighs no more than its repositories.
    """
    places = file_revs.select("blob_id", "commit_id").distinct().join(commits.select(F.col("id").alias("commit_id"), "repo_id").distinct(), "commit_id").select("blob_id", "repo_id").distinct()
    known = texts.where(F.col("language").isin(list(syntax.CLASSES))).select("blob_id", "language").distinct()
    marked = known.join(bad.select("blob_id", F.lit(1).alias("bad")).distinct(), "blob_id", "left")
    return places.join(marked, "blob_id").groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("n_files"), F.count("bad").alias("n_bad"))
