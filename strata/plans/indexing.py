"""Indexing of a repository: git to the nine tables and two text indexes, as set-oriented steps over all new commits."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import model
from strata.functions.languages import language_of, repo_dir, repo_name
from strata.functions.symbols import LANGUAGES, extract_symbols, symbol_tables
from strata.operators import dataflow, fulltext
from strata.runtime import cut
from strata.sources import git
from strata.sources.store import Store

Progress = Callable[[str], None]


@dataclass
class IndexStats:
    """Rows that a run has added."""

    refs: int = 0
    new_commits: int = 0
    new_blobs: int = 0
    new_diffs: int = 0
    blobs_parsed: int = 0
    symbols: int = 0
    refs_found: int = 0


def _id(*cols):
    return model.stable_id(*cols)


def clones_dir(store: Store) -> str:
    """Where bare clones lie: a folder that driver and executors reach as a path, that is the store's own if it is on a mounted file system."""
    if "://" in store.repos_dir and not store.repos_dir.startswith("file://"):
        raise ValueError(f"clones need a mounted folder, not {store.repos_dir}: pass clones")
    return store.repos_dir.removeprefix("file://").removeprefix("file:")


def index_repo(spark: SparkSession, root: str, url: str, depth: int = 10_000, progress: Progress = lambda m: None, clones: str | None = None) -> IndexStats:
    """Bring a repository's new commits into the store at root; depth bounds the commits taken in one run, 0 for all; clones is the
    folder of bare clones if the store's own can't hold them.

    A run reads and writes in proportion to the new commits and the files at the tips: git compares each commit's tree with that of its first
    parent, and rows of other repositories are not touched. Commits already stored are not read again. Edges to parents are resolved after all commits are known. A merge is compared
    with its first parent; without one every file is an addition. Files at the tips of refs are rebuilt.
    """
    store, name = Store(spark, root), repo_name(url)
    path = os.path.abspath(os.path.join(clones or clones_dir(store), repo_dir(url)))
    progress(f"{'cloned' if git.clone_or_fetch(url, path) else 'fetched'} {name}")
    git.register(spark)
    t = store.read_all()
    repo_id = spark.range(1).select(_id(F.lit(name))).first()[0]
    repos = spark.createDataFrame([(repo_id, name, path)], "id long, name string, path string")
    refs = cut(spark.read.format("strata_git").option("path", path).option("table", "refs").load())
    tips = [r["commit_hash"] for r in refs.select("commit_hash").distinct().collect()]
    mine = t["commits"].where(F.col("repo_id") == repo_id)
    known = f"{path}.known-{uuid.uuid4().hex[:8]}"
    # git walks from the tips down to what a previous run has stored as a tip
    old_tips = mine.join(t["refs"].where(F.col("repo_id") == repo_id).select(F.col("commit_id").alias("id")).distinct(), "id", "left_semi").select("hash")
    with open(known, "w") as f:
        f.write("\n".join(r["hash"] for r in old_tips.collect()))
    try:
        log = spark.read.format("strata_git").option("path", path).option("table", "commits").option("tips", ",".join(tips)).option("known", known).option("depth", str(depth)).load()
        log = cut(log.join(mine.select("hash"), "hash", "left_anti"))
    finally:
        os.remove(known)
    stats = IndexStats(refs=refs.count(), new_commits=log.count())
    if depth and stats.new_commits >= depth:
        progress(f"history cut at {depth} commits")
    commits = log.select(_id(F.lit(repo_id), "hash").alias("id"), F.lit(repo_id).alias("repo_id"), "hash", "author", "message", "timestamp")
    every = mine.select("id", "hash").union(commits.select("id", "hash"))
    edges = log.select(_id(F.lit(repo_id), "hash").alias("commit_id"), F.explode("parents").alias("hash")).join(every, "hash").select("commit_id", F.col("id").alias("parent_id")).distinct()
    first = log.select("hash", F.try_element_at("parents", F.lit(1)).alias("parent"))
    tip_rows = refs.join(every.withColumnRenamed("hash", "commit_hash"), "commit_hash").select("name", "commit_hash", F.col("id").alias("commit_id"))
    # a parent that isn't stored, beyond the depth or the clone, counts as none: all files are added
    known_parents = first.join(every.select(F.col("hash").alias("parent")).distinct(), "parent", "left_semi").select("hash", "parent")
    changes = cut(git.changes(first.select("hash").join(known_parents, "hash", "left"), path))
    tree = git.trees(tip_rows.select("commit_hash").distinct(), path)
    tip_files = cut(tree.join(tip_rows.select("commit_hash", "commit_id").distinct(), "commit_hash").select("commit_id", "path", "object_id"))
    used = changes.select("path", F.explode(F.array("old_blob_id", "new_blob_id")).alias("object_id")).where("object_id IS NOT NULL").union(tip_files.select("path", "object_id"))
    firsts = used.groupBy("object_id").agg(F.min_by(language_of("path"), "path").alias("language"))
    fresh = cut(firsts.join(t["blobs"].select(F.col("content_hash").alias("object_id")), "object_id", "left_anti"))
    need = changes.select(F.explode(F.array("old_blob_id", "new_blob_id")).alias("object_id")).where("object_id IS NOT NULL").union(fresh.select("object_id")).distinct()
    content = cut(git.blobs(need.repartition("object_id"), path))
    blobs = fresh.select(_id("object_id").alias("id"), F.col("object_id").alias("content_hash"), "language", F.lit(False).alias("parsed"))
    code_docs = fresh.join(content, "object_id").where("content <> ''").select(_id("object_id").alias("doc_id"), "content")
    diffs = changes.select(_id(F.lit(repo_id), "commit").alias("commit_id"), "path", "old_blob_id", "new_blob_id").withColumn("id", _id("commit_id", "path"))
    texts = diffs.join(content.select(F.col("object_id").alias("old_blob_id"), F.col("content").alias("old")), "old_blob_id", "left").join(content.select(F.col("object_id").alias("new_blob_id"), F.col("content").alias("new")), "new_blob_id", "left")
    empty_as_none = lambda c: F.when(F.col(c) != "", F.col(c))
    diff_docs = texts.select(F.col("id").alias("doc_id"), dataflow.diff_text(F.col("path"), empty_as_none("old"), empty_as_none("new")).alias("content"))
    ids = lambda c: F.when(F.col(c).isNotNull(), _id(c)).alias(c)
    diff_rows = diffs.select("id", "commit_id", "path", ids("old_blob_id"), ids("new_blob_id"))
    file_revs = tip_files.select(_id("commit_id", "path").alias("id"), "commit_id", "path", _id("object_id").alias("blob_id")).distinct()
    # files at commits that were tips before stay, and so do refs that are gone
    scope = f"repo{repo_id & (1 << 64) - 1:016x}"
    file_revs = dataflow.replace_where(store.read("file_revs", scope), file_revs, tip_rows.select("commit_id").distinct(), ["commit_id"])
    tips_now = tip_rows.select(_id(F.lit(repo_id), "name").alias("id"), F.lit(repo_id).alias("repo_id"), "name", "commit_id", F.lit(1).alias("batch"))
    ref_rows = dataflow.upsert(store.read("refs", scope).withColumn("batch", F.lit(0)), tips_now, ["repo_id", "name"], "batch").select("id", "repo_id", "name", "commit_id")
    stats.new_blobs, stats.new_diffs = fresh.count(), changes.count()
    progress(f"{stats.new_commits} commits, {stats.new_diffs} changed files, {stats.new_blobs} blobs")
    added = {"commits": commits, "commit_parents": edges, "blobs": blobs, "diffs": diff_rows, "code_docs": code_docs, "diff_docs": diff_docs}
    for kind, docs in (("code", code_docs), ("diff", diff_docs)):
        added[f"{kind}_terms"], added[f"{kind}_lengths"] = fulltext.term_table(docs), fulltext.length_table(docs)
    store.commit({n: model.conform(df, n) if n in model.SCHEMAS else df for n, df in added.items()}, {"repos": model.conform(repos, "repos"), "refs": model.conform(ref_rows, "refs"), "file_revs": model.conform(file_revs, "file_revs")}, scope)
    return stats


def parse_symbols(spark: SparkSession, root: str, progress: Progress = lambda m: None) -> IndexStats:
    """Extract symbols and call sites of all blobs that no run has parsed; blobs without readable text count as parsed."""
    store = Store(spark, root)
    t = store.read_all()
    todo = cut(t["blobs"].where(~F.col("parsed") & F.col("language").isin(*LANGUAGES)))
    texts = todo.select(F.col("id").alias("blob_id"), "language").join(t["code_docs"].withColumnRenamed("doc_id", "blob_id"), "blob_id")
    found = cut(extract_symbols(texts))
    symbols, refs = symbol_tables(found)
    stats = IndexStats(blobs_parsed=todo.count(), symbols=symbols.count(), refs_found=refs.count())
    store.commit({"symbols": model.conform(symbols, "symbols"), "symbol_refs": model.conform(refs, "symbol_refs"), "parsed_blobs": todo.select("id")})
    progress(f"{stats.blobs_parsed} blobs parsed, {stats.symbols} symbols, {stats.refs_found} call sites")
    return stats


def unreferenced_file_revs(tables: dict[str, DataFrame]) -> DataFrame:
    """file_revs of commits that no ref names any more; they are invisible to searches."""
    return tables["file_revs"].join(tables["refs"].select("commit_id").distinct(), "commit_id", "left_anti")
