"""Git repositories as Spark sources, over the public git program.

The bare clone lies in a folder that driver and executors share (in local mode, any folder). Refs and commits are a Python data
source, ``spark.read.format("strata_git").option("path", ...).option("table", "refs" | "commits")``; trees and blobs are
maps over the commits and objects asked for, so that their reading is spread over the executors.
"""

from __future__ import annotations

import logging
import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

log = logging.getLogger("strata")

REFS = "name string, commit_hash string"
COMMITS = "hash string, parents array<string>, author string, message string, timestamp long"


def git(path: str, *args: str, data: bytes | None = None) -> bytes:
    env = {**os.environ, "GIT_TERMINAL_PROMPT": "0", "LC_ALL": "C.UTF-8", "GIT_CONFIG_NOSYSTEM": "1"}
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", path, *args], input=data, capture_output=True, check=True, env=env).stdout


def clone_or_fetch(url: str, path: str) -> bool:
    """Bare clone, or a forced fetch of all refs into the clone that is there; True if it was cloned. A fetch that fails is
    logged, and the clone is used as it is."""
    if os.path.isdir(path):
        try:
            git(path, "fetch", "--quiet", "--force", "--tags", url, "+refs/*:refs/*")
        except subprocess.CalledProcessError as e:
            log.warning("fetch of %s failed: %s", url, e.stderr.decode("utf-8", "replace").strip())
        return False
    os.makedirs(os.path.dirname(path), exist_ok=True)
    git(os.path.dirname(path), "clone", "--quiet", "--bare", url, path)
    return True


def list_refs(path: str) -> list[tuple[str, str]]:
    """(name, commit hash) of all refs that lead to a commit, HEAD included; broken ones are left out."""
    out = []
    for line in git(path, "for-each-ref", "--format=%(refname) %(objecttype) %(objectname) %(*objecttype) %(*objectname)").decode("utf-8", "replace").splitlines():
        name, kind, oid, *peeled = line.split(" ")
        if kind == "commit":
            out.append((name, oid))
        elif kind == "tag" and peeled[:1] == ["commit"]:
            out.append((name, peeled[1]))
    try:
        out.append(("HEAD", git(path, "rev-parse", "--verify", "--quiet", "HEAD^{commit}").decode().strip()))
    except subprocess.CalledProcessError:
        pass
    return out


class GitSource(DataSource):
    """Format strata_git. Options: path of the clone, table, and for commits tips and known (commas between) and depth."""

    @classmethod
    def name(cls) -> str:
        return "strata_git"

    def schema(self) -> str:
        return COMMITS if self.options.get("table") == "commits" else REFS

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(dict(self.options))


class _Tip(InputPartition):
    def __init__(self, value):
        super().__init__(value)


class _GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_Tip("all")]

    def read(self, partition) -> Iterator[tuple]:
        path = self.options["path"]
        if self.options.get("table") != "commits":
            yield from list_refs(path)
            return
        tips = [t for t in self.options.get("tips", "").split(",") if t]
        depth = int(self.options.get("depth", "0"))
        if not tips:
            return
        ask = "\n".join([*tips, *(f"^{h}" for h in self._known(path))]) + "\n"
        limit = [f"--max-count={depth}"] if depth > 0 else []
        raw = git(path, "log", "--stdin", "--date-order", *limit, "-z", "--format=%H%x1f%P%x1f%an%x1f%at%x1f%B", data=ask.encode())
        for rec in raw.decode("utf-8", "replace").split("\0"):
            if rec.strip():
                h, parents, author, at, message = rec.split("\x1f", 4)
                yield h.strip(), parents.split(), author, message, int(at)

    def _known(self, path: str) -> list[str]:
        file = self.options.get("known")
        if not file or not os.path.exists(file):
            return []
        with open(file) as f:
            return f.read().split()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitSource)


def _files(path: str, commit: str) -> Iterator[tuple[str, str]]:
    for rec in git(path, "ls-tree", "-r", "-z", "--full-tree", commit).split(b"\0"):
        if rec:
            head, _, name = rec.partition(b"\t")
            mode, kind, oid = head.split()
            if kind == b"blob" and mode != b"120000":
                yield name.decode("utf-8", "replace"), oid.decode()


def trees(commits: DataFrame, path: str) -> DataFrame:
    """(commit_hash, path, object_id) of all files in the trees of commits (commit_hash); links and submodules are no files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(h, *f) for h in b.column("commit_hash").to_pylist() for f in _files(path, h)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["commit_hash", "path", "object_id"])

    return commits.select("commit_hash").mapInArrow(run, "commit_hash string, path string, object_id string")


def changes(commits: DataFrame, path: str) -> DataFrame:
    """(commit, path, old_blob_id, new_blob_id) of the files in which commits (hash, parent) differ from their parent, links and submodules
    left out; of a commit without one all files are added. git compares the trees, so that what is equal is never listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            pairs = list(zip(b.column("hash").to_pylist(), b.column("parent").to_pylist()))
            for h in (h for h, p in pairs if p is None):
                rows += [(h, name, None, oid) for name, oid in _files(path, h)]
            ask = "".join(f"{h} {p}\n" for h, p in pairs if p is not None)
            fields = iter(git(path, "diff-tree", "-r", "-z", "--no-renames", "--stdin", data=ask.encode()).split(b"\0")) if ask else iter(())
            commit = ""
            for head in fields:
                if not head.startswith(b":"):
                    commit = head.decode()
                    continue
                old_mode, new_mode, old, new, _ = head[1:].split(b" ")
                name = next(fields).decode("utf-8", "replace")
                ids = [oid.decode() if mode in (b"100644", b"100755", b"100664") else None for mode, oid in ((old_mode, old), (new_mode, new))]
                if ids[0] != ids[1]:
                    rows.append((commit, name, *ids))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["commit", "path", "old_blob_id", "new_blob_id"])

    return commits.select("hash", "parent").mapInArrow(run, "commit string, path string, old_blob_id string, new_blob_id string")


def blobs(objects: DataFrame, path: str) -> DataFrame:
    """(object_id, content) of objects (object_id): content is null where it isn't valid UTF-8 or can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("object_id").to_pylist()
            for at in range(0, len(ids), 500):
                part = ids[at : at + 500]
                raw = git(path, "cat-file", "--batch", data=("\n".join(part) + "\n").encode()) if part else b""
                texts, pos = [], 0
                for _ in part:
                    end = raw.find(b"\n", pos)
                    head = raw[pos:end].split()
                    pos = end + 1
                    if len(head) < 3:
                        texts.append(None)
                        continue
                    data = raw[pos : pos + int(head[2])]
                    pos += int(head[2]) + 1
                    try:
                        texts.append(data.decode("utf-8"))
                    except UnicodeDecodeError:
                        texts.append(None)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(texts, pa.string())], names=["object_id", "content"])

    return objects.select("object_id").mapInArrow(run, "object_id string, content string")
