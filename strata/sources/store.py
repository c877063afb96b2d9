"""Tables on disk as Parquet parts under one manifest.

A manifest lists the parts of every table. New rows are written as new parts; a run becomes visible when its manifest is
renamed into place, all tables at once. Readers take the highest manifest, so a failed run changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import model
from strata.runtime import publish

_INDEX = {"parsed_blobs": "id long", "code_terms": "term string, doc_id long, tf long, positions array<int>", "code_lengths": "doc_id long, len int", "diff_terms": "term string, doc_id long, tf long, positions array<int>", "diff_lengths": "doc_id long, len int"}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._Path(self.root))

    @property
    def repos_dir(self) -> str:
        return f"{self.root}/repos"

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._Path(self.root))]
        return max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)

    def manifest(self) -> dict[str, list[str]]:
        v = self.version()
        if not v:
            return {}
        stream = self._fs.open(self._Path(f"{self.root}/manifest-{v}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, scope: str = "") -> DataFrame:
        """A table, or of a table that is replaced by scopes only what the last commit of a scope has written."""
        parts = [p for p in self.manifest().get(name, []) if not scope or p.startswith(f"tables/{name}/new-{scope}-")]
        if not parts:
            return model.empty(self.spark, name) if name in model.SCHEMAS else self.spark.createDataFrame([], _INDEX[name])
        df = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{p}" for p in parts])
        if name == "blobs" and (done := self.manifest().get("parsed_blobs")):
            # runs that parse blobs only add their ids
            ids = self.spark.read.parquet(*[f"{self.root}/{p}" for p in done]).distinct().withColumn("done", F.lit(True))
            df = df.join(ids, "id", "left").withColumn("parsed", F.coalesce("done", "parsed")).drop("done")
        return model.conform(df, name) if name in model.SCHEMAS else df

    def read_all(self) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in model.SCHEMAS}

    def read_indexes(self) -> dict[str, tuple[DataFrame, DataFrame]]:
        have = self.manifest()
        return {k: (self.read(f"{k}_terms"), self.read(f"{k}_lengths")) for k in ("code", "diff") if f"{k}_terms" in have}

    def commit(self, appended: dict[str, DataFrame], replaced: dict[str, DataFrame] | None = None, scope: str = "all") -> int:
        """Write rows that are added to tables and new contents of others, then make both visible at once.

        What is replaced is the whole table, or of a scope, such as a repository, the contents of its earlier commits: parts of other
        scopes stay, and are neither read nor written.
        """
        now, version = self.manifest(), self.version()
        for kind, tables in (("add", appended), ("new", replaced or {})):
            for name, df in tables.items():
                place = f"tables/{name}/{kind}-{scope}-" if kind == "new" else f"tables/{name}/{kind}-"
                part = f"{place}{version + 1}-{uuid.uuid4().hex[:8]}"
                key = model.SORTED_BY.get(name) or ("term" if name.endswith("_terms") else None)
                # sorted within files: min and max of the key prune row groups, as a secondary index would
                (df.sortWithinPartitions(key) if key else df).write.parquet(f"{self.root}/{part}")
                now[name] = [*(p for p in now.get(name, []) if kind == "add" or scope != "all" and not p.startswith(place)), part]
        if not publish(self.spark, f"{self.root}/manifest-{version + 1}.json", json.dumps(now, indent=1).encode()):
            raise RuntimeError(f"version {version + 1} was written by another run")
        return version + 1
