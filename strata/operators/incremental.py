"""Processing only new or changed records.

State is a table (record_kind, record_key, content_hash) of what the succeeded runs have processed, kept in versions by
StateStore. A run hashes the current rows, joins them with the state and takes the rows whose hash is new or different.
Its own state becomes visible only by an atomic rename of a version file after all else is written, so a failed run
changes nothing and the next run takes the same records again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.runtime import null_safe_key, publish


def content_hash(*cols: str):
    """Hash of a row's content; a null differs from every text and two nulls are equal."""
    return F.sha2(null_safe_key(*cols), 256)


def hashed(rows: DataFrame, kind: str, key, value: list[str]) -> DataFrame:
    """(record_kind, record_key, content_hash) of the distinct rows; rows without a key can't be tracked and keep a null key."""
    return rows.select(F.lit(kind).alias("record_kind"), key.cast("string").alias("record_key"), content_hash(*value).alias("content_hash")).distinct()


def succeeded_runs(log: DataFrame, ok: str = "ok") -> DataFrame:
    """(run_id) of the runs whose latest status by logged_at (then log_id) is ok."""
    last = log.groupBy("run_id").agg(F.max_by("status", F.struct("logged_at", "log_id")).alias("status"))
    return last.where(F.col("status") == ok).select("run_id")


def state_of_runs(log: DataFrame, records: DataFrame) -> DataFrame:
    """State left by the succeeded runs: for each key the content hash written by the highest succeeded run."""
    good = records.join(succeeded_runs(log), "run_id", "left_semi").select("run_id", "record_kind", "record_key", content_hash("record_value").alias("content_hash"))
    return good.groupBy("record_kind", "record_key").agg(F.max_by("content_hash", "run_id").alias("content_hash"))


def new_or_changed(current: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of current (record_kind, record_key, content_hash) that the state lacks or has with another hash; null keys always come out."""
    done = state.select("record_kind", "record_key", "content_hash")
    return current.join(done, ["record_kind", "record_key", "content_hash"], "left_anti")


class StateStore:
    """Versioned state under a folder of any Hadoop file system.

    Keys are spread over ``buckets`` by hash. A run writes the new contents of the buckets it touches to a folder of its own
    name, data-<uuid>/, which no other run ever writes to; then version-<N>, a small file that names the folder of every
    bucket, is renamed into place, which fails if another run has made version N. Readers take the highest version. What a
    failed or beaten run has written is named by no version and read by none; ``vacuum`` deletes what only old versions name.
    The number of buckets is fixed when the first version is written.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path())]
        return sorted(int(n[8:]) for n in names if n.startswith("version-"))

    def version(self) -> int:
        """The last version that a run finished; 0 before the first."""
        return max(self._versions(), default=0)

    def manifest(self, version: int) -> dict:
        """{"buckets": their number, "folders": {bucket: folder}} of a version."""
        if not version:
            return {"buckets": self.buckets, "folders": {}}
        stream = self._fs.open(self._path(f"version-{version}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """(record_kind, record_key, content_hash) of a version, the last if none is named; of some buckets only, if named."""
        folders = self.manifest(self.version() if version is None else version)["folders"]
        paths = [f"{self.root}/{f}/bucket={b}" for b, f in folders.items() if only is None or int(b) in only]
        schema = "record_kind string, record_key string, content_hash string"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def pending(self, current: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of current that a version of the state, the last if none is named, lacks or has with another hash."""
        return new_or_changed(current, self.read(version))

    def commit(self, processed: DataFrame, base: int | None = None) -> int:
        """Add the hashes of the processed rows to the state as the version after base, the version that pending was asked of
        (the last, if none is named). Of a key's several rows the greatest hash stays; rows without a key aren't kept.

        Raises RuntimeError, with nothing changed, if another run has committed since base. Only the buckets that the
        processed rows fall into are read and written again.
        """
        base = self.version() if base is None else base
        old = self.manifest(base)
        place = F.pmod(F.xxhash64("record_kind", "record_key"), F.lit(old["buckets"])).cast("int")
        fresh = processed.select("record_kind", "record_key", "content_hash").where("record_key IS NOT NULL")
        if old["folders"]:
            from strata.runtime import cut

            fresh = cut(fresh)
            touched = [r[0] for r in fresh.select(place).distinct().collect()]
            kept = self.read(base, touched).withColumn("new", F.lit(0))
            fresh = kept.unionByName(fresh.withColumn("new", F.lit(1)))
        else:
            fresh = fresh.withColumn("new", F.lit(1))
        rows = fresh.groupBy("record_kind", "record_key").agg(F.max(F.struct("new", "content_hash")).alias("last")).select("record_kind", "record_key", F.col("last.content_hash").alias("content_hash"))
        folder = f"data-{uuid.uuid4().hex}"
        rows.withColumn("bucket", place).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        new = [s.getPath().getName()[7:] for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("bucket=")]
        folders = {**old["folders"], **dict.fromkeys(new, folder)}
        if not publish(self.spark, f"{self.root}/version-{base + 1}", json.dumps({"buckets": old["buckets"], "folders": folders}).encode()):
            raise RuntimeError(f"version {base + 1} was written by another run")
        return base + 1

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the last versions, and the buckets that only deleted versions name. Folders of runs under way stay."""
        versions = self._versions()
        named = {v: set(self.manifest(v)["folders"].items()) for v in versions}
        live = set().union(*(named[v] for v in versions[-keep:]))
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"version-{v}"), False)
            for b, f in named[v] - live:
                self._fs.delete(self._path(f"{f}/bucket={b}"), True)
