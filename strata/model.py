"""The nine tables, the text tables, and their views over stored or test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType()}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k.rstrip("!")], not k.endswith("!")) for n, k in (c.split() for c in text.split(", "))])


SCHEMAS = {
    "repos": _schema("id long, name string, path string"),
    "commits": _schema("id long, repo_id long, hash string, author string, message string, timestamp long"),
    "commit_parents": _schema("commit_id long, parent_id long"),
    "refs": _schema("id long, repo_id long, name string, commit_id long"),
    "blobs": _schema("id long, content_hash string, language string, parsed boolean"),
    "file_revs": _schema("id long, commit_id long, path string, blob_id long"),
    "diffs": _schema("id long, commit_id long, path string, old_blob_id long, new_blob_id long"),
    "symbols": _schema("id long, blob_id long, parent_id long, name string, kind string, line int, col int, end_line int, end_col int, signature string, return_type string, params string"),
    "symbol_refs": _schema("id long, blob_id long, symbol_id long, ref_name string, kind string, line int, col int"),
    "code_docs": _schema("doc_id long, content string"),
    "diff_docs": _schema("doc_id long, content string"),
}
#: Natural key of each table: its id is the hash of this key, the same in every run.
NATURAL_KEYS = {"repos": ["name"], "commits": ["repo_id", "hash"], "commit_parents": ["commit_id", "parent_id"], "refs": ["repo_id", "name"], "blobs": ["content_hash"], "file_revs": ["commit_id", "path"], "diffs": ["commit_id", "path"], "code_docs": ["doc_id"], "diff_docs": ["doc_id"]}
#: Column by which rows of the larger tables are sorted in their files, so that min and max prune scans.
SORTED_BY = {"commits": "timestamp", "file_revs": "commit_id", "symbols": "name", "symbol_refs": "ref_name", "diffs": "commit_id"}


def stable_id(*cols):
    return F.xxhash64(*cols)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the table's columns; columns that an older layout lacks come as nulls."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])


#: The nine tables out of the test tables, in SQL that Spark and DuckDB read alike. Repeated rows are exact copies.
CORPUS_SQL = {
    "repos": "SELECT DISTINCT repo_id AS id, concat('host.example/repo', CAST(repo_id AS STRING)) AS name, concat('/repos/', CAST(repo_id AS STRING)) AS path FROM (SELECT repo_id FROM t_commits UNION SELECT repo_id FROM t_refs) x WHERE repo_id IS NOT NULL",
    "commits": "SELECT DISTINCT * FROM t_commits",
    "commit_parents": "SELECT DISTINCT * FROM t_commit_parents",
    "refs": "SELECT DISTINCT * FROM t_refs",
    "blobs": "SELECT DISTINCT * FROM t_blobs",
    "file_revs": "SELECT DISTINCT * FROM t_file_revs",
    "symbols": "SELECT DISTINCT * FROM t_symbols",
    "symbol_refs": "SELECT DISTINCT * FROM t_symbol_refs",
    "code_docs": "SELECT DISTINCT TRY_CAST(substr(doc_key, 6) AS BIGINT) AS doc_id, content FROM t_bleve_docs WHERE index_name = 'code'",
    "diff_docs": "SELECT DISTINCT TRY_CAST(substr(doc_key, 6) AS BIGINT) AS doc_id, content FROM t_bleve_docs WHERE index_name = 'diff'",
    # a diff text names its path; its commit is the first that has a file of the path, else the commit of the same number
    "diffs": "SELECT d.doc_id AS id, coalesce(f.commit_id, d.doc_id + 1000) AS commit_id, d.path, f.old_blob_id, f.new_blob_id FROM (SELECT DISTINCT TRY_CAST(substr(doc_key, 6) AS BIGINT) AS doc_id, regexp_extract(content, '^--- a/([^\\n]*)', 1) AS path FROM t_bleve_docs WHERE index_name = 'diff') d LEFT JOIN (SELECT path, min(commit_id) AS commit_id, CASE WHEN count(DISTINCT blob_id) > 1 THEN min(blob_id) END AS old_blob_id, max(blob_id) AS new_blob_id FROM t_file_revs GROUP BY path) f ON f.path = d.path",
}
_BASE = ("commits", "commit_parents", "refs", "blobs", "file_revs", "symbols", "symbol_refs", "bleve_docs")


def corpus_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables over the test data in sf_dir as lazy frames, without temporary names left behind.

    Repeated rows are dropped, but in the two text tables they stay: to compare whole texts would shuffle them all, and what
    reads them reduces its own narrow results instead.
    """
    base = {f"t_{t}": spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _BASE}
    out = {}
    for name, sql in CORPUS_SQL.items():
        used = {t: df for t, df in base.items() if t in sql}
        # Spark reads backslashes in string literals, DuckDB does not
        text = sql.replace("\\n", "\\\\n") if "\\n" in sql else sql
        if name.endswith("_docs"):
            text = text.replace("SELECT DISTINCT", "SELECT")
        for t in used:
            text = text.replace(t, "{" + t + "}")
        out[name] = spark.sql(text, **used)
    return out


def oracle_views() -> str:
    """WITH clause of the same tables for DuckDB; names carry the prefix v_."""
    parts = []
    for name, sql in CORPUS_SQL.items():
        text = sql.replace("AS STRING", "AS VARCHAR")
        for t in _BASE:
            text = text.replace(f"t_{t}", t)
        parts.append(f"v_{name} AS ({text})")
    return "WITH " + ",\n".join(parts)
