"""Queries of the search language, the text index, the joins and the indexing steps, each with independent SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata import model
from strata.engine import Engine
from strata.functions.languages import BY_EXTENSION, language_of, repo_name_of
from strata.operators import dataflow, fulltext, intervals
from strata.query.parser import Strategy, Term, parse
from strata.query.translate import strategy
from strata.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_VIEWS = model.oracle_views()


def _put(name: str, run, sql: str | None = None, views: bool = True) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = f"{_VIEWS} {sql}" if views else sql


def _corpus(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return model.corpus_tables(spark, d)


# --- search strings -------------------------------------------------------------------------------------------------


def _search(name: str, text: str, columns: str, sql: str) -> None:
    cols = columns.split()
    q = parse(text)
    kinds = (q.type.value,) if strategy(q) is not Strategy.SQL_ONLY and not q.is_regex else ()
    _put(name, lambda s, d: Engine.over_indexed_corpus(s, d, *kinds).search(text).select(*cols), sql)


def _bm25(words: list[str], docs: str, name: str = "hits") -> str:
    """CTEs that rank the documents holding all words."""
    asked = ", ".join(f"('{w}')" for w in words)
    return f"""
toks_{name} AS (SELECT doc_id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {docs}),
st_{name} AS (SELECT count(*) AS n, avg(len(w)) AS al FROM toks_{name} WHERE len(w) > 0),
tf_{name} AS (SELECT doc_id, len(w) AS dl, a.term, len(list_filter(w, lambda x: x = a.term)) AS tf FROM toks_{name}, (VALUES {asked}) a(term) WHERE list_contains(w, a.term)),
df_{name} AS (SELECT term, count(*) AS df FROM tf_{name} GROUP BY term),
{name} AS (SELECT t.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))), 4) AS score
  FROM tf_{name} t JOIN df_{name} USING (term), st_{name} GROUP BY t.doc_id HAVING count(*) = {len(words)})"""


_SNIP = r"coalesce(substr(regexp_replace(list_filter(string_split(d.content, chr(10)), lambda l: {test})[1], '^\s+|\s+$', '', 'g'), 1, 200), '')"
_CODE_FROM = "JOIN v_blobs b ON b.id = h.doc_id JOIN v_file_revs fr ON fr.blob_id = b.id JOIN v_refs r ON r.commit_id = fr.commit_id JOIN v_repos rp ON rp.id = r.repo_id WHERE r.name = 'refs/heads/main'"

_search("q_code", "count:500 buffer flush", "file_path language repo score", f", {_bm25(['buffer', 'flush'], 'v_code_docs')} SELECT fr.path AS file_path, b.language, rp.name AS repo, max(h.score) AS score FROM hits h {_CODE_FROM} GROUP BY ALL ORDER BY score DESC, file_path, repo LIMIT 500")
_search("q_code_top", "buffer", "file_path score", f", {_bm25(['buffer'], 'v_code_docs')} SELECT file_path, score FROM (SELECT fr.path AS file_path, b.language, rp.name AS repo, max(h.score) AS score FROM hits h {_CODE_FROM} GROUP BY ALL ORDER BY score DESC, file_path, repo LIMIT 20)")
_search("q_code_snippet", "count:300 lang:python manifest", "file_path repo content", f", {_bm25(['manifest'], 'v_code_docs')}, sn AS (SELECT doc_id, {_SNIP.format(test='contains(lower(l), $$manifest$$)')} AS content FROM v_code_docs d) SELECT fr.path AS file_path, rp.name AS repo, max(sn.content) AS content FROM hits h JOIN sn ON sn.doc_id = h.doc_id {_CODE_FROM} AND b.language = 'python' GROUP BY ALL")
_search("q_code_or", "count:400 ledger OR walker -lang:python", "file_path repo score", f", {_bm25(['ledger'], 'v_code_docs', 'h1')}, {_bm25(['walker'], 'v_code_docs', 'h2')}, hits AS (SELECT doc_id, max(score) AS score FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY doc_id) SELECT fr.path AS file_path, rp.name AS repo, max(h.score) AS score FROM hits h {_CODE_FROM} AND b.language <> 'python' GROUP BY fr.path, b.language, rp.name ORDER BY score DESC, file_path, repo LIMIT 400")
_search("q_code_file", "count:200 file:*.go -file:vendor return", "file_path score", f", {_bm25(['return'], 'v_code_docs')} SELECT fr.path AS file_path, max(h.score) AS score FROM hits h {_CODE_FROM} AND regexp_matches(lower(fr.path), '(?s)^.*\\.go$') AND NOT fr.path ILIKE '%vendor%' GROUP BY fr.path, b.language, rp.name ORDER BY score DESC, file_path LIMIT 200")
_search("q_code_case", "count:200 case:yes file:*_[a-m]*.py rev:main return", "file_path", f", {_bm25(['return'], 'v_code_docs')} SELECT fr.path AS file_path FROM hits h {_CODE_FROM} AND regexp_matches(fr.path, '(?s)^.*_[a-m].*\\.py$') GROUP BY fr.path, b.language, rp.name LIMIT 200")
_search("q_code_repo", "count:300 repo:repo1 -repo:repo12 author", "file_path repo", f", {_bm25(['author'], 'v_code_docs')} SELECT fr.path AS file_path, rp.name AS repo FROM hits h {_CODE_FROM} AND rp.name ILIKE '%repo1%' AND NOT rp.name ILIKE '%repo12%' GROUP BY fr.path, b.language, rp.name LIMIT 300")
_search("q_select_repo", "select:repo count:100 snapshot", "repo", f", {_bm25(['snapshot'], 'v_code_docs')} SELECT DISTINCT rp.name AS repo FROM hits h {_CODE_FROM} ORDER BY repo LIMIT 100")
_search("q_select_file", "select:file count:50 snapshot", "file_path", f", {_bm25(['snapshot'], 'v_code_docs')} SELECT DISTINCT fr.path AS file_path FROM hits h {_CODE_FROM} ORDER BY file_path LIMIT 50")
_search("q_code_regex", r"count:500 /return [a-z]+;/", "file_path repo score", f", hits AS (SELECT doc_id, CAST(len(regexp_extract_all(content, 'return [a-z]+;')) AS DOUBLE) AS score FROM v_code_docs WHERE regexp_matches(content, 'return [a-z]+;')) SELECT fr.path AS file_path, rp.name AS repo, max(h.score) AS score FROM hits h {_CODE_FROM} GROUP BY fr.path, b.language, rp.name ORDER BY score DESC, file_path, repo LIMIT 500")
_search("q_diff", "type:diff count:300 flush", "commit_hash file_path score", f", {_bm25(['flush'], 'v_diff_docs')} SELECT substr(c.hash, 1, 10) AS commit_hash, d.path AS file_path, h.score FROM hits h JOIN v_diffs d ON d.id = h.doc_id JOIN v_commits c ON c.id = d.commit_id ORDER BY score DESC, h.doc_id LIMIT 300")
_search("q_diff_filters", "type:diff count:300 author:an after:2021-01-01 before:2025-01-01 -file:vendor return", "commit_hash author message file_path", f", {_bm25(['return'], 'v_diff_docs')} SELECT substr(c.hash, 1, 10) AS commit_hash, c.author, substr(c.message, 1, 80) AS message, d.path AS file_path FROM hits h JOIN v_diffs d ON d.id = h.doc_id JOIN v_commits c ON c.id = d.commit_id WHERE c.author ILIKE '%an%' AND c.timestamp < epoch(TIMESTAMP '2025-01-01') AND c.timestamp > epoch(TIMESTAMP '2021-01-01') AND NOT d.path ILIKE '%vendor%' ORDER BY h.score DESC, h.doc_id LIMIT 300")
_search("q_diff_files", "type:diff select:file count:100 ledger", "file_path", f", {_bm25(['ledger'], 'v_diff_docs')} SELECT DISTINCT d.path AS file_path FROM hits h JOIN v_diffs d ON d.id = h.doc_id JOIN v_commits c ON c.id = d.commit_id ORDER BY file_path LIMIT 100")
_search("q_commit", "type:commit count:400 author:michael -author:(they", "commit_hash author message", "SELECT substr(hash, 1, 10) AS commit_hash, author, substr(message, 1, 80) AS message FROM v_commits WHERE author ILIKE '%michael%' AND NOT author ILIKE '%(they%' ORDER BY timestamp DESC NULLS LAST, hash LIMIT 400")
_search("q_commit_text", "type:commit count:300 was dropped OR gives up", "commit_hash", "SELECT substr(hash, 1, 10) AS commit_hash FROM v_commits WHERE message ILIKE '%was dropped%' OR message ILIKE '%gives up%' ORDER BY timestamp DESC NULLS LAST, hash LIMIT 300")
_search("q_commit_time", "type:commit count:300 after:2022-05-01 before:2022-12-31T12:00:00 message:the -message:retries repo:repo1", "commit_hash message", "SELECT substr(c.hash, 1, 10) AS commit_hash, substr(message, 1, 80) AS message FROM v_commits c JOIN v_repos rp ON rp.id = c.repo_id WHERE message ILIKE '%the%' AND NOT message ILIKE '%retries%' AND timestamp < epoch(TIMESTAMP '2022-12-31 12:00:00') AND timestamp > epoch(TIMESTAMP '2022-05-01') AND rp.name ILIKE '%repo1%' ORDER BY timestamp DESC NULLS LAST, hash LIMIT 300")
_TREE = "JOIN v_blobs b ON b.id = {b} JOIN v_file_revs fr ON fr.blob_id = b.id JOIN v_refs r ON r.commit_id = fr.commit_id"
_search("q_symbol", "type:symbol count:400 lang:go late", "file_path symbol_name symbol_kind line", f"SELECT fr.path AS file_path, s.name AS symbol_name, s.kind AS symbol_kind, CAST(s.line AS BIGINT) AS line FROM v_symbols s {_TREE.format(b='s.blob_id')} WHERE s.name ILIKE '%late%' AND r.name = 'refs/heads/main' AND b.language = 'go' ORDER BY file_path, s.line, symbol_name, symbol_kind, s.id, r.id LIMIT 400")
_search("q_symbol_kind", "type:symbol select:symbol.class count:400 file:*.java", "file_path symbol_name line", f"SELECT fr.path AS file_path, s.name AS symbol_name, CAST(s.line AS BIGINT) AS line FROM v_symbols s {_TREE.format(b='s.blob_id')} WHERE s.kind = 'class' AND r.name = 'refs/heads/main' AND regexp_matches(lower(fr.path), '(?s)^.*\\.java$') ORDER BY file_path, s.line, symbol_name, s.id, r.id LIMIT 400")
_search("q_returns", "returns:int count:400", "file_path symbol_name symbol_kind line", f"SELECT fr.path AS file_path, s.name AS symbol_name, s.kind AS symbol_kind, CAST(s.line AS BIGINT) AS line FROM v_symbols s {_TREE.format(b='s.blob_id')} WHERE s.return_type ILIKE '%int%' AND s.kind IN ('function', 'method') AND r.name = 'refs/heads/main' ORDER BY file_path, s.line, symbol_name, symbol_kind, s.id, r.id LIMIT 400")
_search("q_calls", "calls:append count:400", "file_path symbol_name symbol_kind line", f"SELECT DISTINCT fr.path AS file_path, s.name AS symbol_name, s.kind AS symbol_kind, CAST(s.line AS BIGINT) AS line FROM v_symbol_refs sr JOIN v_symbols s ON s.id = sr.symbol_id {_TREE.format(b='sr.blob_id')} WHERE sr.ref_name ILIKE '%append%' AND sr.kind = 'call' AND s.kind = 'function' AND r.name = 'refs/heads/main' ORDER BY file_path, line, symbol_name, symbol_kind LIMIT 400")
_search("q_calledby", "calledby:*late* count:400 -file:vendor", "file_path symbol_name symbol_kind line", f"SELECT DISTINCT fr.path AS file_path, sr.ref_name AS symbol_name, sr.kind AS symbol_kind, CAST(sr.line AS BIGINT) AS line FROM v_symbols s JOIN v_symbol_refs sr ON sr.symbol_id = s.id AND sr.blob_id = s.blob_id {_TREE.format(b='s.blob_id')} WHERE regexp_matches(lower(s.name), '(?s)^.*late.*$') AND sr.kind = 'call' AND s.kind = 'function' AND r.name = 'refs/heads/main' AND NOT fr.path ILIKE '%vendor%' ORDER BY line, file_path, symbol_name, symbol_kind LIMIT 400")

# --- text index -------------------------------------------------------------------------------------------------------

_TOKS = "toks AS (SELECT doc_id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+') AS w FROM v_code_docs)"
_put("ft_terms", lambda s, d: fulltext.term_table(_corpus(s, d)["code_docs"]).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf")), f", {_TOKS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM toks) GROUP BY ALL) GROUP BY term")
_put("ft_lengths", lambda s, d: fulltext.length_table(_corpus(s, d)["code_docs"]).select("doc_id", F.col("len").cast("long").alias("len")), f", {_TOKS} SELECT doc_id, len(w) AS len FROM toks WHERE len(w) > 0")


def _rank(name: str, text: str, sql: str | None) -> None:
    _put(name, lambda s, d: _ranked(s, d, parse(text).groups), sql)


def _ranked(spark: SparkSession, d: str, groups: list[list[Term]]) -> DataFrame:
    return fulltext.rank(*Engine.over_indexed_corpus(spark, d, "code").indexes["code"], groups)


_rank("ft_and", "buffer flush", f", {_bm25(['buffer', 'flush'], 'v_code_docs')} SELECT doc_id, score FROM hits")
_PHRASE = "{t} SELECT doc_id FROM toks WHERE list_contains(list_transform(range(1, len(w)), lambda k: w[k] = 'return' AND w[k + 1] = 'none'), true)"
_put("ft_phrase", lambda s, d: _ranked(s, d, [[Term("return None", True)]]).select("doc_id"), ", " + _PHRASE.format(t=_TOKS))
_put("ft_wildcard", lambda s, d: _ranked(s, d, parse("*_item").groups).select("doc_id"), f", {_TOKS} SELECT doc_id FROM toks WHERE len(list_filter(w, lambda x: regexp_matches(x, '^.*_item$'))) > 0")
_put("ft_fuzzy", lambda s, d: _ranked(s, d, parse("ledgr~1").groups).select("doc_id"), f", {_TOKS} SELECT doc_id FROM toks WHERE len(list_filter(w, lambda x: abs(len(x) - 5) <= 1 AND levenshtein(x, 'ledgr') <= 1)) > 0")
_put("ft_must_not", lambda s, d: _ranked(s, d, parse("+ledger -return").groups).select("doc_id"), f", {_TOKS} SELECT doc_id FROM toks WHERE list_contains(w, 'ledger') AND NOT list_contains(w, 'return')")
_put("ft_boost", lambda s, d: _ranked(s, d, parse("ledger^2").groups).select("doc_id", F.round(F.col("score"), 2).alias("score")), f", {_bm25(['ledger'], 'v_code_docs')}, x AS (SELECT t.doc_id, 2 * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al)) AS sc FROM tf_hits t JOIN df_hits USING (term), st_hits) SELECT doc_id, round(round(sc, 4), 2) AS score FROM x")
_put("ft_regex", lambda s, d: fulltext.regex_rank(_corpus(s, d)["code_docs"], r"[a-z]+\(\)"), r" SELECT doc_id, CAST(len(regexp_extract_all(content, '[a-z]+\(\)')) AS DOUBLE) AS score FROM v_code_docs WHERE regexp_matches(content, '[a-z]+\(\)')")
_put("ft_substring", lambda s, d: _corpus(s, d)["code_docs"].where(F.contains("content", F.lit('println!("{}"'))).select("doc_id", fulltext.snippet("content", ['println!("{}"']).alias("snippet")).distinct(), f" SELECT doc_id, {_SNIP.format(test='contains(lower(l), $$println!(@{}@$$)')} AS snippet FROM v_code_docs d WHERE contains(content, $$println!(@{{}}@$$)".replace("@", '"'))


def _function(spark: SparkSession, d: str) -> DataFrame:
    return Engine.over_indexed_corpus(spark, d, "code").sql("SELECT blob_id, score FROM code_search('shard token')")


_put("ft_function_scan", lambda s, d: Engine.over_corpus(s, d).sql("SELECT blob_id, score FROM code_search('shard token')"), f", {_bm25(['shard', 'token'], 'v_code_docs')} SELECT doc_id AS blob_id, score FROM hits")
_put("ft_function_diff", lambda s, d: Engine.over_indexed_corpus(s, d, "diff").sql("SELECT diff_id, score FROM diff_search('flush')"), f", {_bm25(['flush'], 'v_diff_docs')} SELECT doc_id AS diff_id, score FROM hits")
_put("ft_function_regex", lambda s, d: Engine.over_corpus(s, d).sql("SELECT diff_id, score FROM diff_search('return [a-z]+;', true)"), " SELECT doc_id AS diff_id, CAST(len(regexp_extract_all(content, 'return [a-z]+;')) AS DOUBLE) AS score FROM v_diff_docs WHERE regexp_matches(content, 'return [a-z]+;')")
_put("ft_scan", lambda s, d: fulltext.rank(fulltext.scan_terms(c := _corpus(s, d)["code_docs"], g := parse("buffer flush").groups), fulltext.length_table(c), g), f", {_bm25(['buffer', 'flush'], 'v_code_docs')} SELECT doc_id, score FROM hits")
_put("ft_function", _function, f", {_bm25(['shard', 'token'], 'v_code_docs')} SELECT doc_id AS blob_id, score FROM hits")

# --- joins ------------------------------------------------------------------------------------------------------------


def _hit_join(spark: SparkSession, d: str) -> DataFrame:
    """J1/J2/J8: text hits with all their places at the tips of main, by one join chain instead of a query for each hit."""
    t = _corpus(spark, d)
    hits = t["code_docs"].where(F.contains("content", F.lit("walker"))).select(F.col("doc_id").alias("blob_id")).distinct()
    tips = t["refs"].where("name = 'refs/heads/main'").select("repo_id", "commit_id")
    return hits.join(t["file_revs"], "blob_id").join(tips, "commit_id").join(t["repos"].select(F.col("id").alias("repo_id"), F.col("name").alias("repo")), "repo_id").select("blob_id", "path", "repo")


_put("j_hits", _hit_join, " SELECT c.doc_id AS blob_id, f.path, rp.name AS repo FROM v_code_docs c JOIN v_file_revs f ON f.blob_id = c.doc_id JOIN v_refs r ON r.commit_id = f.commit_id JOIN v_repos rp ON rp.id = r.repo_id WHERE contains(c.content, 'walker') AND r.name = 'refs/heads/main'")
_put("j_semi", lambda s, d: (t := _corpus(s, d))["commits"].join(t["repos"].where("name LIKE '%repo1%'").select(F.col("id").alias("repo_id")), "repo_id", "left_semi").select("id", "repo_id"), " SELECT id, repo_id FROM v_commits WHERE repo_id IN (SELECT id FROM v_repos WHERE name LIKE '%repo1%')")
_put("j_anti", lambda s, d: (t := _corpus(s, d))["commits"].join(t["refs"].select(F.col("commit_id").alias("id")), "id", "left_anti").select("id"), " SELECT id FROM v_commits WHERE id NOT IN (SELECT commit_id FROM v_refs)")
_put("j_call_graph", lambda s, d: (t := _corpus(s, d))["symbol_refs"].alias("r").join(t["symbols"].alias("a"), F.expr("a.id = r.symbol_id")).join(t["symbols"].alias("b"), F.expr("b.blob_id = r.blob_id AND b.line = r.line")).select(F.col("a.name").alias("caller"), F.col("b.name").alias("callee"), F.col("r.line").alias("line")), " SELECT a.name AS caller, b.name AS callee, r.line FROM v_symbol_refs r JOIN v_symbols a ON a.id = r.symbol_id JOIN v_symbols b ON b.blob_id = r.blob_id AND b.line = r.line")
_put("j_parents", lambda s, d: (t := _corpus(s, d))["commit_parents"].join(t["commits"].select(F.col("id").alias("commit_id"), F.col("hash")), "commit_id").join(t["commits"].select(F.col("id").alias("parent_id"), F.col("hash").alias("parent_hash")), "parent_id").select("hash", "parent_hash"), " SELECT c.hash, p.hash AS parent_hash FROM v_commit_parents e JOIN v_commits c ON c.id = e.commit_id JOIN v_commits p ON p.id = e.parent_id")
_put("j_innermost", lambda s, d: intervals.innermost((t := _corpus(s, d))["symbol_refs"].select("id", "blob_id", "line", "col"), t["symbols"].where("end_line IS NOT NULL")), " SELECT ref_id, arg_max(symbol_id, {'a': sl, 'b': sc, 'c': -el, 'd': symbol_id}) AS symbol_id FROM (SELECT r.id AS ref_id, s.id AS symbol_id, s.line AS sl, s.col AS sc, s.end_line AS el FROM v_symbol_refs r JOIN v_symbols s ON s.blob_id = r.blob_id AND (r.line > s.line OR (r.line = s.line AND r.col >= s.col)) AND (r.line < s.end_line OR (r.line = s.end_line AND r.col < s.end_col)) WHERE s.end_line IS NOT NULL) GROUP BY ref_id")
_put("j_nesting", lambda s, d: intervals.nesting(_corpus(s, d)["symbols"].where("end_line IS NOT NULL")), " SELECT a.id AS symbol_id, arg_max(b.id, {'a': b.line, 'b': b.col, 'c': -b.end_line, 'd': b.id}) AS container_id FROM v_symbols a JOIN v_symbols b ON a.blob_id = b.blob_id AND a.id <> b.id AND (b.line < a.line OR (b.line = a.line AND b.col <= a.col)) AND (b.end_line > a.end_line OR (b.end_line = a.end_line AND b.end_col >= a.end_col)) AND (b.line, b.col, b.end_line, b.end_col) <> (a.line, a.col, a.end_line, a.end_col) WHERE a.end_line IS NOT NULL AND b.end_line IS NOT NULL GROUP BY a.id")

# --- steps of indexing ------------------------------------------------------------------------------------------------


def _trees(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of each repository: files at even commits before, all files of its commits after."""
    t = _corpus(spark, d)
    placed = t["file_revs"].join(t["commits"].select(F.col("id").alias("commit_id"), "repo_id"), "commit_id")
    latest = lambda df: df.groupBy("repo_id", "path").agg(F.max_by("blob_id", F.struct("commit_id", "blob_id")).alias("blob_id"))
    return latest(placed.where("commit_id % 3 <> 0")), latest(placed.where("commit_id % 3 <> 1"))


_put("ix_tree_diff", lambda s, d: dataflow.tree_diff(*_trees(s, d), key="repo_id"), " , pl AS (SELECT f.*, c.repo_id FROM v_file_revs f JOIN v_commits c ON c.id = f.commit_id), a AS (SELECT repo_id, path, max_by(blob_id, {'c': commit_id, 'b': blob_id}) AS blob_id FROM pl WHERE commit_id % 3 <> 0 GROUP BY ALL), b AS (SELECT repo_id, path, max_by(blob_id, {'c': commit_id, 'b': blob_id}) AS blob_id FROM pl WHERE commit_id % 3 <> 1 GROUP BY ALL) SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.path, b.path) AS path, a.blob_id AS old_blob_id, b.blob_id AS new_blob_id, CASE WHEN a.blob_id IS NULL THEN 'added' WHEN b.blob_id IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.repo_id = b.repo_id AND a.path = b.path WHERE a.blob_id IS DISTINCT FROM b.blob_id")


def _diff_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = _corpus(spark, d)["code_docs"]
    new = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("content").alias("new"))
    both = docs.withColumnRenamed("content", "old").join(new, "doc_id", "full")
    return both.select("doc_id", F.md5(dataflow.diff_text(F.concat(F.lit("src/f"), F.col("doc_id").cast("string")), "old", "new")).alias("digest")).distinct()


_LINES = "CASE WHEN {x} IS NULL THEN '' ELSE coalesce(array_to_string(list_transform(string_split({x}, chr(10))[1:100], lambda l: '{s}' || l || chr(10)), ''), '') END"
_put("ix_diff_text", _diff_texts, " , b AS (SELECT coalesce(a.doc_id, n.doc_id - 1) AS doc_id, a.content AS old, n.content AS new FROM v_code_docs a FULL JOIN v_code_docs n ON n.doc_id - 1 = a.doc_id) SELECT doc_id, md5('--- a/src/f' || doc_id || chr(10) || '+++ b/src/f' || doc_id || chr(10) || " + _LINES.format(x="old", s="-") + " || " + _LINES.format(x="new", s="+") + ") AS digest FROM b")
_put("ix_known", lambda s, d: dataflow.insert_or_ignore(table(s, d, "run_records").where("record_kind = 'commit'").select(F.col("record_key").alias("hash")), _corpus(s, d)["commits"], ["hash"]), " SELECT DISTINCT record_key AS hash FROM run_records WHERE record_kind = 'commit' AND record_key NOT IN (SELECT hash FROM v_commits)")
_put("sk_upsert", lambda s, d: dataflow.upsert(_corpus(s, d)["refs"].select(F.concat_ws(":", "repo_id", "name").alias("key"), F.col("commit_id").alias("value"), F.lit(0).cast("long").alias("batch")), table(s, d, "run_records").where("record_kind = 'ref' AND record_key IS NOT NULL").select(F.col("record_key").alias("key"), F.col("record_value").alias("value"), F.col("run_id").alias("batch")), ["key"], "batch").select("key", "value"), " SELECT key, max_by(value, {'b': batch, 'v': coalesce(value, -1)}) AS value FROM (SELECT CAST(repo_id AS VARCHAR) || ':' || name AS key, commit_id AS value, 0 AS batch FROM v_refs UNION ALL SELECT record_key, record_value, run_id FROM run_records WHERE record_kind = 'ref' AND record_key IS NOT NULL) GROUP BY key")
_put("sk_replace", lambda s, d: dataflow.replace_where((t := _corpus(s, d))["file_revs"], t["file_revs"].where("blob_id % 2 = 0"), t["refs"].select("commit_id").distinct(), ["commit_id"]).select("id", "commit_id", "path"), " SELECT id, commit_id, path FROM v_file_revs WHERE commit_id NOT IN (SELECT commit_id FROM v_refs) OR blob_id % 2 = 0 AND commit_id IN (SELECT commit_id FROM v_refs)")
_put("ix_unparsed", lambda s, d: _corpus(s, d)["blobs"].where("NOT parsed AND language IN ('go', 'rust', 'python')").select("id", "language"), " SELECT id, language FROM v_blobs WHERE NOT parsed AND language IN ('go', 'rust', 'python')")
_put("ix_blob_dedup", lambda s, d: (t := _corpus(s, d))["file_revs"].groupBy("blob_id").agg(F.min_by(language_of("path"), "path").alias("language"), F.min("path").alias("first_path")), " , e AS (SELECT blob_id, path, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext FROM v_file_revs), m AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{v}')" for e, v in BY_EXTENSION.items()) + ") t(ext, lang)) SELECT f.blob_id, m.lang AS language, f.path AS first_path FROM (SELECT blob_id, min(path) AS path FROM e GROUP BY blob_id) f JOIN e ON e.blob_id = f.blob_id AND e.path = f.path LEFT JOIN m ON m.ext = e.ext GROUP BY ALL")
_put("ix_tip_snapshot", lambda s, d: (t := _corpus(s, d))["refs"].join(t["commits"].select(F.col("id").alias("commit_id")), "commit_id", "left_semi").join(t["file_revs"].select("commit_id", "path", "blob_id"), "commit_id").select(F.col("name").alias("ref"), "path", "blob_id"), " SELECT r.name AS ref, f.path, f.blob_id FROM v_refs r JOIN v_file_revs f ON f.commit_id = r.commit_id WHERE r.commit_id IN (SELECT id FROM v_commits)")
_put("ix_valid_utf8", lambda s, d: _corpus(s, d)["code_docs"].where(F.is_valid_utf8("content") & (F.length("content") > 0)).select("doc_id", F.sha1(F.concat(F.lit("blob "), F.octet_length("content").cast("string"), F.lit("\0"), "content")).alias("object_id")).distinct(), " SELECT doc_id, sha1(encode('blob ' || octet_length(encode(content)) || chr(0) || content)) AS object_id FROM v_code_docs WHERE length(content) > 0")

# --- documented queries, functions, counters --------------------------------------------------------------------------

_put("a_most_called", lambda s, d: _corpus(s, d)["symbol_refs"].where("kind = 'call'").groupBy("ref_name").agg(F.count(F.lit(1)).alias("calls")).orderBy(F.desc("calls"), "ref_name").limit(15), " SELECT ref_name, count(*) AS calls FROM v_symbol_refs WHERE kind = 'call' GROUP BY ref_name ORDER BY calls DESC, ref_name LIMIT 15")
_put("a_languages", lambda s, d: _corpus(s, d)["blobs"].groupBy("language").agg(F.count(F.lit(1)).alias("blobs"), F.sum(F.col("parsed").cast("long")).alias("parsed")), " SELECT language, count(*) AS blobs, CAST(sum(CAST(parsed AS BIGINT)) AS BIGINT) AS parsed FROM v_blobs GROUP BY language")
_put("a_param_places", lambda s, d: (t := _corpus(s, d))["symbols"].where("params LIKE '%schema%'").join(t["file_revs"].select("blob_id", "path"), "blob_id").select(F.concat_ws(":", "path", "line").alias("place"), "name").distinct(), " SELECT DISTINCT path || ':' || line AS place, name FROM v_symbols s JOIN v_file_revs f ON f.blob_id = s.blob_id WHERE params LIKE '%schema%'")
_put("a_stats", lambda s, d: dataflow.counters(_corpus(s, d), ["commits", "blobs", "symbols", "symbol_refs", "file_revs"]), " SELECT 'commits' AS name, count(*) AS n FROM v_commits UNION ALL SELECT 'blobs', count(*) FROM v_blobs UNION ALL SELECT 'symbols', count(*) FROM v_symbols UNION ALL SELECT 'symbol_refs', count(*) FROM v_symbol_refs UNION ALL SELECT 'file_revs', count(*) FROM v_file_revs")
_put("fn_language", lambda s, d: _corpus(s, d)["file_revs"].select("path").distinct().select("path", language_of("path").alias("language")), " , m AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{v}')" for e, v in BY_EXTENSION.items()) + ") t(ext, lang)) SELECT p.path, m.lang AS language FROM (SELECT DISTINCT path FROM v_file_revs) p LEFT JOIN m ON m.ext = lower(regexp_extract(p.path, '\\.([^./]*)$', 1))")
_put("fn_repo_name", lambda s, d: _corpus(s, d)["repos"].select("id", repo_name_of(F.concat(F.lit("https://"), "name", F.lit(".git//"))).alias("name")), " SELECT id, name FROM v_repos")
_put("fn_json", lambda s, d: _corpus(s, d)["commits"].select("id", F.to_json(F.struct("author", "message"), {"ignoreNullFields": "true"}).alias("json")).select("id", F.get_json_object("json", "$.author").alias("author")), " SELECT id, author FROM v_commits")
_put("fn_previous", lambda s, d: _corpus(s, d)["symbols"].select("id", "blob_id", (F.col("line") - F.lag("line").over(Window.partitionBy("blob_id").orderBy("line", "col", "id"))).alias("gap")).where("gap > 0"), " SELECT id, blob_id, gap FROM (SELECT id, blob_id, line - lag(line) OVER (PARTITION BY blob_id ORDER BY line, col, id) AS gap FROM v_symbols) WHERE gap > 0")
