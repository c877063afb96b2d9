"""What raw SQL over the tables must be able to do, one query for each operator, run through the engine's sql(), or by an operator that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import model
from strata.engine import Engine
from strata.operators.dataflow import counted_series
from strata.operators.hierarchy import climbed
from strata.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The text of each query for the engine's sql().
TEXT: dict[str, str] = {}
#: What makes the rows of a query in its place.
ROWS: dict[str, Callable[[Engine], DataFrame]] = {}
_TABLES = ("repos", "commits", "commit_parents", "refs", "blobs", "file_revs", "diffs", "symbols", "symbol_refs", "code_docs", "diff_docs")


def _put(name: str, sql: str, duck: str | None = None, rows: Callable[[Engine], DataFrame] | None = None) -> None:
    """sql names tables as {table}; duck is the text for DuckDB where it must differ; rows gives the rows of sql where sql itself can't over large tables."""
    TEXT[name] = sql.format(**{t: t for t in _TABLES})
    if rows is not None:
        ROWS[name] = rows

    def run(spark: SparkSession, d: str) -> DataFrame:
        e = Engine.over_corpus(spark, d)
        if rows is not None:
            return rows(e)
        table(spark, d, "events").createOrReplaceTempView("events")
        return e.sql(TEXT[name])

    QUERIES[name] = run
    body = (duck or sql).format(**{t: f"v_{t}" for t in _TABLES})
    views = model.oracle_views()
    if body.upper().startswith("WITH RECURSIVE"):
        SQL[name] = "WITH RECURSIVE" + views[4:] + "," + body[14:]
    elif body.upper().startswith("WITH"):
        SQL[name] = views + "," + body[4:]
    else:
        SQL[name] = f"{views} {body}"


_put("r_left_join", "SELECT b.id, f.path FROM {blobs} b LEFT JOIN {file_revs} f ON f.blob_id = b.id AND f.path LIKE 'src/%'")
_put("r_right_join", "SELECT f.id, b.language FROM {blobs} b RIGHT JOIN {file_revs} f ON f.blob_id = b.id AND b.language = 'go'")
_put("r_full_join", "SELECT c.id AS commit_id, p.parent_id FROM {commits} c FULL OUTER JOIN {commit_parents} p ON p.commit_id = c.id")
_put("r_cross_join", "SELECT a.language, b.kind FROM (SELECT DISTINCT language FROM {blobs}) a CROSS JOIN (SELECT DISTINCT kind FROM {symbols}) b")
_put("r_theta_join", "SELECT a.language AS lo, b.language AS hi FROM (SELECT language, count(*) AS n FROM {blobs} WHERE language IS NOT NULL GROUP BY language) a JOIN (SELECT language, count(*) AS n FROM {blobs} WHERE language IS NOT NULL GROUP BY language) b ON a.n < b.n")
_put("r_using", "SELECT commit_id, name, path FROM {refs} JOIN (SELECT commit_id, path FROM {file_revs}) f USING (commit_id)")
_put("r_natural", "SELECT commit_id, repo_id, parent_id FROM (SELECT commit_id, repo_id FROM {refs}) a NATURAL JOIN {commit_parents}")
_put("r_exists", "SELECT id FROM {commits} c WHERE EXISTS (SELECT 1 FROM {file_revs} f WHERE f.commit_id = c.id) AND NOT EXISTS (SELECT 1 FROM {commit_parents} r WHERE r.parent_id = c.id)")
_put("r_not_in", "SELECT id FROM {blobs} WHERE id NOT IN (SELECT blob_id FROM {symbols} WHERE blob_id IS NOT NULL)")
_put("r_scalar_subquery", "SELECT r.id, (SELECT count(*) FROM {commits} c WHERE c.repo_id = r.id) AS n_commits FROM {repos} r")
_put("r_cte", "WITH n AS (SELECT repo_id, count(*) AS n FROM {commits} GROUP BY repo_id), m AS (SELECT avg(n) AS a FROM n) SELECT repo_id, n FROM n, m WHERE n > a")
_UP = "SELECT up.id, s.parent_id AS above, up.lvl + 1 AS lvl, {add} AS path FROM up JOIN {{symbols}} s ON s.id = up.above WHERE NOT {has}"
_RECURSIVE = "WITH RECURSIVE up(id, above, lvl, path) {deep}AS (SELECT id, parent_id, CAST(0 AS BIGINT), {one} FROM {{symbols}} WHERE parent_id IS NOT NULL UNION ALL " + _UP + ") SELECT id, above, lvl FROM up WHERE above IS NOT NULL"


def _above(e: Engine) -> DataFrame:
    return climbed(e.tables["symbols"].select(F.col("id").alias("child"), F.col("parent_id").alias("parent"))).toDF("id", "above", "lvl")


# every symbol with all symbols above it; a path that comes back to itself ends. Spark's recursion shuffles the whole table once for each level
_put(
    "r_recursive",
    _RECURSIVE.format(deep="MAX RECURSION LEVEL 100000 ", one="array(id)", add="array_append(up.path, s.id)", has="array_contains(up.path, s.id)"),
    _RECURSIVE.format(deep="", one="[id]", add="list_append(up.path, s.id)", has="list_contains(up.path, s.id)"),
    _above,
)
_put("r_union", "SELECT kind FROM {symbols} UNION SELECT kind FROM {symbol_refs}")
_put("r_union_all", "SELECT path FROM {file_revs} UNION ALL SELECT path FROM {diffs}")
_put("r_intersect", "SELECT name FROM {symbols} INTERSECT SELECT ref_name FROM {symbol_refs}")
_put("r_except", "SELECT path FROM {file_revs} EXCEPT SELECT path FROM {diffs}")
_put("r_aggregates", "SELECT blob_id, count(*) AS n, count(parent_id) AS with_parent, CAST(sum(line) AS BIGINT) AS lines, round(avg(line), 6) AS mean_line, min(name) AS first_name, max(end_line) AS last_line FROM {symbols} GROUP BY blob_id")
_put("r_count_distinct", "SELECT kind, count(DISTINCT name) AS names, count(DISTINCT blob_id) AS blobs FROM {symbols} GROUP BY kind")
_put("r_group_concat", "SELECT repo_id, listagg(name, ',') WITHIN GROUP (ORDER BY name) AS names FROM {refs} GROUP BY repo_id", "SELECT repo_id, string_agg(name, ',' ORDER BY name) AS names FROM {refs} GROUP BY repo_id")
_put("r_filter", "SELECT blob_id, count(*) FILTER (WHERE kind = 'call') AS calls, count(*) FILTER (WHERE symbol_id IS NULL) AS outside FROM {symbol_refs} GROUP BY blob_id")
_put("r_having", "SELECT ref_name, count(*) AS n FROM {symbol_refs} GROUP BY ref_name HAVING count(*) > 50")
_put("r_ranking", "SELECT id, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd, CAST(ntile(4) OVER w AS BIGINT) AS q FROM {symbols} WHERE line IS NOT NULL WINDOW w AS (PARTITION BY blob_id ORDER BY line, col, id), v AS (PARTITION BY blob_id ORDER BY kind)")
_put("r_offset", "SELECT id, lag(name, 1, '') OVER w AS before, lead(name) OVER w AS after, first_value(name) OVER w AS first, last_value(name) OVER (PARTITION BY blob_id ORDER BY line, col, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, nth_value(name, 2) OVER (PARTITION BY blob_id ORDER BY line, col, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM {symbols} WINDOW w AS (PARTITION BY blob_id ORDER BY line, col, id)")
_put("r_rows_frame", "SELECT id, CAST(sum(line) OVER (PARTITION BY blob_id ORDER BY line, col, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM {symbols} WHERE line IS NOT NULL")
_put("r_range_frame", "SELECT id, count(*) OVER (PARTITION BY blob_id ORDER BY line RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS n FROM {symbols} WHERE line IS NOT NULL")
_put("r_distinct", "SELECT DISTINCT kind, return_type FROM {symbols}")
_put("r_order_limit", "SELECT id, timestamp FROM {commits} ORDER BY timestamp DESC NULLS LAST, id LIMIT 25 OFFSET 10")
_put("r_case", "SELECT id, CASE WHEN timestamp IS NULL THEN 'none' WHEN timestamp < 1600000000 THEN 'old' ELSE 'new' END AS age, coalesce(nullif(author, ''), 'unknown') AS who FROM {commits}")
_put("r_cast", "SELECT id, CAST(substr(hash, 1, 1) AS STRING) AS c, try_cast(substr(hash, 1, 2) AS INT) AS n FROM {commits}", "SELECT id, CAST(substr(hash, 1, 1) AS VARCHAR) AS c, try_cast(substr(hash, 1, 2) AS INT) AS n FROM {commits}")
_put("r_strings", "SELECT id, length(name) AS n, upper(name) AS u, lower(name) AS l, trim(concat(' ', name, ' ')) AS t, substr(name, 2, 3) AS s, instr(name, '_') AS i, replace(name, '_', '-') AS r, hex(substr(name, 1, 2)) AS h, ascii(name) AS a, concat(name, ':', kind) AS c FROM {symbols}", "SELECT id, length(name) AS n, upper(name) AS u, lower(name) AS l, trim(concat(' ', name, ' ')) AS t, substr(name, 2, 3) AS s, instr(name, '_') AS i, replace(name, '_', '-') AS r, hex(substr(name, 1, 2)) AS h, ascii(name) AS a, name || ':' || kind AS c FROM {symbols}")
_put("r_math", "SELECT id, abs(line - 20) AS a, round(line / 7.0D, 3) AS r, least(line, col) AS lo, greatest(line, col) AS hi, line % 5 AS m, line div 5 AS d FROM {symbols} WHERE line IS NOT NULL AND col IS NOT NULL", "SELECT id, abs(line - 20) AS a, round(line / CAST(7 AS DOUBLE), 3) AS r, least(line, col) AS lo, greatest(line, col) AS hi, line % 5 AS m, line // 5 AS d FROM {symbols} WHERE line IS NOT NULL AND col IS NOT NULL")
_put("r_dates", "SELECT id, date_format(timestamp_seconds(timestamp), 'yyyy-MM-dd') AS day, year(timestamp_seconds(timestamp)) AS y, CAST(unix_seconds(date_trunc('month', timestamp_seconds(timestamp))) AS BIGINT) AS m FROM {commits} WHERE timestamp IS NOT NULL", "SELECT id, strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, CAST(year(to_timestamp(timestamp) AT TIME ZONE 'UTC') AS INT) AS y, CAST(epoch(date_trunc('month', to_timestamp(timestamp) AT TIME ZONE 'UTC')) AS BIGINT) AS m FROM {commits} WHERE timestamp IS NOT NULL")
_put("r_json", "SELECT event_id, get_json_object(props, '$.k') AS k, event_type FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, event_type FROM events")
_put("r_series", "SELECT s.n, count(f.id) AS files FROM (SELECT explode(sequence(lo, hi)) AS n FROM (SELECT min(blob_id) AS lo, max(blob_id) AS hi FROM {file_revs})) s LEFT JOIN {file_revs} f ON f.blob_id = s.n GROUP BY s.n", "SELECT s.n, count(f.id) AS files FROM (SELECT unnest(range(lo, hi + 1)) AS n FROM (SELECT min(blob_id) AS lo, max(blob_id) AS hi FROM {file_revs})) s LEFT JOIN {file_revs} f ON f.blob_id = s.n GROUP BY s.n", lambda e: counted_series(e.tables["file_revs"], "blob_id", "id").toDF("n", "files"))
_put("r_json_each", "SELECT e.event_id, j.key, j.value FROM events e, LATERAL explode(from_json(e.props, 'map<string,string>')) AS j(key, value)", "SELECT e.event_id, j.key, json_extract_string(e.props, '$.' || j.key) AS value FROM events e, json_each(e.props) j")
_put("r_percentile", "SELECT kind, approx_percentile(line, 0.5, 1000000) AS middle, approx_percentile(line, 0.9, 1000000) AS high FROM {symbols} WHERE line IS NOT NULL GROUP BY kind", "SELECT kind, quantile_disc(line, 0.5) AS middle, quantile_disc(line, 0.9) AS high FROM {symbols} WHERE line IS NOT NULL GROUP BY kind")
_put("r_sample", "SELECT abs(count(*) - 0.5 * (SELECT count(*) FROM {symbol_refs})) < 0.1 * (SELECT count(*) FROM {symbol_refs}) AS near FROM {symbol_refs} TABLESAMPLE (50 PERCENT) REPEATABLE (7)", "SELECT true AS near")
_put("r_rollup", "SELECT language, parsed, count(*) AS n, CAST(grouping(language) AS BIGINT) AS gl FROM {blobs} GROUP BY ROLLUP (language, parsed)")
_put("r_cube", "SELECT kind, return_type, count(*) AS n FROM {symbols} GROUP BY CUBE (kind, return_type)")
_put("r_grouping_sets", "SELECT kind, blob_id, count(*) AS n FROM {symbol_refs} GROUP BY GROUPING SETS ((kind), (blob_id), ())")
_put("r_pivot", "SELECT * FROM (SELECT blob_id, kind FROM {symbol_refs}) PIVOT (count(*) FOR kind IN ('call' AS calls, 'type' AS types, 'macro' AS macros))", "SELECT blob_id, nullif(count(*) FILTER (WHERE kind = 'call'), 0) AS calls, nullif(count(*) FILTER (WHERE kind = 'type'), 0) AS types, nullif(count(*) FILTER (WHERE kind = 'macro'), 0) AS macros FROM {symbol_refs} GROUP BY blob_id")
_put("r_like_glob", "SELECT DISTINCT path FROM {file_revs} WHERE path LIKE 'src/%' AND path RLIKE '^.*[.](go|rs)$'", "SELECT DISTINCT path FROM {file_revs} WHERE path LIKE 'src/%' AND regexp_matches(path, '^.*[.](go|rs)$')")
_put("r_any_value", "SELECT path, min_by(blob_id, id) AS first_blob, max_by(blob_id, id) AS last_blob FROM {file_revs} GROUP BY path")


def _meta(spark: SparkSession, d: str) -> DataFrame:
    """Columns of the tables, from their schemas alone."""
    rows = [(t, f.name, f.dataType.simpleString()) for t, df in model.corpus_tables(spark, d).items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string")


QUERIES["r_table_info"] = _meta


def _approx(spark: SparkSession, d: str) -> DataFrame:
    return Engine.over_corpus(spark, d).sql("SELECT kind, approx_count_distinct(name, 0.02) BETWEEN 0.9 * count(DISTINCT name) AND 1.1 * count(DISTINCT name) AS near FROM symbols GROUP BY kind")


QUERIES["r_approx"] = _approx
SQL["r_approx"] = f"{model.oracle_views()} SELECT kind, true AS near FROM v_symbols GROUP BY kind"
