"""The engine: tables, text indexes, search, SQL and indexing behind one object."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import model
from strata.functions.symbols import register_function
from strata.operators import fulltext
from strata.query.parser import ParsedQuery, Strategy, parse
from strata.query.translate import Translated, strategy, translate
from strata.runtime import scratch

#: The columns of every search result, in order.
RESULT = ("repo", "file_path", "content", "score", "line", "language", "commit_hash", "author", "message", "symbol_name", "symbol_kind")
_RESULT_KINDS = {"score": "double", "line": "long"}
#: Commands that only read (names of Spark's logical plans, fixed values).
_READING = frozenset("ShowNamespaces ShowTables ShowTablesCommand ShowViews ShowColumns ShowColumnsCommand ShowFunctions ShowFunctionsCommand ShowCreateTable ShowPartitions ShowTableProperties ShowCatalogsCommand ShowCurrentNamespace DescribeRelation DescribeColumn DescribeNamespace DescribeFunction DescribeFunctionCommand DescribeQueryCommand DescribeTableCommand ExplainCommand".split())


def writes(spark: SparkSession, text: str) -> str | None:
    """Name of the first node of the parsed statement that does more than read, in subqueries and under EXPLAIN too; None if there is none.

    The statement is parsed, not analysed or run. Every plan that is a command or writes is refused unless it is on the
    list of those that only show something.
    """
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(text)]
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name not in _READING and (command.isInstance(node) or re.match(r"Insert|Create|Replace|Drop|Alter|Set|Merge|Delete|Update|Overwrite|Append|Cache|Uncache|Compound|SingleStatement|Unresolved(?:Table|View)Spec", name)):
            return name
        if name == "ExplainCommand":
            todo.append(node.logicalPlan())
            continue
        for nodes in (node.children(), node.innerChildren(), node.subqueries()):
            for i in range(nodes.size()):
                child = nodes.apply(i)
                if spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan").isInstance(child):
                    todo.append(child)
    return None


#: Folders of the indexes that over_indexed_corpus has written, by application, data and kind.
_written: dict[tuple[str, str, str], str] = {}


class Engine:
    """Search and SQL over one set of tables. Nothing is computed before a result is asked for."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], indexes: dict[str, tuple[DataFrame, DataFrame]] | None = None):
        self.spark = spark
        self.tables = {name: tables[name] if name in tables else model.empty(spark, name) for name in model.SCHEMAS}
        #: (terms, lengths) of 'code' and 'diff', where they are stored
        self.indexes = indexes or {}

    @classmethod
    def over_corpus(cls, spark: SparkSession, sf_dir: str) -> Engine:
        return cls(spark, model.corpus_tables(spark, sf_dir))

    @classmethod
    def over_indexed_corpus(cls, spark: SparkSession, sf_dir: str, *kinds: str) -> Engine:
        """over_corpus with the text indexes of kinds, which are written to the shared folder when the application first asks for them."""
        e = cls(spark, model.corpus_tables(spark, sf_dir))
        for kind in kinds:
            key = (spark.sparkContext.applicationId, sf_dir, kind)
            if key not in _written:
                root = scratch(spark, f"{kind}-index")
                terms, lengths = e.index_texts(kind)
                # each file holds a range of terms, in order: a search reads the row groups of its words
                terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{root}/terms")
                lengths.write.parquet(f"{root}/lengths")
                _written[key] = root
            e.indexes[kind] = tuple(spark.read.parquet(f"{_written[key]}/{t}") for t in ("terms", "lengths"))
        return e

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Engine:
        """The tables of the store at root; empty tables where it is new."""
        from strata.sources.store import Store

        store = Store(spark, root)
        return cls(spark, store.read_all(), store.read_indexes())

    def hits(self, q: ParsedQuery) -> DataFrame:
        """(doc_id, score) of all documents that match, unranked. With a stored index no text is read."""
        kind = q.type.value
        docs = self.tables[f"{kind}_docs"]
        if q.is_regex:
            return fulltext.regex_rank(docs, q.texts[0])
        terms, lengths = self.indexes.get(kind) or (fulltext.scan_terms(docs, q.groups), fulltext.length_table(docs))
        return fulltext.rank(terms, lengths, q.groups)

    def snippets(self, top: DataFrame, q: ParsedQuery) -> DataFrame:
        """top, whose content holds document ids, with the documents' snippets instead. top has at most a search's limit of
        rows, and so it is what is broadcast; texts are read where they lie, and cut for these rows only."""
        needles = [q.texts[0]] if q.is_regex else list(dict.fromkeys(c.words[0] for g in q.groups for c in fulltext.clauses(g) if c.words and c.sign != "-"))
        text = self.tables[f"{q.type.value}_docs"].select(F.col("doc_id").alias("_doc"), F.col("content").alias("_text"))
        wanted = top.withColumn("_doc", F.col("content").cast("long")).withColumn("_row", F.monotonically_increasing_id())
        rest = [c for c in top.columns if c != "content"]
        found = text.join(F.broadcast(wanted.drop("content")), "_doc").select("_row", *rest, fulltext.snippet("_text", needles, q.is_regex).alias("content"))
        # exact copies of a text give a row once
        return found.dropDuplicates(["_row"]).orderBy("_row").select(*top.columns)

    def search(self, text: str) -> DataFrame:
        """Result rows of a search string in the columns RESULT; those that a kind of search doesn't fill are null.

        By its strategy a search reads the metadata alone, or ranks the text index first. Only the rows that are left after the limit are
        joined with their texts.
        """
        q = parse(text)
        views, hits = dict(self.tables), None
        if strategy(q) is not Strategy.SQL_ONLY:
            translate(q)  # errors first
            hits = "found_hits"
            views[hits] = self.hits(q).withColumn("snippet", F.col("doc_id").cast("string"))
        t = translate(q, hits)
        df = self._run(t.sql, t.args, views)
        if hits and "content" in df.columns:
            df = self.snippets(df, q)
        have = set(df.columns)
        return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(_RESULT_KINDS.get(c, "string")).alias(c) for c in RESULT])

    def translate(self, text: str) -> Translated:
        """The SQL and the values of a search string."""
        return translate(parse(text))

    def _run(self, sql: str, args: dict, views: dict[str, DataFrame]) -> DataFrame:
        """Run sql over views of private names: two engines in one session don't meet."""
        mark = uuid.uuid4().hex[:8]
        for name, df in views.items():
            found = re.compile(rf"(?<![\w.'`]){name}(?![\w.'(`])")
            if found.search(sql):
                sql = found.sub(f"{name}_{mark}", sql)
                df.createOrReplaceTempView(f"{name}_{mark}")
        try:
            return self.spark.sql(sql, args=args or None)
        finally:
            for name in views:
                self.spark.catalog.dropTempView(f"{name}_{mark}")

    def sql(self, text: str, **args: object) -> DataFrame:
        """Any reading SQL over the tables, code_search and diff_search included; statements that write are refused."""
        if node := writes(self.spark, text):
            raise ValueError(f"only statements that read are allowed, not {node}")
        self.register()
        return self.spark.sql(text, args=args or None)

    def register(self) -> None:
        """The tables as temporary views and the text searches as table functions of the session, over the stored indexes where there are any."""
        for name, df in self.tables.items():
            (df.dropDuplicates(["doc_id"]) if name.endswith("_docs") else df).createOrReplaceTempView(name)
        register_function(self.spark)
        for kind in ("code", "diff"):
            self.tables[f"{kind}_docs"].createOrReplaceTempView(f"all_{kind}_docs")
            for name, df in zip(("terms", "lengths"), self.indexes.get(kind, ())):
                df.createOrReplaceTempView(f"{kind}_{name}")
            self.spark.sql(_search_function(kind, kind in self.indexes))

    @contextlib.contextmanager
    def tagged(self, tag: str) -> Iterator[None]:
        """Jobs started inside carry the tag; cancel(tag), from any thread, ends them."""
        self.spark.sparkContext.addJobTag(tag)
        try:
            yield
        finally:
            self.spark.sparkContext.removeJobTag(tag)

    def cancel(self, tag: str) -> None:
        self.spark.sparkContext.cancelJobsWithTag(tag)

    def index_texts(self, kind: str) -> tuple[DataFrame, DataFrame]:
        """(terms, lengths) of the code or diff texts."""
        docs = self.tables[f"{kind}_docs"]
        return fulltext.term_table(docs), fulltext.length_table(docs)

    def with_indexes(self, *kinds: str) -> Engine:
        return Engine(self.spark, self.tables, {**self.indexes, **{k: self.index_texts(k) for k in kinds}})


def _search_function(kind: str, indexed: bool) -> str:
    """A table function in SQL: AND of the words of q ranked by BM25, or, as a regular expression, by occurrences.

    The words are looked up by equality in the stored terms, or each text is asked for each word where there is no index.
    """
    name, docs, key = f"{kind}_search", f"all_{kind}_docs", "blob_id" if kind == "code" else "diff_id"
    token = r"[\\p{L}\\p{N}_]+"
    asked = f"array_distinct(regexp_extract_all(lower({name}.q), '{token}', 0))"
    if indexed:
        tf = f"""lens AS (SELECT doc_id, len FROM {kind}_lengths),
asked AS (SELECT explode({asked}) AS term),
tf AS (SELECT t.doc_id, l.len, t.term, t.tf FROM {kind}_terms t JOIN asked a ON a.term = t.term JOIN lens l ON l.doc_id = t.doc_id WHERE NOT {name}.is_regex)"""
    else:
        tf = f"""toks AS (SELECT DISTINCT doc_id, size(w) AS len, transform({asked}, a -> named_struct('term', a, 'tf', size(filter(w, x -> x = a)))) AS found
  FROM (SELECT doc_id, regexp_extract_all(lower(content), '{token}', 0) AS w FROM {docs} WHERE NOT {name}.is_regex AND content IS NOT NULL)),
lens AS (SELECT doc_id, len FROM toks WHERE len > 0),
tf AS (SELECT doc_id, len, f.term, CAST(f.tf AS BIGINT) AS tf FROM (SELECT doc_id, len, explode(found) AS f FROM toks) WHERE f.tf > 0)"""
    return f"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}(q STRING, is_regex BOOLEAN DEFAULT false)
RETURNS TABLE (doc_id BIGINT, {key} BIGINT, score DOUBLE, snippet STRING) RETURN
WITH {tf},
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
stats AS (SELECT count(*) AS n, avg(len) AS al FROM lens),
ranked AS (SELECT tf.doc_id, round(sum(ln(1 + ((SELECT n FROM stats) - df + 0.5D) / (df + 0.5D)) * tf * 2.2D / (tf + 1.2D * (0.25D + 0.75D * len / (SELECT al FROM stats)))), 4) AS score, count(*) AS met
  FROM tf JOIN df USING (term) GROUP BY tf.doc_id),
found AS (SELECT doc_id, score FROM ranked WHERE met = size({asked})
  UNION ALL SELECT DISTINCT doc_id, CAST(regexp_count(content, {name}.q) AS DOUBLE) FROM {docs} WHERE {name}.is_regex AND content RLIKE {name}.q)
SELECT DISTINCT f.doc_id, f.doc_id AS {key}, f.score, coalesce(substring(regexp_replace(try_element_at(filter(split(d.content, '\\n'), l -> CASE WHEN {name}.is_regex THEN l RLIKE {name}.q ELSE contains(lower(l), try_element_at(regexp_extract_all(lower({name}.q), '{token}', 0), 1)) END), 1), '^\\\\s+|\\\\s+$', ''), 1, 200), '')
FROM found f JOIN {docs} d ON d.doc_id = f.doc_id
"""
