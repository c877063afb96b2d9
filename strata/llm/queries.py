"""Queries of the text operators over the test tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import broken, generated, leaks, names, residue, secrets, syntax, tokenize
from strata.runtime import table


def _code(spark: SparkSession, d: str, languages: list[str] | None = None) -> DataFrame:
    return broken.code_texts(table(spark, d, "bleve_docs"), table(spark, d, "blobs"), languages)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return broken.broken_files(_code(spark, d, list(syntax.CLASSES)), report=False).select("blob_id").distinct()


def p3_errors(spark: SparkSession, d: str) -> DataFrame:
    return broken.broken_files(_code(spark, d, list(syntax.CLASSES)))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    texts = _code(spark, d, list(syntax.CLASSES))
    return broken.rates(broken.broken_files(texts, report=False), texts, table(spark, d, "file_revs"), table(spark, d, "commits"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(names.resolve(table(spark, d, "commits"), "author"))


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling with the least spelling of its entity."""
    known = names.resolve(table(spark, d, "commits"), "author")
    return known.join(known.groupBy("entity").agg(F.min("spelling").alias("name")), "entity").select("spelling", "name")


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """Spellings, their commits and the most used spelling of each entity."""
    commits = table(spark, d, "commits")
    known = names.resolve(commits, "author")
    n = commits.groupBy(F.col("author").alias("spelling")).agg(F.count(F.lit(1)).alias("n"))
    per = known.join(n, "spelling")
    return per.groupBy("entity").agg(F.count(F.lit(1)).alias("n_spellings"), F.sum("n").alias("n_commits"), F.max_by("spelling", F.struct("n", "spelling")).alias("name")).select("name", "n_spellings", "n_commits")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_reasons(spark, d).select("blob_id").distinct()


def p6_reasons(spark: SparkSession, d: str) -> DataFrame:
    return generated.not_hand_written(broken.keyed_texts(table(spark, d, "bleve_docs")), table(spark, d, "blobs"), table(spark, d, "file_revs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_credentials(table(spark, d, "bleve_docs")).select("doc_key", "line_no").distinct()


def p7_places(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_credentials(table(spark, d, "bleve_docs"))


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redact_credentials(table(spark, d, "bleve_docs"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.decode_ids(p8_ids(spark, d), "doc_id", "ids")


P8_DECODED_SQL = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.token_counts(p8_ids(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


_WORDS_SQL = r"string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"
P9_FOUND_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS_SQL} AS w FROM eval_items),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k+11], ' '))) AS g FROM d WHERE len(w) >= 12),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k+11], ' '))) AS g FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""


def p9_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return leaks.overlaps(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents")).select("doc_id").distinct()


def p10_reasons(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_errors, p3_rates, p4_found, p4_members, p4_entities, p6_found, p6_reasons, p7_found, p7_places, p7_redacted, p8_ids, p8_decoded, p8_counts, p9_found, p9_overlaps, p10_found, p10_reasons)}
SQL = {"p8_decoded": P8_DECODED_SQL, "p9_found": P9_FOUND_SQL}
