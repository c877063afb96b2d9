"""Ranked full-text search as relational plans.

Documents are (doc_id, content); rows may be repeated as exact copies, and no text is moved to tell them apart. Terms are lower-case runs of letters, digits and underscores. The index is two tables -
terms (term, doc_id, tf, positions) and lengths (doc_id, len) - and a search is one join, one aggregation and one top-k.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.query.parser import Term

TOKEN = r"[\p{L}\p{N}_]+"
K1, B = 1.2, 0.75


def tokens(content: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(content), F.lit(TOKEN), F.lit(0))


def words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def term_table(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions): one row for each different term of each document; positions count from 0."""
    each = docs.where("content IS NOT NULL").select("doc_id", F.posexplode(tokens("content")).alias("pos", "term"))
    return _postings(each)


def _postings(each: DataFrame) -> DataFrame:
    """Rows (term, doc_id, pos) to postings; positions are a set, so that repeated copies of a document count once."""
    sets = each.groupBy("term", "doc_id").agg(F.sort_array(F.collect_set("pos")).alias("positions"))
    return sets.select("term", "doc_id", F.size("positions").cast("long").alias("tf"), "positions")


def length_table(docs: DataFrame) -> DataFrame:
    """(doc_id, len): tokens of each document that has any."""
    return docs.where("content IS NOT NULL").select("doc_id", F.size(tokens("content")).alias("len")).where("len > 0").distinct()


@dataclass(frozen=True)
class Clause:
    """One searched item: words in order (several make a phrase), how it is matched, its weight, and + or - before it."""

    words: tuple[str, ...]
    fuzzy: int = 0
    wildcard: str = ""
    boost: float = 1.0
    sign: str = ""


def clauses(group: list[Term]) -> list[Clause]:
    """Search items of an AND group. Outside phrases: +w must, -w must not occur, w~n allows n edits, w^b weighs, * and ? are wildcards."""
    out = []
    for t in group:
        text, sign, boost, fuzzy = t.text, "", 1.0, 0
        if not t.phrase:
            if len(text) > 1 and text[0] in "+-":
                sign, text = text[0], text[1:]
            if m := re.fullmatch(r"(.+)\^(\d+(?:\.\d+)?)", text):
                text, boost = m.group(1), float(m.group(2))
            if m := re.fullmatch(r"(\w+)~([0-2])?", text):
                text, fuzzy = m.group(1), int(m.group(2) or 1)
            text = text.removeprefix("content:")
            if re.fullmatch(r"[\w*?]+", text) and ("*" in text or "?" in text):
                out.append(Clause((), 0, "^" + text.lower().replace("*", ".*").replace("?", ".") + "$", boost, sign))
                continue
        if ws := words(text):
            # punctuation inside a token joins its words to a phrase, as in fmt.Sprintf
            out.append(Clause(tuple(ws), fuzzy, "", boost, sign))
    return out


def _minus(n: int):
    return lambda p: p - n


def _matches(terms: DataFrame, c: Clause) -> DataFrame:
    """(doc_id, tf) of the documents that a clause matches."""
    if c.wildcard:
        return terms.where(F.col("term").rlike(c.wildcard)).groupBy("doc_id").agg(F.sum("tf").alias("tf"))
    if c.fuzzy:
        near = (F.abs(F.length("term") - len(c.words[0])) <= c.fuzzy) & (F.levenshtein("term", F.lit(c.words[0])) <= c.fuzzy)
        return terms.where(near).groupBy("doc_id").agg(F.sum("tf").alias("tf"))
    if len(c.words) == 1:
        return terms.where(F.col("term") == c.words[0]).select("doc_id", "tf")
    # a phrase: starts of all its words, moved to the first, must meet
    starts = None
    for i, w in enumerate(c.words):
        here = terms.where(F.col("term") == w).select("doc_id", F.transform("positions", _minus(i)).alias(f"s{i}"))
        starts = here if starts is None else starts.join(here, "doc_id")
    met = F.col("s0")
    for i in range(1, len(c.words)):
        met = F.array_intersect(met, F.col(f"s{i}"))
    return starts.select("doc_id", F.size(met).cast("long").alias("tf")).where("tf > 0")


def rank(terms: DataFrame, lengths: DataFrame, groups: list[list[Term]]) -> DataFrame:
    """(doc_id, score): BM25 over OR groups of AND terms; a document's score is its best group's, rounded to 4 places.

    Numbers of documents are exact: each clause's matches are counted before they are weighed.
    """
    stats = lengths.agg(F.struct(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len")).alias("stats")).scalar()
    n_docs, avg_len = stats["n_docs"], stats["avg_len"]
    best = None
    for g in groups:
        items = clauses(g)
        wanted, banned = [c for c in items if c.sign != "-"], [c for c in items if c.sign == "-"]
        if not wanted:
            continue
        hits = None
        for c in wanted:
            m = _matches(terms, c)
            m = m.select("doc_id", "tf", F.lit(c.boost).alias("boost"), m.agg(F.count(F.lit(1)).alias("df")).scalar().alias("df"))
            hits = m if hits is None else hits.union(m)
        scored = hits.join(lengths, "doc_id")
        idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = F.col("boost") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avg_len))
        per = scored.groupBy("doc_id").agg(F.sum(weight).alias("score"), F.count(F.lit(1)).alias("met")).where(F.col("met") == len(wanted)).select("doc_id", "score")
        for c in banned:
            per = per.join(_matches(terms, c).select("doc_id"), "doc_id", "left_anti")
        best = per if best is None else best.union(per)
    if best is None:
        return terms.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    return best.groupBy("doc_id").agg(F.round(F.max("score"), 4).alias("score"))


def regex_rank(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, score): documents in which the pattern occurs, scored by how often."""
    n = F.regexp_count("content", F.lit(pattern))
    return docs.where("content IS NOT NULL").where(F.col("content").rlike(pattern)).select("doc_id", n.cast("double").alias("score")).distinct()


def snippet(content: Column | str, needles: list[str], regex: bool = False, width: int = 200) -> Column:
    """The first line that holds a needle (lower-case texts, or one regular expression), trimmed and cut to width; '' if none does."""
    if not needles:
        return F.lit("")
    if regex:
        lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(needles[0]))
    else:
        lines = F.filter(F.split(content, "\n"), lambda x: _any_of([F.contains(F.lower(x), F.lit(n)) for n in needles]))
    return F.coalesce(F.substring(F.regexp_replace(F.try_element_at(lines, F.lit(1)), r"^\s+|\s+$", ""), 1, width), F.lit(""))


def _any_of(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def scan_terms(docs: DataFrame, groups: list[list[Term]]) -> DataFrame:
    """The rows of term_table that the groups can ask for, read from the texts without an index: one scan, pruned by substring
    tests before any text is split, and only asked-for terms leave it."""
    asked = [c for g in groups for c in clauses(g)]
    plain = sorted({w for c in asked for w in c.words if not c.fuzzy})
    patterns = [c.wildcard for c in asked if c.wildcard]
    near = [(c.words[0], c.fuzzy) for c in asked if c.fuzzy]
    text = docs.where("content IS NOT NULL")
    if plain and not patterns and not near:
        text = text.where(_any_of([F.contains(F.lower("content"), F.lit(w)) for w in plain]))
    each = text.select("doc_id", F.posexplode(tokens("content")).alias("pos", "term"))
    keep = [F.col("term").isin(plain)] if plain else []
    keep += [F.col("term").rlike(p) for p in patterns] + [F.levenshtein("term", F.lit(w)) <= n for w, n in near]
    each = each.where(_any_of(keep)) if keep else each.limit(0)
    return _postings(each)
