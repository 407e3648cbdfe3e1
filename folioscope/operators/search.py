"""Lexical and vector search, rank fusion, and cuts per group.

Scores are over the whole corpus and ranks inside the allowed rows.  All queries of a
batch are scored in one pass; only the query terms' postings are ever shuffled.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import lower

K1, B, RRF = 1.5, 0.75, 60
#: The usual short list of English stop words of search engines.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()


def tokens(text: Column) -> Column:
    """Lower-cased words of two characters and more, without stop words."""
    return F.filter(F.regexp_extract_all(lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))


def query_terms(query: str) -> list[str]:
    """The words of a query, taken like those of a text; none are left of stop words alone."""
    return [w for w in re.findall("[a-z0-9]{2,}", query.lower()) if w not in STOP_WORDS]


def postings(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, dl, tfs): document length and the count of each query term, made where the text is read."""
    own = F.col("tokens")
    counts = [F.size(F.filter(own, _is(term))) for term in terms]
    return docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("tokens")).select("doc_id", F.size("tokens").alias("dl"), F.array(*counts).alias("tfs"))


def _is(term: str):
    return lambda w: w == term


def bm25(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, score) of every document; zero where no term occurs."""
    rows = postings(docs, terms, id_col, text_col)
    n_terms = range(len(terms))
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col("tfs")[i] > 0).alias(f"df{i}") for i in n_terms))
    # one row of corpus statistics; the texts are read once for it and once for the scores
    known = stats.first()
    total = F.lit(0.0)
    for i in n_terms:
        idf = math.log(1 + (known["n"] - known[f"df{i}"] + 0.5) / (known[f"df{i}"] + 0.5))
        tf = F.col("tfs")[i]
        total = total + idf * tf / (tf + k1 * (1 - b + b * F.col("dl") / max(1e-9, known["avgdl"] or 0.0)))
    return rows.select("doc_id", F.round(total, 6).alias("score"))


def cosine(vectors: DataFrame, query: list[float], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score): cosine with a query vector."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.transform(vector_col, lambda x: x.cast("double"))
    dot = lambda a, c: F.aggregate(F.zip_with(a, c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = sum(float(x) ** 2 for x in query) ** 0.5 or 1.0
    return vectors.select(F.col(id_col).alias("id"), F.round(dot(v, q) / (F.sqrt(dot(v, v)) * norm), 6).alias("score"))


def ranked(scored: DataFrame, score: str = "score", id_col: str = "doc_id", by: list[str] | None = None, k: int | None = None, to: str = "rank") -> DataFrame:
    """Ranks from 1, ties by id, inside ``by`` or, for the best ``k`` of all rows, after a distributed top-k."""
    order = [F.desc(score), F.asc(id_col)]
    if not by:
        if k is None:
            raise ValueError("a global ranking needs k: one task can't rank every row")
        scored = scored.orderBy(*order).limit(k)
    out = scored.withColumn(to, F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)).cast("long"))
    return out if k is None else out.where(F.col(to) <= k)


def fuse(rankings: list[DataFrame], id_col: str = "doc_id", by: list[str] | None = None, constant: int = RRF) -> DataFrame:
    """Reciprocal-rank fusion: (by, id, rrf) summed over the rankings (columns by, id, rank)."""
    keys = [*(by or []), id_col]
    every = rankings[0].select(*keys, "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select(*keys, "rank"))
    return every.groupBy(*keys).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 12).alias("rrf"))


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, to: str = "rank") -> DataFrame:
    return rows.withColumn(to, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(to) <= k)


def effective_mode(requested: str | None, configured: str, has_vectors: bool) -> tuple[str, str | None]:
    """The search mode to use and a note where a configured mode had to give way; an explicit one never does."""
    if requested:
        if requested not in ("bm25", "dense", "hybrid"):
            raise ValueError(f"unknown search mode {requested!r}")
        return requested, None
    if configured in ("dense", "hybrid") and not has_vectors:
        return "bm25", f"no vectors in the index: {configured} gives way to bm25"
    return configured, None
