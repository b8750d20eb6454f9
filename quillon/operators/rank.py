"""Scoring and exact top-k, many queries in one plan.

Order everywhere: score descending, then document id ascending; only scores above 0 count. Scores
are compared rounded to 9 decimals, so that equal documents tie on every engine.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import K1, B, SearchIndex, saturate
from .match import bounded, meeting

# Parameters of the formulas.
PROXIMITY = 0.3
FIELD_WEIGHTS = {"": 1.0, "title": 3.0}


def tfidf_idf(n: int, df: Column) -> Column:
    return F.log(F.lit(float(n)) / df)


def bm25_idf(n: int, df: Column) -> Column:
    return F.log(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5))


def _terms(q: DataFrame, key: str) -> DataFrame:
    return q.groupBy(key, "term").agg(F.count("*").alias("times"))


def permitted(rows: DataFrame, permit: DataFrame | Column | None) -> DataFrame:
    """Rows of permitted documents: a table with their ``doc_id``, or a condition. Applied before
    scores are made, so nothing that is not permitted can displace anything."""
    if permit is None:
        return rows
    if isinstance(permit, Column):
        return rows.where(permit)
    return rows.join(permit.select("doc_id").distinct(), "doc_id", "left_semi")


def score_tfidf(index: SearchIndex, q: DataFrame, key: str = "query", permit=None) -> DataFrame:
    """``<key>, doc_id, score``: cosine of the query's and the document's tf-idf vectors. Repeated
    query terms weigh more."""
    idf = index.term_stats.where("field = ''").select("term", tfidf_idf(index.document_count, F.col("df")).alias("idf"))
    weights = _terms(q, key).join(idf, "term").withColumn("w", F.col("times") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    weights = weights.withColumn("length", length).select(key, "term", "idf", F.when(F.col("length") > 0, F.col("w") / F.col("length")).otherwise(0.0).alias("qw"))
    met = permitted(meeting(index, weights, "doc_id", "tf"), permit)
    dots = met.groupBy(key, "doc_id").agg(F.sum(F.col("qw") * F.col("tf") * F.col("idf")).alias("dot"))
    scored = dots.join(index.doc_stats.select("doc_id", "norm"), "doc_id")
    return scored.select(key, "doc_id", F.when(F.col("norm") > 0, F.col("dot") / F.col("norm")).otherwise(0.0).alias("score")).where("score > 0")


def score_bm25(index: SearchIndex, q: DataFrame, key: str = "query", permit=None, k1: float = K1, b: float = B) -> DataFrame:
    """``<key>, doc_id, score``; repeated query terms count once."""
    idf = index.term_stats.where("field = ''").select("term", bm25_idf(index.document_count, F.col("df")).alias("idf"))
    met = permitted(meeting(index, _terms(q, key).join(idf, "term").select(key, "term", "idf"), "doc_id", "tf", "length"), permit)
    return met.groupBy(key, "doc_id").agg(F.sum(F.col("idf") * saturate(F.col("tf"), F.col("length"), index.average_length, k1, b)).alias("score")).where("score > 0")


def score_bm25f(index: SearchIndex, q: DataFrame, key: str = "query", weights: dict[str, float] | None = None, permit=None) -> DataFrame:
    """``<key>, doc_id, score``: fields are combined before saturation. The document weight is that
    of the document field; a field of weight 0 or without the term adds nothing."""
    weights = FIELD_WEIGHTS if weights is None else weights
    idf = index.term_stats.where("field = ''").select("term", bm25_idf(index.document_count, F.col("df")).alias("idf"))
    met = permitted(meeting(index, _terms(q, key).join(idf, "term").select(key, "term", "idf"), "field", "doc_id", "tf", "length", fields=True), permit)
    average = F.when(F.col("field") == "title", F.lit(index.average_title or 1.0)).otherwise(F.lit(index.average_length or 1.0))
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("field") == name, F.lit(float(w))).otherwise(weight)
    part = weight * F.col("tf") / (1 - B + B * F.col("length") / average)
    combined = met.groupBy(key, "doc_id", "term", "idf").agg(F.sum(part).alias("c"))
    return combined.groupBy(key, "doc_id").agg(F.sum(F.col("idf") * F.col("c") * (K1 + 1) / (K1 + F.col("c"))).alias("score")).where("score > 0")


def minimum_span(index: SearchIndex, q: DataFrame, key: str = "query") -> DataFrame:
    """``<key>, doc_id, span``: width of the smallest window with every distinct term of the query,
    for documents that hold them all."""
    kinds = bounded(q.groupBy(key).agg(F.countDistinct("term").alias("n")))
    met = meeting(index, q.select(key, "term").distinct(), "doc_id", "positions")
    whole = met.groupBy(key, "doc_id").agg(F.count("*").alias("n")).join(kinds, [key, "n"]).select(key, "doc_id", "n")
    lists = met.join(whole, [key, "doc_id"]).groupBy(key, "doc_id", "n").agg(F.collect_list("positions").alias("lists"))

    @F.pandas_udf("int")
    def span(values: pd.Series) -> pd.Series:
        return values.map(narrowest)

    return lists.select(key, "doc_id", span("lists").alias("span"))


def narrowest(lists) -> int | None:
    """Width of the smallest window with a place of every list; None if a list is empty."""
    if not len(lists) or any(not len(x) for x in lists):
        return None
    places = sorted((int(p), i) for i, x in enumerate(lists) for p in x)
    inside, left, best = [0] * len(lists), 0, None
    missing = len(lists)
    for place, i in places:
        missing -= inside[i] == 0
        inside[i] += 1
        while not missing:
            width = place - places[left][0] + 1
            best = width if best is None else min(best, width)
            out = places[left][1]
            inside[out] -= 1
            missing += inside[out] == 0
            left += 1
    return best


def proximity_boost(span: Column, n: Column) -> Column:
    return F.when(span.isNull() | (n < 2), F.lit(1.0)).otherwise(1.0 + PROXIMITY * n / span)


def with_proximity(index: SearchIndex, scored: DataFrame, q: DataFrame, key: str = "query") -> DataFrame:
    """Scores raised where all terms of the query stand close together."""
    kinds = bounded(q.groupBy(key).agg(F.countDistinct("term").alias("n")))
    spans = minimum_span(index, q, key)
    rows = scored.join(kinds, key).join(spans, [key, "doc_id"], "left")
    return rows.select(key, "doc_id", (F.col("score") * proximity_boost(F.col("span"), F.col("n"))).alias("score"))


def top_k(scored: DataFrame, k: int = 10, key: str = "query") -> DataFrame:
    """``<key>, rank, doc_id, score`` of the k best of each query; none if k is not positive."""
    if k <= 0:
        return scored.where(F.lit(False)).select(key, F.lit(0).alias("rank"), "doc_id", "score")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.round("score", 9).desc(), F.col("doc_id")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", "doc_id", "score")


def document_vector(index: SearchIndex) -> DataFrame:
    """``doc_id, term, weight``: the unit tf-idf vector of every document; terms of weight 0 too."""
    idf = index.term_stats.where("field = ''").select("term", tfidf_idf(index.document_count, F.col("df")).alias("idf"))
    rows = index.postings.where("field = ''").select("term", "doc_id", "tf").join(idf, "term").join(index.doc_stats.select("doc_id", "norm"), "doc_id")
    return rows.select("doc_id", "term", F.when(F.col("norm") > 0, F.col("tf") * F.col("idf") / F.col("norm")).otherwise(0.0).alias("weight"))


def cosine(vectors: DataFrame, pairs: DataFrame, a: str = "doc_id_a", b: str = "doc_id_b") -> DataFrame:
    """``<a>, <b>, cosine`` of given pairs of documents; 0 where they share no term."""
    left = pairs.select(a, b).distinct()
    x = left.join(vectors.select(F.col("doc_id").alias(a), "term", F.col("weight").alias("x")), a)
    y = vectors.select(F.col("doc_id").alias(b), "term", F.col("weight").alias("y"))
    dots = x.join(y, [b, "term"]).groupBy(a, b).agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))
    return left.join(dots, [a, b], "left").na.fill(0.0, ["cosine"])


@dataclass(frozen=True)
class Ranker:
    """A way to score, by name, with its options."""

    name: str = "tfidf"
    proximity: bool = False
    options: dict = field(default_factory=dict)

    def scores(self, index: SearchIndex, q: DataFrame, key: str = "query", permit=None) -> DataFrame:
        ways = {"tfidf": score_tfidf, "bm25": score_bm25, "bm25f": score_bm25f}
        if self.proximity and self.name == "bm25f":
            raise ValueError("proximity is not available with fields")
        found = ways[self.name](index, q, key, permit=permit, **self.options)
        return with_proximity(index, found, q, key) if self.proximity else found

    def candidates(self, index: SearchIndex, q: DataFrame, candidates: DataFrame, key: str = "query", permit=None) -> DataFrame:
        """Scores of the documents that match."""
        return self.scores(index, q, key, permit).join(candidates, [key, "doc_id"], "left_semi")

    def best(self, scored: DataFrame, k: int = 10, key: str = "query") -> DataFrame:
        return top_k(scored, k, key)

    def rank(self, index: SearchIndex, q: DataFrame, candidates: DataFrame | None = None, k: int = 10, key: str = "query", permit=None) -> DataFrame:
        found = self.scores(index, q, key, permit) if candidates is None else self.candidates(index, q, candidates, key, permit)
        return top_k(found, k, key)
