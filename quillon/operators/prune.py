"""Exact top-k by BM25 with early termination by bounds.

1. The index's ``tops`` know the greatest impacts of a term in different documents, so k of them
   reach the k-th: the greatest such score of a query's terms is a threshold its best k documents
   reach.
2. Terms whose bounds together stay under the threshold are not essential: a document that holds none
   of the others cannot be among the best. These are the frequent terms, with most of the postings.
3. Documents of essential terms are scored by them. Those that the bounds of the other terms cannot
   lift to the threshold go; only the rest, if few enough broadcast, meet the other postings.
A document among the best k scores at least the threshold, so it is never dropped: the result is
that of the full scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import cut
from .index import K1, TOPS, B, SearchIndex, saturate, tops
from .match import bounded, meeting, sized
from .rank import bm25_idf, permitted, top_k

#: Room for rounding: bounds and scores are sums in different order.
SLACK = 1 - 1e-9


def upper_bounds(index: SearchIndex) -> DataFrame:
    """``term, bound``: no document scores more for the term."""
    bound = bm25_idf(index.document_count, F.col("df")) * saturate(F.col("max_tf"), F.lit(index.shortest), index.average_length, K1, B)
    return index.term_stats.where("field = ''").select("term", bound.alias("bound"))


def _tops(index: SearchIndex, terms: DataFrame, k: int, permit) -> DataFrame:
    """``term, best, kth``: the greatest and the k-th greatest known impact of a term; k-th is null
    where there are fewer."""
    known = index.tops
    if permit is not None or k > TOPS:
        post = permitted(meeting(index, terms.select("term").distinct(), "doc_id", "tf", "length"), permit)
        known = tops(post, index.average_length, most=k)
    return known.select("term", F.col("impacts")[0].alias("best"), F.get("impacts", F.lit(k - 1)).alias("kth"))


def rank_pruned(index: SearchIndex, q: DataFrame, k: int = 10, key: str = "query", permit=None) -> tuple[DataFrame, DataFrame]:
    """The k best by BM25, and ``<key>, scored``: how many documents were scored by all terms."""
    if k <= 0:
        raise ValueError("k must be positive")
    stats = index.term_stats.where("field = ''").select("term", bm25_idf(index.document_count, F.col("df")).alias("idf"))
    asked = q.select(key, "term").distinct().join(stats, "term").select(key, "term", "idf")
    of_query = Window.partitionBy(key)
    rising = of_query.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = asked.join(_tops(index, asked, k, permit), "term").withColumn("bound", F.col("idf") * F.col("best"))
    known = known.withColumn("threshold", F.coalesce(F.max(F.col("idf") * F.col("kth")).over(of_query), F.lit(0.0)) * SLACK)
    known = known.withColumn("essential", F.sum("bound").over(rising) >= F.col("threshold"))
    known = known.withColumn("rest", F.sum(F.when(F.col("essential"), 0.0).otherwise(F.col("bound"))).over(of_query))
    terms = bounded(known.select(key, "term", "idf", "threshold", "essential", "rest"))
    part = F.col("idf") * saturate(F.col("tf"), F.col("length"), index.average_length, K1, B)

    def met(essential: bool) -> DataFrame:
        return permitted(meeting(index, terms.where(F.col("essential") == essential), "doc_id", "tf", "length"), permit)

    # all terms of a query agree on threshold and rest
    partly = met(True).groupBy(key, "doc_id").agg(F.sum(part).alias("score"), F.first("threshold").alias("threshold"), F.first("rest").alias("rest"))
    candidates = cut(partly.where(F.col("score") + F.col("rest") >= F.col("threshold")).select(key, "doc_id", "score"))
    others = met(False).join(sized(candidates.select(key, "doc_id")), [key, "doc_id"]).select(key, "doc_id", part.alias("score"))
    exact = candidates.union(others).groupBy(key, "doc_id").agg(F.sum("score").alias("score")).where("score > 0")
    return top_k(exact, k, key), exact.groupBy(key).agg(F.count("*").alias("scored"))
