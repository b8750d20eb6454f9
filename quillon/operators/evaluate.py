"""Quality of retrieval: precision, recall, average precision, reciprocal rank, gain, tests.

Runs are ``query, rank, doc_id``; judgements ``query, doc_id, grade``, relevant above grade 0.
Every judged query has a row, those without results with 0.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean_judgements(qrels: DataFrame) -> DataFrame:
    """One grade for each query, trimmed and in lower case, and document: the greatest. Null and
    negative grades are no judgements."""
    query = F.lower(F.trim("query"))
    return qrels.where("grade >= 0 AND query IS NOT NULL AND doc_id IS NOT NULL").groupBy(query.alias("query"), "doc_id").agg(F.max("grade").alias("grade"))


def _hits(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return run.select("query", "rank", "doc_id").join(qrels, ["query", "doc_id"], "left").withColumn("hit", F.coalesce((F.col("grade") > 0).cast("int"), F.lit(0)))


def _relevant(qrels: DataFrame) -> DataFrame:
    return qrels.groupBy("query").agg(F.sum((F.col("grade") > 0).cast("long")).alias("relevant"))


def precision_recall_at_k(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """``query, precision, recall``. Precision is over the documents returned, at most k."""
    top = _hits(run, qrels).where(F.col("rank") <= k).groupBy("query").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    rows = _relevant(qrels).join(top, "query", "left").na.fill(0, ["hits", "n"])
    share = lambda of: F.when(F.col(of) > 0, F.col("hits") / F.col(of)).otherwise(0.0)
    return rows.select("query", share("n").alias("precision"), share("relevant").alias("recall"))


def average_precision(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``query, value``: precision at the rank of each relevant document, over all relevant ones."""
    so_far = F.sum("hit").over(Window.partitionBy("query").orderBy("rank"))
    parts = _hits(run, qrels).withColumn("so_far", so_far).where("hit = 1").groupBy("query").agg(F.sum(F.col("so_far") / F.col("rank")).alias("s"))
    rows = _relevant(qrels).join(parts, "query", "left")
    return rows.select("query", F.when(F.col("relevant") > 0, F.coalesce("s", F.lit(0.0)) / F.col("relevant")).otherwise(0.0).alias("value"))


def reciprocal_rank(run: DataFrame, qrels: DataFrame) -> DataFrame:
    first = _hits(run, qrels).where("hit = 1").groupBy("query").agg(F.min("rank").alias("first"))
    return qrels.select("query").distinct().join(first, "query", "left").select("query", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("value"))


def dcg(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """``query, value``: grades over the logarithm of their rank, linear in the grade."""
    top = _hits(run, qrels).where(F.col("rank") <= k).groupBy("query").agg(F.sum(F.coalesce("grade", F.lit(0)) / F.log2(F.col("rank") + 1)).alias("value"))
    return qrels.select("query").distinct().join(top, "query", "left").na.fill(0.0, ["value"])


def ndcg(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """``query, value``: gain over that of the best order of all judged documents."""
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.col("grade").desc(), "doc_id"))
    best = qrels.withColumn("rank", order).where(F.col("rank") <= k).groupBy("query").agg(F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("best"))
    return dcg(run, qrels, k).join(best, "query").select("query", F.when(F.col("best") > 0, F.col("value") / F.col("best")).otherwise(0.0).alias("value"))


def summary(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """``queries, map, mrr, ndcg, precision``: means over the judged queries, 0 if there are none."""
    ap = average_precision(run, qrels).withColumnRenamed("value", "ap")
    rows = ap.join(reciprocal_rank(run, qrels).withColumnRenamed("value", "rr"), "query").join(ndcg(run, qrels, k).withColumnRenamed("value", "g"), "query")
    rows = rows.join(precision_recall_at_k(run, qrels, k), "query")
    mean = lambda c, name: F.coalesce(F.avg(c), F.lit(0.0)).alias(name)
    return rows.agg(F.count("*").alias("queries"), mean("ap", "map"), mean("rr", "mrr"), mean("g", "ndcg"), mean("precision", "precision"))


def sign_test(first: list[float], second: list[float]) -> float:
    """Two-sided probability of so uneven a split of wins; ties are dropped, 1 if nothing is left."""
    wins = sum(a > b for a, b in zip(first, second, strict=True))
    n = sum(a != b for a, b in zip(first, second, strict=True))
    if not n:
        return 1.0
    low = min(wins, n - wins)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(low + 1)) / 2**n)


def paired_sign_test(first: DataFrame, second: DataFrame) -> DataFrame:
    """``wins, losses, ties, probability`` of the first of two runs, by their ``query, value``. Only
    the counts leave the executors."""
    pairs = first.select("query", F.col("value").alias("a")).join(second.select("query", F.col("value").alias("b")), "query")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    a, b = F.round("a", 9), F.round("b", 9)
    row = pairs.agg(n(a > b).alias("wins"), n(a < b).alias("losses"), n(a == b).alias("ties")).first()
    chance = sign_test([1.0] * row["wins"] + [0.0] * row["losses"], [0.0] * row["wins"] + [1.0] * row["losses"])
    return first.sparkSession.createDataFrame([(*row, chance)], "wins long, losses long, ties long, probability double")


def permutation_test(first: list[float], second: list[float], trials: int = 100_000, seed: int = 1) -> float:
    """Share of random swaps with a mean difference as great, the observed one included."""
    gaps = [a - b for a, b in zip(first, second, strict=True)]
    seen, rng = abs(sum(gaps)), random.Random(seed)
    extreme = sum(abs(sum(g if rng.random() < 0.5 else -g for g in gaps)) >= seen - 1e-12 for _ in range(trials))
    return (extreme + 1) / (trials + 1)


def heaps_law(points: DataFrame) -> DataFrame:
    """``exponent, factor`` of vocabulary = factor * tokens ^ exponent, over ``tokens, vocabulary``."""
    x, y = F.log("tokens"), F.log("vocabulary")
    return points.agg(F.regr_slope(y, x).alias("exponent"), F.exp(F.regr_intercept(y, x)).alias("factor"))
