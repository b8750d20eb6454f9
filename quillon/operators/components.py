"""Connected components of a graph given by its edges."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``v, root`` for every vertex of ``v, u`` that is not the smallest of its component: the
    smallest vertex it is connected with.

    Alternating large-star and small-star steps, each kept in the shared folder, until nothing
    changes; stars halve the distances, so the rounds grow as their logarithm. More than ``rounds``
    of them, if given, raise. Loops and repeated edges change nothing, rows with a null are left out.
    """
    down = lambda df: df.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u"))
    edges = cut(down(edges.where("v IS NOT NULL AND u IS NOT NULL AND v <> u")).distinct())
    for n in count(1):
        before = edges
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        lowest = both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("m", "v"))
        large = down(both.join(lowest, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v != u").distinct())
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v != u").union(least.select("v", F.col("m").alias("u")))
        edges = cut(small.distinct())
        if edges.count() == before.count() and not edges.exceptAll(before).take(1):
            break
        if n == rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
    return edges.groupBy("v").agg(F.min("u").alias("root"))
