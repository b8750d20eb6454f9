"""Made-up corpora whose word frequencies follow Zipf's law, for timings at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def zipf_corpus(spark: SparkSession, documents: int, words: int = 200, vocabulary: int = 50_000, seed: int = 1, spread: float = 0.0) -> DataFrame:
    """``doc_id, title, text``: documents of ``words`` words, or of up to ``spread`` of that more or
    less. The word of rank r occurs in proportion to 1 / r. Every row follows from its id and the
    seed alone, so any partitioning makes the same corpus."""
    number = lambda *of: F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 30)) / F.lit(float(1 << 30))
    size = F.greatest(F.lit(1), F.round(words * (1 + spread * (2 * number("id", F.lit("n")) - 1)))).cast("int")
    # the logarithm of a rank that falls as 1 / r is spread evenly
    rank = lambda i: F.floor(F.exp(number(F.col("id"), i) * F.log(F.lit(float(vocabulary + 1))))).cast("string")
    text = F.array_join(F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.lit("w"), rank(i))), " ")
    return spark.range(1, documents + 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("title"), text.alias("text"))
