"""Filling fixed-capacity containers (problem 7).

Harmonic packing: an item of size s belongs to the class floor(capacity / s), and a container of
class k takes exactly k items, which always fit. Workers number the items of a class in their own
buckets; only the counts of the buckets meet, to give each bucket its first number, so containers
are full across workers too. The one container of a class that may stay short of items is merged
with those of the other classes, first fit by falling size: at most one a class, however many items.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import cut
from .arrow import parts

CAPACITY = 4096
#: Items of a bucket, about: a bucket is numbered by one task.
BUCKET_ITEMS = 200_000
#: Texts longer than this are encoded in pieces.
PIECE = 1 << 18


def default_vocabulary() -> str:
    """The file of byte-level BPE ranks, where this machine keeps its public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count_tokens(enc, text: str) -> int:
    """Tokens of a text. A very long text is encoded in pieces cut before a white-space sign that
    follows none and precedes none, where the tokenizer's pattern always parts."""
    if len(text) <= PIECE:
        return len(enc.encode_ordinary(text))
    total = start = 0
    while len(text) - start > PIECE:
        at = start + PIECE
        while at < len(text) and not (text[at] == " " and text[at - 1].isalnum() and at + 1 < len(text) and text[at + 1].isalnum()):
            at += 1
        total += len(enc.encode_ordinary(text[start:at]))
        start = at
    return total + len(enc.encode_ordinary(text[start:]))


def token_sizes(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """``<key>, tokens`` of each row. Null counts as empty: 0 tokens. A null key stays null."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            for part in parts(batch, "text"):
                sizes = [_count_tokens(enc, x.as_py() or "") for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sizes, pa.int64())], names=[key, "tokens"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` long, tokens long")


def _first_fit(capacity: int):
    def run(rest: pd.DataFrame) -> pd.DataFrame:
        """Places whole short containers; ``rest`` has a row a container, at most one a class."""
        free: list[int] = []
        names: list[int] = []
        places = []
        rest = rest.sort_values(["used", "class"], ascending=[False, True])
        for kind, used in zip(rest["class"].tolist(), rest["used"].tolist()):
            for i, room in enumerate(free):
                if used <= room:
                    free[i] -= used
                    break
            else:
                i = len(free)
                free.append(capacity - used)
                names.append(kind)
            places.append((kind, names[i]))
        return pd.DataFrame(places, columns=["class", "into"]).astype("int64")

    return run


def overlong(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The sizes that exceed a container alone: the ones that are split."""
    return sizes.where(F.col("tokens") > capacity)


def pack(sizes: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """``<key>, part, offset, tokens, class, container`` for every item.

    An item larger than the capacity is split into full parts and one rest; any other item is
    whole (part 0). Items of no tokens count as of size 1 when a class is chosen. Rows with the
    same or a null key are items of their own. Containers are named by a string; an empty table
    gives no rows. Extra columns of ``sizes`` are not read.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = sizes.select(F.col(key).alias(key), F.col("tokens").cast("long").alias("tokens")).where(F.col("tokens").isNotNull())
    last = F.greatest(F.lit(0), F.ceil(F.col("tokens") / capacity) - 1)
    items = items.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    items = items.withColumn("offset", F.col("part") * capacity).withColumn("tokens", F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("offset")))
    items = items.withColumn("class", F.floor(F.lit(capacity) / F.greatest(F.col("tokens"), F.lit(1))))
    items = cut(items)
    buckets = max(1, -(-items.count() // BUCKET_ITEMS))
    items = items.withColumn("bucket", F.pmod(F.xxhash64(key, "part"), F.lit(buckets)))
    counts = items.groupBy("class", "bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("class", "bucket", before.alias("first"))
    number = F.row_number().over(Window.partitionBy("class", "bucket").orderBy(key, "part", "tokens")) - 1
    numbered = items.withColumn("number", number).join(firsts, ["class", "bucket"]).withColumn("bin", F.floor((F.col("number") + F.col("first")) / F.col("class")))
    bins = numbered.groupBy("class", "bin").agg(F.count("*").alias("held"), F.sum("tokens").alias("used"))
    short = bins.where(F.col("held") < F.col("class")).select("class", "bin", "used")
    # at most one short container a class, and at most 2 sqrt(capacity) classes
    moved = short.select("class", "used").groupBy(F.lit(0).alias("one")).applyInPandas(_first_fit(capacity), "class long, into long")
    moved = short.select("class", "bin").join(moved, "class")
    placed = numbered.join(F.broadcast(moved), ["class", "bin"], "left")
    name = F.when(F.col("into").isNull(), F.concat_ws("-", "class", "bin")).otherwise(F.concat(F.lit("rest-"), F.col("into")))
    return placed.select(key, "part", "offset", "tokens", "class", name.alias("container"))


def fill(sizes: DataFrame, packed: DataFrame, key: str, capacity: int = CAPACITY, least: float = 0.85) -> DataFrame:
    """One row: ``documents`` (rows of ``sizes``), ``overfull`` containers, ``split_needlessly`` (keys
    with a second part that would fit alone), ``unequal`` (keys whose parts are not all they hold, or
    that are in no container), and whether the containers are ``well_filled``: all but the unavoidable
    last one together at ``least`` of what they hold. An empty table is well filled."""
    bins = packed.groupBy("container").agg(F.sum("tokens").alias("used"))
    whole = bins.agg(F.coalesce(F.sum((F.col("used") > capacity).cast("long")), F.lit(0)).alias("overfull"), F.coalesce(F.sum("used"), F.lit(0)).alias("used"), F.count("*").alias("containers"))
    given = sizes.groupBy(key).agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"), F.count("*").alias("rows"))
    placed = packed.groupBy(key).agg(F.sum("tokens").alias("placed"), F.max("part").alias("last"))
    keys = given.join(placed, given[key].eqNullSafe(placed[key]), "left").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("documents"),
        F.coalesce(F.sum(((F.col("last") > 0) & (F.col("longest") <= capacity)).cast("long")), F.lit(0)).alias("split_needlessly"),
        F.coalesce(F.sum((~F.col("placed").eqNullSafe(F.col("tokens"))).cast("long")), F.lit(0)).alias("unequal"),
    )
    filled = F.col("used") >= least * capacity * F.greatest(F.col("containers") - 1, F.lit(0))
    return keys.crossJoin(F.broadcast(whole)).select("documents", "overfull", "split_needlessly", "unequal", filled.alias("well_filled"))
