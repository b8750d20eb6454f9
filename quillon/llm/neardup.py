"""Near-duplicate records with small edits (problem 6).

Tensored banding. A record is the set of its term shingles. Two small collections of ``half`` keys,
each of ``width`` minhashes, stand for it; a table is a pair of a left and a right key, so
``half ** 2`` tables need only ``2 * half * width`` minhashes. Two records of similarity s miss each
other with a probability of at most ``2 * (1 - s ** width) ** half``.

Only left keys travel, each with all right keys behind it; the pairs of keys are formed where the
records of one left key have met. Records of equal sets are one class and go as one record.
Candidates are verified on the whole sets. Lost in no case but the stated probability: no bucket is
cut and no partner dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import words
from ..operators.components import components
from ..operators.match import sized
from ..plans.tables import cut
from .arrow import parts, strings
from .hashing import TermHasher, mix, shingle_hashes
from .oneform import one_form

#: Candidate records up to this number are broadcast as ids (8 bytes each); more are joined.
BROADCAST_IDS = 1_000_000
#: A left key of more records goes by the pair of keys at once.
HOT_LEFT = 50_000


@dataclass(frozen=True)
class Likeness:
    """What near-duplicate means, and how it is searched."""

    shingle: int = 5
    threshold: float = 0.8
    least_terms: int = 0
    width: int = 3
    half: int = 16


def _functions(likeness: Likeness) -> tuple[np.ndarray, np.ndarray]:
    n = 2 * likeness.half * likeness.width
    numbers = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (numbers[:n] | np.uint64(1))[:, None], numbers[n:][:, None]


def minhashes(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray], chunk: int = 4096) -> np.ndarray:
    factor, plus = functions
    lowest = np.full(len(factor), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), chunk):
        np.minimum(lowest, (factor * shingles[None, i : i + chunk] + plus).min(axis=1), out=lowest)
    return lowest


def _terms(values: tuple) -> list[str]:
    return words(one_form(" ".join(values)))


def _name(shingles: np.ndarray) -> bytes:
    """192 bits that tell sets of shingles apart."""
    return np.array([shingles.sum(), np.bitwise_xor.reduce(mix(shingles)), len(shingles)], dtype=np.uint64).tobytes()


def _signatures(columns: list[str], likeness: Likeness):
    functions = _functions(likeness)
    half, width = likeness.half, likeness.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TermHasher()
        for batch in batches:
            for part in parts(batch, *columns):
                ids, sizes, keys, lefts, rights = [], [], [], [], []
                for doc, *values in zip(part.column("id").to_pylist(), *(strings(part, c) for c in columns)):
                    own = _terms(tuple(values))
                    if len(own) < max(likeness.least_terms, likeness.shingle):
                        ids.append(doc)
                        sizes.append(0)
                        keys.append(xxhash.xxh3_128_digest(" ".join(own)) if own else None)
                        lefts.append(None)
                        rights.append(None)
                        continue
                    shingles = np.unique(shingle_hashes(hasher(own), likeness.shingle))
                    low = minhashes(shingles, functions).reshape(2 * half, width)
                    key = low[:, 0].copy()
                    for i in range(1, width):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low[:, i])
                    numbers = np.arange(2 * half, dtype=np.uint64)
                    key = mix(key + numbers)
                    ids.append(doc)
                    sizes.append(len(shingles))
                    keys.append(_name(shingles))
                    lefts.append(key[:half].view(np.int64))
                    rights.append((key[half:] >> np.uint64(48)).astype(np.uint16).view(np.int16))
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": pa.array(ids, pa.int64()),
                        "size": pa.array(sizes, pa.int32()),
                        "same": pa.array(keys, pa.binary()),
                        "lefts": pa.array(lefts, pa.list_(pa.int64())),
                        "rights": pa.array(rights, pa.list_(pa.int16())),
                    }
                )

    return run


def _sets(columns: list[str], likeness: Likeness):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TermHasher()
        for batch in batches:
            for part in parts(batch, *columns):
                sets = [np.unique(shingle_hashes(hasher(_terms(v)), likeness.shingle)) for v in zip(*(strings(part, c) for c in columns))]
                names = [_name(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["class", "same", "shingles"])

    return run


@dataclass(frozen=True)
class Near:
    """``members``: id, class (the smallest id of equal sets). ``links``: a, b, similarity between
    classes, a < b. ``short``: id, class (the smallest id of equal runs of terms) of the records
    with too few terms to be compared; those without any are classes of their own."""

    members: DataFrame
    links: DataFrame
    short: DataFrame


def near_duplicates(df: DataFrame, key: str, columns: list[str], likeness: Likeness = Likeness()) -> Near:
    """Classes of equal records and the links between classes that are similar enough.

    Terms are those of the columns joined by a space, in one form and lower case. Null counts as
    empty; records with fewer terms than a shingle (or ``least_terms``) are ``short``; rows with
    a null key are left out. A repeated row counts once, and of a key that occurs with several
    contents one counts, always the same. An empty table gives empty results. No other columns are
    read.
    """
    src = df.select(F.col(key).cast("long").alias("id"), *[F.col(c) for c in columns]).where(F.col("id").isNotNull())
    read = cut(src.mapInArrow(_signatures(columns, likeness), "id long, size int, same binary, lefts array<long>, rights array<short>"))
    signed = read.where("size > 0")
    one = signed.groupBy("id").agg(F.min("same").alias("same"))
    named = one.groupBy("same").agg(F.min("id").alias("class"))
    classes = cut(signed.groupBy("same").agg(F.first("size").alias("size"), F.first("lefts").alias("lefts"), F.first("rights").alias("rights")).join(named, "same"))
    members = one.join(classes.select("same", "class"), "same").select("id", "class")
    pairs = _candidates(classes.drop("same"), likeness)
    few = read.where("size = 0").join(one, "id", "left_anti").groupBy("id").agg(F.min("same").alias("same"))
    copies = few.where("same IS NOT NULL").groupBy("same").agg(F.min("id").alias("class"))
    short = few.join(copies, "same", "left").select("id", F.coalesce("class", "id").alias("class"))
    return Near(members, _verified(src, columns, classes.select("class", "same"), pairs, likeness), short)


def _candidates(classes: DataFrame, likeness: Likeness, hot: int = HOT_LEFT) -> DataFrame:
    """``a, b``, a < b: the classes that share a pair of keys and whose sizes allow the similarity.

    Records meet by their left key, and only pairs of keys that two of them share travel on. A left
    key of more than ``hot`` records, as boilerplate makes them, does not meet in one task: its
    records go by the pair of keys at once. Which way a key takes changes nothing in the result.
    """
    met = classes.select(F.explode("lefts").alias("left"), "class", "size", "rights")
    heavy = sized(cut(met.groupBy("left").count().where(F.col("count") > hot).select("left")), BROADCAST_IDS)
    pair = ["left", "j", "right"]
    alone = lambda rows: rows.select("left", "class", "size", F.posexplode("rights").alias("j", "right"))
    several = lambda rows, *by: rows.withColumn("n", F.count("*").over(Window.partitionBy(*by))).where("n > 1")
    # the partitioning by the left key also holds for the pair of keys
    keys = several(alone(several(met.join(heavy, "left", "left_anti"), "left").drop("n")), *pair).drop("n")
    keys = keys.select(*pair, "class", "size").unionByName(alone(met.join(heavy, "left", "left_semi")).select(*pair, "class", "size"))
    # both sides alike but for their names, so that one exchange serves both
    both = keys.toDF(*pair, "a", "size_a").join(keys.toDF(*pair, "b", "size_b"), pair).where("a < b")
    # similarity is at most the ratio of the sizes
    near = both.where(F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(likeness.threshold - 1e-9))
    return near.select("a", "b").distinct()


def _verified(src: DataFrame, columns: list[str], classes: DataFrame, pairs: DataFrame, likeness: Likeness) -> DataFrame:
    pairs = cut(pairs)
    ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    texts = src.join(sized(ids, BROADCAST_IDS), "id", "left_semi")
    sets = texts.mapInArrow(_sets(columns, likeness), "class long, same binary, shingles array<long>")
    # of a key's contents the one its class has, once
    sets = cut(sets.join(classes, ["class", "same"], "left_semi").dropDuplicates(["class", "same"]).drop("same"))
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("x", "y"))
    measured = joined.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("total"))
    similarity = F.col("shared") / (F.col("total") - F.col("shared"))
    return measured.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= likeness.threshold - 1e-12)


def near_pairs(near: Near, key: str) -> DataFrame:
    """``<key>_a, <key>_b``, a < b: every pair of records of one class or of linked classes."""
    links = cut(near.links.select("a", "b"))
    members = cut(near.members)
    a = members.select(F.col("class").alias("a"), F.col("id").alias("x"))
    b = members.select(F.col("class").alias("b"), F.col("id").alias("y"))
    several = members.groupBy("class").count().where("count > 1").select(F.col("class").alias("a"), F.col("class").alias("b"))
    found = links.union(several).join(a, "a").join(b, "b").where(F.col("x") != F.col("y"))
    found = found.where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return found.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def groups(near: Near, key: str, rounds: int | None = None) -> DataFrame:
    """``<key>, group, links``: each record's group (smallest id of its connected classes) and the
    number of links of its class. Every record has a row; short ones have no links. More than
    ``rounds`` rounds of joining, if given, raise."""
    links = cut(near.links.select("a", "b"))
    roots = components(links.select(F.col("b").alias("v"), F.col("a").alias("u")), rounds)
    ends = links.select(F.col("a").alias("class")).union(links.select("b")).groupBy("class").count()
    rows = near.members.union(near.short).join(roots.withColumnRenamed("v", "class"), "class", "left").join(ends, "class", "left")
    return rows.select(F.col("id").alias(key), F.coalesce("root", "class").alias("group"), F.coalesce("count", F.lit(0)).cast("long").alias("links"))
