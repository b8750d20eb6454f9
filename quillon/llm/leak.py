"""Evaluation texts leaking into a corpus (problem 8).

A prefix-filtered set join. An item is a set of windows of ``words`` terms, a window a set of
overlapping shingles of three terms. A document holds a window only if it holds all its shingles in
a row, so its texts are read once: runs of shingles that occur in any window, long enough for one,
are all that can match (a bitmap of bounded size tells, and may only let through too much). The same
pass counts the windows' shingles over the whole corpus. The rarest shingle of each window is its
prefix; where a run has a prefix, its place fixes where the window would start (positional bound) and
whether it fits into the run (length bound), and what is left is verified term by term over the
whole window. Every step is the same for any number of windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import words
from ..plans.tables import cut, keep
from .arrow import parts, strings
from .hashing import TermHasher, shingle_hashes
from .oneform import one_form

WORDS = 12
SHINGLE = 3
#: The bitmap of shingles has 2 to this number of bits (8 MB).
BITS = 26
#: Different shingles a task counts before they go to the exchange.
FLUSH = 1 << 17


def item_windows(items: DataFrame, key: str, text: str, length: int = WORDS) -> DataFrame:
    """``item, place, terms``: the windows of each item, as hashes of their terms. Null texts and
    texts of fewer terms have none; a null key has none either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TermHasher()
        for batch in batches:
            ids, places, hashes = [], [], []
            for item, value in zip(batch.column("key").to_pylist(), strings(batch, "text")):
                terms = hasher(words(one_form(value)))
                for i in range(len(terms) - length + 1):
                    ids.append(item)
                    places.append(i)
                    hashes.append(terms[i : i + length].view(np.int64))
            yield pa.RecordBatch.from_pydict({"item": pa.array(ids, pa.int64()), "place": pa.array(places, pa.int32()), "terms": pa.array(hashes, pa.list_(pa.int64()))})

    src = items.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull())
    return src.mapInArrow(run, "item long, place int, terms array<long>").dropDuplicates(["item", "terms"])


def bitmap(shingles: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bit for each ``shingle`` hash, by its lowest ``bits`` bits. Words of the bitmap are made in
    an exchange; at most 2 ** (bits - 6) of them are collected, however many shingles there are."""
    place = F.pmod("shingle", F.lit(1 << bits))
    words_ = shingles.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    rows = words_.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    found = np.zeros(1 << (bits - 6), dtype=np.int64)
    found[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return found.view(np.uint64)


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit."""
    place = hashes & np.uint64(len(bits) * 64 - 1)
    return ((bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)


def _read(known, length: int):
    """Runs of terms that may hold a window (``key, terms``), and occurrences of the windows'
    shingles in the corpus, the order of rarity (``shingle, n``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: np.ndarray = known.value
        hasher = TermHasher()
        counts: Counter[int] = Counter()

        def made(keys: list, runs: list, shingles: list, numbers: list) -> pa.RecordBatch:
            n, m = len(keys), len(shingles)
            return pa.RecordBatch.from_pydict(
                {
                    "key": pa.array([*keys, *[None] * m], pa.int64()),
                    "terms": pa.array([*runs, *[None] * m], pa.list_(pa.int64())),
                    "shingle": pa.array([*[None] * n, *shingles], pa.int64()),
                    "n": pa.array([*[None] * n, *numbers], pa.int64()),
                }
            )

        for batch in batches:
            for part in parts(batch, "text"):
                keys, runs = [], []
                for key, text in zip(part.column("key").to_pylist(), strings(part, "text")):
                    terms = hasher(words(one_form(text)))
                    there = shingle_hashes(terms, SHINGLE)
                    hit = np.flatnonzero(marked(bits, there)) if len(there) else ()
                    if not len(hit):
                        continue
                    counts.update(there[hit].view(np.int64).tolist())
                    if key is None:
                        continue
                    # hits in a row: a window of ``length`` terms has length - SHINGLE + 1 shingles
                    starts = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
                    sizes = np.diff(np.append(starts, len(hit)))
                    for at, size in zip(hit[starts], sizes):
                        if size > length - SHINGLE:
                            keys.append(key)
                            runs.append(terms[at : at + size + SHINGLE - 1].view(np.int64))
                yield made(keys, runs, [], [])
                if len(counts) > FLUSH:
                    yield made([], [], list(counts), list(counts.values()))
                    counts.clear()
        yield made([], [], list(counts), list(counts.values()))

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``owner, shingle, offset`` of each window."""
    for batch in batches:
        owners, shingles, offsets = [], [], []
        for owner, terms in zip(batch.column("owner").to_pylist(), batch.column("terms").to_pylist()):
            for i, x in enumerate(shingle_hashes(np.array(terms, dtype=np.int64).view(np.uint64), SHINGLE).view(np.int64)):
                owners.append(owner)
                shingles.append(int(x))
                offsets.append(i)
        yield pa.RecordBatch.from_pydict({"owner": pa.array(owners, pa.int64()), "shingle": pa.array(shingles, pa.int64()), "offset": pa.array(offsets, pa.int32())})


def _prefixed(prefixes, length: int):
    """``key, shingle, before, around``: the places of a run with a prefix, how many terms stand
    before it there, and the terms a window with it can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: np.ndarray = prefixes.value
        for batch in batches:
            keys, shingles, befores, around = [], [], [], []
            for key, run_ in zip(batch.column("key").to_pylist(), batch.column("terms").to_pylist()):
                terms = np.array(run_, dtype=np.int64)
                there = shingle_hashes(terms.view(np.uint64), SHINGLE)
                for at in np.flatnonzero(marked(bits, there)).tolist():
                    first = max(0, at - (length - SHINGLE))
                    keys.append(key)
                    shingles.append(int(there[at].view(np.int64)))
                    befores.append(at - first)
                    around.append(terms[first : at + length])
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "shingle": pa.array(shingles, pa.int64()), "before": pa.array(befores, pa.int32()), "around": pa.array(around, pa.list_(pa.int64()))})

    return run


def leaked(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, length: int = WORDS, bits: int = BITS) -> DataFrame:
    """``<key>, <item_key>``: each document with each item of which it holds ``length`` terms in
    unbroken sequence, both in one form and lower case, whatever signs stand between.

    Null and short texts hold nothing and leak nothing; rows with a null key are left out (they count
    in the corpus); items of the same text each leak; repeated rows give one result row. Without
    items or documents the result is empty. No other columns are read. Fewer ``bits`` in the bitmaps
    let more through to the join, and change nothing in the result.
    """
    spark = docs.sparkSession
    windows = cut(item_windows(items, item_key, item_text, length))
    distinct = cut(windows.select("terms").distinct().withColumn("owner", F.xxhash64("terms")))
    of_windows = cut(distinct.select("owner", "terms").mapInArrow(_shingles, "owner long, shingle long, offset int"))
    known = spark.sparkContext.broadcast(bitmap(of_windows.select("shingle"), bits))
    src = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    read = keep(src.mapInArrow(_read(known, length), "key long, terms array<long>, shingle long, n long"))
    counts = read.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "shingle")).alias("p")
    ranked = of_windows.join(counts, "shingle", "left").groupBy("owner").agg(rarest)
    prefixes = cut(ranked.select("owner", "p.shingle", "p.offset").join(distinct, "owner"))
    wanted = spark.sparkContext.broadcast(bitmap(prefixes.select("shingle"), bits))
    runs = read.where("terms IS NOT NULL").select("key", "terms").mapInArrow(_prefixed(wanted, length), "key long, shingle long, before int, around array<long>")
    met = runs.join(prefixes, "shingle").where(F.col("offset") <= F.col("before"))
    here = F.slice("around", F.col("before") - F.col("offset") + 1, F.lit(length))
    found = met.where(here == F.col("terms")).select("key", "owner").distinct()
    # a window may be of several items
    names = windows.select(F.xxhash64("terms").alias("owner"), F.col("item").alias(item_key)).distinct()
    return found.join(names, "owner").select(F.col("key").alias(key), item_key).distinct()
