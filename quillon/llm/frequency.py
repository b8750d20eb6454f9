"""Frequency of every distinct term, and marks of those of no use (problem 1).

Heavy-light aggregation in two passes. The first finds every term above a share of all tokens, by
mergeable bounded summaries over all records. The second counts exactly: occurrences of the
broadcast heavy terms in local arrays, one partial row a term and task; all other terms in local
tables that are flushed into the shuffle. Both count tables come out of one exchange, as a union of
heavy slots and light terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import PIECE, pieces, words
from .arrow import parts, strings

#: A term is heavy from this share of all tokens on, so there are at most 1 / HEAVY_SHARE.
HEAVY_SHARE = 1 / 4096
#: Counters of a summary. A summary misses at most n / SUMMARY of its n tokens of any term.
SUMMARY = 1 << 14
#: Distinct light terms held by a task before they go to the shuffle.
FLUSH = 1 << 17


def record_texts(batch: pa.RecordBatch, columns: list[str]) -> Iterator[str]:
    """The text of each record: its columns joined by a space, null as empty."""
    for values in zip(*(strings(batch, c) for c in columns)):
        yield " ".join(values)


def text_words(text: str) -> Iterator[list[str]]:
    """Words of a text, in pieces where it is very long."""
    if len(text) <= PIECE:
        yield words(text)
    else:
        for piece in pieces(text):
            yield words(piece)


def _summaries(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter[str] = Counter()
        tokens = lost = records = 0

        def prune() -> int:
            if len(kept) <= SUMMARY:
                return 0
            counts = np.fromiter(kept.values(), dtype=np.int64, count=len(kept))
            cut = int(np.partition(counts, len(counts) - SUMMARY - 1)[len(counts) - SUMMARY - 1])
            left = {t: c - cut for t, c in kept.items() if c > cut}
            kept.clear()
            kept.update(left)
            return cut

        for batch in batches:
            records += batch.num_rows
            for part in parts(batch, *columns):
                for text in record_texts(part, columns):
                    for found in text_words(text):
                        tokens += len(found)
                        kept.update(found)
                        if len(kept) > 4 * SUMMARY:
                            lost += prune()
        lost += prune()
        # what cannot be heavy even with all that was lost stays here; the total row has no term
        rows = [(t, c) for t, c in kept.items() if c + lost > HEAVY_SHARE * tokens / 2]
        yield pa.RecordBatch.from_pydict(
            {
                "term": pa.array([None, *(t for t, _ in rows)], pa.string()),
                "count": pa.array([tokens, *(c for _, c in rows)], pa.int64()),
                "lost": pa.array([lost, *[0] * len(rows)], pa.int64()),
                "records": pa.array([records, *[0] * len(rows)], pa.int64()),
            }
        )

    return run


def heavy_terms(df: DataFrame, columns: list[str]) -> tuple[list[str], int]:
    """The heavy terms and the number of records. Every term of HEAVY_SHARE or more is among them,
    and some down to half of it: at most 2 / HEAVY_SHARE strings, however large the collection."""
    src = df.select(*columns)
    merged = src.mapInArrow(_summaries(columns), "term string, count long, lost long, records long")
    merged = merged.groupBy("term").agg(F.sum("count").alias("count"), F.sum("lost").alias("lost"), F.sum("records").alias("records"))
    most = int(2 / HEAVY_SHARE)
    rows = merged.orderBy(F.col("term").isNotNull(), F.col("count").desc(), "term").limit(most).collect()
    total = next((r for r in rows if r["term"] is None), None)
    if total is None:
        return [], 0
    least = HEAVY_SHARE / 2 * total["count"]
    return [r["term"] for r in rows if r["term"] is not None and r["count"] + total["lost"] >= least], total["records"]


def _partials(columns: list[str], heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[str, int] = heavy.value
        counts = np.zeros((2, len(slots)), dtype=np.int64)
        occurrences: Counter[str] = Counter()
        documents: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            light = []
            for term, n in occurrences.items():
                slot = slots.get(term)
                if slot is None:
                    light.append(term)
                else:
                    counts[0, slot] += n
                    counts[1, slot] += documents[term]
            made = pa.RecordBatch.from_pydict(
                {
                    "slot": pa.nulls(len(light), pa.int32()),
                    "term": pa.array(light, pa.string()),
                    "occurrences": pa.array([occurrences[t] for t in light], pa.int64()),
                    "documents": pa.array([documents[t] for t in light], pa.int64()),
                }
            )
            occurrences.clear()
            documents.clear()
            return made

        for batch in batches:
            for part in parts(batch, *columns):
                for text in record_texts(part, columns):
                    if len(text) <= PIECE:
                        found = words(text)
                        occurrences.update(found)
                        documents.update(set(found))
                    else:
                        seen: set[str] = set()
                        for found in text_words(text):
                            occurrences.update(found)
                            seen.update(found)
                        documents.update(seen)
                    if len(occurrences) > FLUSH:
                        yield flush()
        yield flush()
        there = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_pydict(
            {
                "slot": pa.array(there, pa.int32()),
                "term": pa.nulls(len(there), pa.string()),
                "occurrences": pa.array(counts[0, there], pa.int64()),
                "documents": pa.array(counts[1, there], pa.int64()),
            }
        )

    return run


def term_counts(df: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """``term, occurrences, documents`` of every distinct term of the columns, and the number of
    records.

    Null and empty texts hold no term but are records; repeated rows count again; no columns but
    the named ones are read, so other columns may have any name. An empty table gives no rows and
    0 records. Very long texts are counted in pieces.
    """
    spark = df.sparkSession
    heavy, records = heavy_terms(df, columns)
    slots = spark.sparkContext.broadcast({t: i for i, t in enumerate(heavy)})
    src = df.select(*columns)
    counted = src.mapInArrow(_partials(columns, slots), "slot int, term string, occurrences long, documents long")
    counted = counted.groupBy("slot", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))
    names = F.array(*[F.lit(t) for t in heavy]) if heavy and len(heavy) <= 16 else None
    if heavy and names is None:
        table = F.broadcast(spark.createDataFrame(list(enumerate(heavy)), "slot int, name string"))
        counted = counted.join(table, "slot", "left").withColumn("term", F.coalesce("term", "name"))
    elif heavy:
        counted = counted.withColumn("term", F.coalesce("term", F.get(names, F.col("slot"))))
    return counted.select("term", "occurrences", "documents"), records


def marked_terms(df: DataFrame, columns: list[str], rare: int = 2, common: float = 0.4) -> DataFrame:
    """``term, occurrences, documents, mark``: ``rare`` if at most ``rare`` records hold the term,
    else ``common`` if more than the share ``common`` of all records hold it, else null."""
    counts, records = term_counts(df, columns)
    mark = F.when(F.col("documents") <= rare, "rare").when(F.col("documents") > common * records, "common")
    return counts.withColumn("mark", mark)
