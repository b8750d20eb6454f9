"""How distinctive a term is for a record (problem 3).

Probabilistic relevance weighting: saturating term frequency, document-length normalisation,
collection document frequencies and average length. The usual tf-idf weight is the same formula
without saturation (``k1`` infinite), without length normalisation (``b`` 0) and with the plain
logarithm as document weight.

Document frequencies are counted with local tables, so the exchange gets a row a term and task.
Terms many records hold are weighted where their record is, from a broadcast of bounded size; only
the others travel to their document frequency.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import PIECE
from ..plans.tables import cut, keep
from .arrow import parts, strings
from .frequency import FLUSH, text_words

#: Most terms in the broadcast of document frequencies: the most frequent ones. Beyond it terms
#: take the way through the exchange, with the same result.
BROADCAST_TERMS = 20_000
#: Terms in fewer records than this share never count as frequent.
FREQUENT_SHARE = 1 / 1000


@dataclass(frozen=True)
class Weighting:
    """``idf(df) * saturation(tf, length)``. k1 None means no saturation."""

    k1: float | None = 1.2
    b: float = 0.75
    classic: bool = False

    def idf(self, records: int, documents: Column) -> Column:
        n, df = F.lit(float(records)), documents.cast("double")
        return F.log(n / df) if self.classic else F.log(1 + (n - df + 0.5) / (df + 0.5))

    def document_weight(self, records: int, documents: int) -> float:
        return math.log(records / documents) if self.classic else math.log(1 + (records - documents + 0.5) / (documents + 0.5))

    def norm(self, average: float, length: int) -> float:
        return 1 - self.b + self.b * length / (average or 1.0)

    def score(self, records: int, average: float, tf: Column, length: Column, documents: Column) -> Column:
        tf = tf.cast("double")
        if self.k1 is None:
            return tf * self.idf(records, documents)
        norm = 1 - self.b + self.b * length.cast("double") / F.lit(average or 1.0)
        return self.idf(records, documents) * tf * (self.k1 + 1) / (tf + self.k1 * norm)


BM25 = Weighting()
TF_IDF = Weighting(k1=None, b=0.0, classic=True)


def _counted(text: str) -> tuple[Counter[str], int]:
    counts: Counter[str] = Counter()
    for found in text_words(text):
        counts.update(found)
    return counts, counts.total()


def _frequencies(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents: Counter[str] = Counter()
        records = tokens = 0

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict(
                {
                    "term": pa.array([*documents], pa.string()),
                    "documents": pa.array([*documents.values()], pa.int64()),
                    "tokens": pa.nulls(len(documents), pa.int64()),
                }
            )
            documents.clear()
            return made

        for batch in batches:
            records += batch.num_rows
            for part in parts(batch, *columns):
                for values in zip(*(strings(part, c) for c in columns)):
                    text = " ".join(values)
                    if len(text) <= PIECE:
                        found = next(text_words(text))
                        tokens += len(found)
                        documents.update(set(found))
                    else:
                        counts, n = _counted(text)
                        tokens += n
                        documents.update(counts.keys())
                    if len(documents) > FLUSH:
                        yield flush()
        yield flush()
        yield pa.RecordBatch.from_pydict({"term": pa.array([None], pa.string()), "documents": pa.array([records], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    return run


@dataclass(frozen=True)
class Collection:
    """What scoring needs to know of all records."""

    documents: DataFrame  # term, documents
    records: int
    average: float  # words of a record
    frequent: dict[str, int]  # term -> documents, of bounded size


def collection(df: DataFrame, columns: list[str], least: int = 1) -> Collection:
    """Statistics over all records; terms that fewer than ``least`` records hold are left out."""
    counted = df.select(*columns).mapInArrow(_frequencies(columns), "term string, documents long, tokens long")
    counted = cut(counted.groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where(F.col("term").isNull() | (F.col("documents") >= least)))
    total = counted.where("term IS NULL").first()
    records, tokens = (total["documents"], total["tokens"]) if total else (0, 0)
    terms = counted.where("term IS NOT NULL").select("term", "documents")
    floor = max(least, FREQUENT_SHARE * records)
    rows = terms.where(F.col("documents") >= F.lit(floor)).orderBy(F.col("documents").desc(), "term").limit(BROADCAST_TERMS).collect()
    return Collection(terms, records, tokens / records if records else 0.0, {r["term"]: r["documents"] for r in rows})


def _postings(key: str, columns: list[str], frequent):
    """Every term of every record, with its document frequency if it is frequent: texts are read once
    for the terms weighted in place and for those that travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = frequent.value
        for batch in batches:
            for part in parts(batch, *columns):
                ids, terms, tfs, lengths, dfs = [], [], [], [], []
                for values in zip(part.column(key).to_pylist(), *(strings(part, c) for c in columns)):
                    counts, length = _counted(" ".join(values[1:]))
                    ids.extend([values[0]] * len(counts))
                    terms.extend(counts)
                    tfs.extend(counts.values())
                    lengths.extend([length] * len(counts))
                    dfs.extend(map(known.get, counts))
                yield pa.RecordBatch.from_pydict(
                    {
                        key: pa.array(ids, pa.int64()),
                        "term": pa.array(terms, pa.string()),
                        "tf": pa.array(tfs, pa.int32()),
                        "length": pa.array(lengths, pa.int64()),
                        "documents": pa.array(dfs, pa.int64()),
                    }
                )

    return run


def term_scores(df: DataFrame, key: str, columns: list[str], weighting: Weighting = BM25) -> DataFrame:
    """``<key>, term, tf, documents, score`` for every term of every record.

    Null and empty texts hold no term. A key that is null or repeated stays as it is: each row is
    a record of its own. An empty table gives no rows. No other columns are read.
    """
    known = collection(df, columns)
    spark = df.sparkSession
    frequent = spark.sparkContext.broadcast(known.frequent)
    src = df.select(F.col(key).cast("long").alias(key), *columns)
    rows = keep(src.mapInArrow(_postings(key, columns, frequent), f"`{key}` long, term string, tf int, length long, documents long"))
    light = rows.where("documents IS NULL").drop("documents").join(known.documents, "term")
    rows = rows.where("documents IS NOT NULL").unionByName(light)
    score = weighting.score(known.records, known.average, F.col("tf"), F.col("length"), F.col("documents"))
    return rows.select(key, "term", "tf", "documents", score.alias("score"))


def _candidates(key: str, columns: list[str], frequent, weighting: Weighting, records: int, average: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = frequent.value
        weights = {t: weighting.document_weight(records, n) for t, n in known.items()}
        highest = weighting.document_weight(records, min(least, records)) + 1e-9 if records else 0.0
        k1 = weighting.k1
        for batch in batches:
            for part in parts(batch, *columns):
                ids, terms, tfs, lengths, dfs = [], [], [], [], []
                for values in zip(part.column(key).to_pylist(), *(strings(part, c) for c in columns)):
                    counts, length = _counted(" ".join(values[1:]))
                    best, top, light = -1.0, None, []
                    if k1 is not None:
                        damp = k1 * weighting.norm(average, length)
                    for term, tf in counts.items():
                        w = weights.get(term)
                        if w is None:
                            light.append((term, tf))
                        else:
                            w = round(tf * w if k1 is None else w * tf * (k1 + 1) / (tf + damp), 6)
                            if w > best or (w == best and term < top):
                                best, top = w, term
                    if top is not None:
                        ids.append(values[0])
                        terms.append(top)
                        tfs.append(counts[top])
                        lengths.append(length)
                        dfs.append(known[top])
                    for term, tf in light:
                        # no term of ``least`` records or more weighs more than this
                        if (tf if k1 is None else tf * (k1 + 1) / (tf + damp)) * highest >= best - 1e-6:
                            ids.append(values[0])
                            terms.append(term)
                            tfs.append(tf)
                            lengths.append(length)
                            dfs.append(None)
                yield pa.RecordBatch.from_pydict({key: pa.array(ids, pa.int64()), "term": pa.array(terms, pa.string()), "tf": pa.array(tfs, pa.int32()), "length": pa.array(lengths, pa.int64()), "known": pa.array(dfs, pa.int64())})

    return run


def most_distinctive(df: DataFrame, key: str, columns: list[str], least: int = 2, weighting: Weighting = BM25) -> DataFrame:
    """``<key>, term, weight``: for each record the term of greatest weight (rounded to 6 decimals) among the terms at least ``least`` records hold; on a tie the smaller term.
    Records without such a term are left out, rows with a null key too. Rows that repeat a key are
    records of their own in the counts and share one result row.

    Exact: a record's frequent terms are weighted in place and its best one kept; another term
    travels only if it can still win, which its frequency and ``least`` bound.
    """
    known = collection(df, columns, least)
    if not known.records:
        return df.sparkSession.createDataFrame([], f"`{key}` long, term string, weight double")
    frequent = df.sparkSession.sparkContext.broadcast(known.frequent)
    src = df.select(F.col(key).cast("long").alias(key), *columns).where(F.col(key).isNotNull())
    rows = src.mapInArrow(_candidates(key, columns, frequent, weighting, known.records, known.average, least), f"`{key}` long, term string, tf int, length long, known long")
    # a row whose weight is known looks for no document frequency: it gets a key of its own
    look = F.when(F.col("known").isNull(), F.col("term")).otherwise(F.concat(F.lit("\x00"), F.col(key).cast("string")))
    table = known.documents.select(F.col("term").alias("look"), "documents")
    found = rows.withColumn("look", look).join(table, "look", "left").withColumn("documents", F.coalesce("known", "documents")).where("documents IS NOT NULL")
    weight = F.round(weighting.score(known.records, known.average, F.col("tf"), F.col("length"), F.col("documents")), 6)
    best = found.select(key, "term", weight.alias("weight")).groupBy(key).agg(F.min(F.struct(-F.col("weight"), "term")).alias("best"))
    return best.select(key, F.col("best.term").alias("term"), (-F.col("best.col1")).alias("weight"))
