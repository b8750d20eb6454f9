"""Parsing queries and finding the documents that match them, many queries at a time."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import STOPWORDS, analyze_positioned
from ..plans.tables import cut
from .index import SearchIndex

# Limits of admission.
MOST_TERMS = 32
MOST_COST = 5_000_000
#: Query terms that are broadcast (about 50 bytes each); more are joined in an exchange.
BROADCAST_ROWS = 200_000
#: Rows that become part of the plan itself.
LOCAL_ROWS = 10_000
#: Query terms that are named to the scan of the postings; of more a scan only uses the outer two.
LITERALS = 10


class QueryTooExpensive(ValueError):
    """A query has too many terms, or terms of too many documents."""


@dataclass(frozen=True)
class Query:
    terms: tuple[str, ...]
    offsets: tuple[int, ...]
    is_phrase: bool


@lru_cache(maxsize=1000)
def parse(text: str) -> Query:
    """A query is a phrase if the whole of it is quoted. Offsets count dropped stopwords."""
    text = text.strip()
    phrase = len(text) > 1 and text[0] == '"' and text[-1] == '"'
    found = analyze_positioned(text[1:-1] if phrase else text, STOPWORDS)
    return Query(tuple(t for _, t in found), tuple(i for i, _ in found), phrase)


_PARSED = "is_phrase boolean, terms array<struct<term string, off int>>"


def parsed(queries: DataFrame, key: str = "query", text: str = "query") -> DataFrame:
    """``<key>, is_phrase, off, term``: the terms of each query; a null query has none."""

    @F.pandas_udf(_PARSED)
    def read(values: pd.Series) -> pd.DataFrame:
        rows = [parse(v or "") for v in values]
        return pd.DataFrame({"is_phrase": [q.is_phrase for q in rows], "terms": [[{"term": t, "off": o} for t, o in zip(q.terms, q.offsets)] for q in rows]})

    rows = queries.select(F.col(key), read(F.col(text)).alias("q"))
    return rows.select(key, "q.is_phrase", F.explode("q.terms").alias("t")).select(key, "is_phrase", "t.off", "t.term")


def _few(df: DataFrame, limit: int = LOCAL_ROWS) -> pa.Table | None:
    """All rows of a table of at most ``limit`` rows, computed once; None of a larger one."""
    rows = df.limit(limit + 1).toArrow()
    return rows if rows.num_rows <= limit else None


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The table, to be broadcast if it has at most ``limit`` rows; it is then computed once, and a
    small one becomes part of the plan."""
    rows = _few(df, min(limit, LOCAL_ROWS))
    if rows is not None:
        return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
    return sized(cut(df), limit)


def sized(kept: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A kept table, to be broadcast if it has at most ``limit`` rows."""
    return F.broadcast(kept) if kept.limit(limit + 1).count() <= limit else kept


def meeting(index: SearchIndex, terms: DataFrame, *columns: str, fields: bool = False, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``term``, columns of the postings, columns of ``terms``: the postings of the terms, of the
    document field or of all. A few terms are named to the scan, which then skips the row groups
    without them; up to ``limit`` rows of ``terms`` are broadcast, more are joined."""
    post = index.postings if fields else index.postings.where("field = ''")
    rows = _few(terms, min(limit, LOCAL_ROWS))
    if rows is None:
        return post.select("term", *columns).join(sized(cut(terms), limit), "term")
    names = rows.column("term").unique().to_pylist()
    if len(names) <= LITERALS:
        post = post.where(F.col("term").isin(names))
    return post.select("term", *columns).join(F.broadcast(terms.sparkSession.createDataFrame(rows, terms.schema)), "term")


def match_any(index: SearchIndex, q: DataFrame, key: str = "query") -> DataFrame:
    """``<key>, doc_id``: documents with any term of the query."""
    return meeting(index, q.select(key, "term").distinct(), "doc_id").select(key, "doc_id").distinct()


def match_phrase(index: SearchIndex, q: DataFrame, key: str = "query") -> DataFrame:
    """``<key>, doc_id``: documents with all terms at the offsets of the query, gaps included."""
    sizes = bounded(q.groupBy(key).agg(F.countDistinct("off").alias("n"), F.countDistinct("term").alias("kinds")))
    met = meeting(index, q.select(key, "off", "term").distinct(), "doc_id", "positions")
    # documents that miss a term go before positions are unfolded
    whole = met.groupBy(key, "doc_id").agg(F.countDistinct("term").alias("kinds")).join(sizes, [key, "kinds"]).select(key, "doc_id", "n")
    places = met.join(whole, [key, "doc_id"]).select(key, "doc_id", "n", "off", F.explode("positions").alias("position"))
    starts = places.withColumn("start", F.col("position") - F.col("off"))
    full = starts.groupBy(key, "doc_id", "start", "n").agg(F.countDistinct("off").alias("m")).where("m = n")
    return full.select(key, "doc_id").distinct()


def execute(index: SearchIndex, q: DataFrame, key: str = "query", synonyms: DataFrame | None = None) -> DataFrame:
    """Free text matches any term, with synonyms if given; phrases match as they are."""
    loose = q.where("NOT is_phrase")
    if synonyms is not None:
        loose = expand(loose, synonyms, key)
    return match_any(index, loose, key).union(match_phrase(index, q.where("is_phrase"), key))


def expand(q: DataFrame, synonyms: DataFrame, key: str = "query") -> DataFrame:
    """Terms of free text with every member of their group (``term, member``)."""
    groups = bounded(synonyms.select("term", "member").distinct())
    rows = q.join(groups, "term", "left")
    return rows.select(key, "is_phrase", "off", F.explode(F.array("term", F.coalesce("member", "term"))).alias("term")).distinct()


def query_cost(index: SearchIndex, q: DataFrame, key: str = "query") -> DataFrame:
    """``<key>, terms, cost``: terms, repeats counted, and documents of the distinct ones."""
    counts = q.groupBy(key).agg(F.count("*").alias("terms"))
    df = index.term_stats.where("field = ''").select("term", "df").join(bounded(q.select(key, "term").distinct()), "term")
    cost = df.groupBy(key).agg(F.sum("df").alias("cost"))
    return counts.join(cost, key, "left").select(key, "terms", F.coalesce("cost", F.lit(0)).cast("long").alias("cost"))


def refuse_expensive(index: SearchIndex, text: str, most_terms: int = MOST_TERMS, most_cost: int = MOST_COST) -> None:
    """Raises QueryTooExpensive for one query; terms are looked at first."""
    q = parse(text)
    if len(q.terms) > most_terms:
        raise QueryTooExpensive(f"{len(q.terms)} terms, the most is {most_terms}")
    row = index.term_stats.where((F.col("field") == "") & F.col("term").isin(list(set(q.terms)))).agg(F.sum("df")).first()
    if (row[0] or 0) > most_cost:
        raise QueryTooExpensive(f"{row[0]} postings, the most is {most_cost}")


def refused(index: SearchIndex, q: DataFrame, key: str = "query", most_terms: int = MOST_TERMS, most_cost: int = MOST_COST) -> DataFrame:
    """``<key>, terms, cost, reason`` of the queries that are too expensive; terms are looked at first."""
    rows = query_cost(index, q, key)
    reason = F.when(F.col("terms") > most_terms, "terms").when(F.col("cost") > most_cost, "cost")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL")


def segment_query(text: str, phrases: Iterable[str]) -> list[str]:
    """Words, with runs that are a known phrase (lower case) quoted; the longest phrase wins."""
    known = set(phrases)
    most = max((len(p.split()) for p in known), default=1)
    left, out = text.split(), []
    while left:
        n = next((n for n in range(min(most, len(left)), 1, -1) if " ".join(left[:n]).lower() in known), 1)
        out.append(left[0] if n == 1 else '"' + " ".join(left[:n]) + '"')
        left = left[n:]
    return out
