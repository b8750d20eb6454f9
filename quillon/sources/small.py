"""Small files read on the driver: judgements and synonym groups, with errors that name the line."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import analyze
from ..operators.components import components
from ..plans.tables import cut


class JudgementFormatError(ValueError):
    """A line is no judgement."""


class SynonymFormatError(ValueError):
    """A line is no group of single terms."""


def _whole(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def parse_judgements(lines: Iterable[str]) -> list[tuple[str, int, int]]:
    """(query, document, grade) of JSON lines; blank lines and # lines are skipped."""
    found = []
    for number, line in enumerate(lines, 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue

        def refuse(why: str, number: int = number) -> None:
            raise JudgementFormatError(f"line {number}: {why}")

        try:
            record = json.loads(line)
        except ValueError as error:
            refuse(f"not JSON: {error}")
        if not isinstance(record, dict):
            refuse("not an object")
        query, pairs = record.get("query"), record.get("judgements")
        if not isinstance(query, str) or not query.strip():
            refuse("the query is missing or empty")
        if not isinstance(pairs, list):
            refuse("the judgements are no list")
        seen = set()
        for pair in pairs:
            if not (isinstance(pair, list) and len(pair) == 2 and all(map(_whole, pair)) and pair[1] >= 0):
                refuse(f"no pair of document and grade: {pair!r}")
            if pair[0] in seen:
                refuse(f"document {pair[0]} is judged twice")
            seen.add(pair[0])
            found.append((query, pair[0], pair[1]))
    return found


def _lines(spark: SparkSession, path: str) -> list[str]:
    """The lines of a small file, or of the files of a small folder, wherever Spark reads them."""
    texts = spark.read.option("wholetext", True).text(path).collect()
    return [line for r in texts for line in r["value"].split("\n")]


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """``query, doc_id, grade`` of a file of judgements."""
    return spark.createDataFrame(parse_judgements(_lines(spark, path)), "query string, doc_id long, grade int")


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """``term, member`` of a file of comma-separated groups."""
    groups = parse_synonyms(_lines(spark, path))
    found = sorted((t, m) for t, group in groups.items() for m in group if m != t)
    return spark.createDataFrame(found, "term string, member string")


def merged(groups: Iterable[Iterable[str]]) -> dict[str, frozenset[str]]:
    """Groups that share a term are one group."""
    root: dict[str, str] = {}

    def find(t: str) -> str:
        while root.setdefault(t, t) != t:
            root[t] = root[root[t]]
            t = root[t]
        return t

    for group in groups:
        first, *rest = group
        for t in (first, *rest):
            root[find(t)] = find(first)
    members: dict[str, set[str]] = {}
    for t in list(root):
        members.setdefault(find(t), set()).add(t)
    return {t: frozenset(members[find(t)]) for t in root}


def parse_synonyms(lines: Iterable[str]) -> dict[str, frozenset[str]]:
    """Comma-separated groups; every member must be one term, and two must differ."""
    groups = []
    for number, line in enumerate(lines, 1):
        if not line.strip() or line.strip().startswith("#"):
            continue
        terms = []
        for member in line.split(","):
            found = analyze(member)
            if len(found) != 1:
                raise SynonymFormatError(f"line {number}: {member.strip()!r} is not a single term")
            terms += found
        if len(set(terms)) < 2:
            raise SynonymFormatError(f"line {number}: a group needs two distinct terms")
        groups.append(terms)
    return merged(groups)


def synonym_table(pairs: DataFrame, most: int = 100_000) -> DataFrame:
    """``term, member`` of index terms from pairs of words, closed over shared terms. Pairs with an
    empty, null or many-worded side are left out. Up to ``most`` different pairs are closed on the
    driver, more by steps in exchanges, with the same result."""
    raw = pairs.select("term", "member").dropna().distinct()
    rows = raw.limit(most + 1).collect()
    if len(rows) > most:
        return _closed(raw)
    groups = []
    for a, b in rows:
        x, y = analyze(a), analyze(b)
        if len(x) == 1 and len(y) == 1 and x != y:
            groups.append((x[0], y[0]))
    found = sorted((t, m) for t, group in merged(groups).items() for m in group if m != t)
    return pairs.sparkSession.createDataFrame(found, "term string, member string")


def _closed(raw: DataFrame) -> DataFrame:
    @F.pandas_udf("array<string>")
    def terms(values: pd.Series) -> pd.Series:
        return values.map(analyze)

    sides = raw.select(terms("term").alias("x"), terms("member").alias("y")).where("size(x) = 1 AND size(y) = 1")
    edges = cut(sides.select(F.col("x")[0].alias("v"), F.col("y")[0].alias("u")).where("v <> u"))
    roots = components(edges)
    every = edges.select("v").union(edges.select("u")).distinct().join(roots, "v", "left").select(F.coalesce("root", "v").alias("root"), F.col("v").alias("term"))
    every = cut(every)
    return every.join(every.select("root", F.col("term").alias("member")), "root").where("term <> member").select("term", "member")
