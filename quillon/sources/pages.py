"""Page records: the corpus format, encyclopedia dumps, and writing them."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .wikitext import clean_wikitext


class CorpusFormatError(ValueError):
    """A page record has no id."""


def unescape(text: Column) -> Column:
    """Character references as characters; only text with an ampersand leaves the JVM."""

    @F.pandas_udf("string")
    def unescaped(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else html.unescape(v))

    return F.when(text.contains("&"), unescaped(F.when(text.contains("&"), text))).otherwise(text)


def _records(spark: SparkSession, path: str, opening: str = "<page>") -> DataFrame:
    """``body`` of each closed page. Files are read in pieces that begin after an opening tag, so no
    file needs to fit in a row; what stands outside pages, and a last page cut short, are pieces
    without a closing tag or behind one."""
    pieces = spark.read.option("lineSep", opening).text(path).where(F.col("value").contains("</page>"))
    return pieces.select(F.substring_index("value", "</page>", 1).alias("body"))


def _element(body: Column, name: str) -> Column:
    """What the first element of a name holds, null without a closed one. Its opening tag may have
    attributes; one that closes itself holds nothing."""
    rest = F.get(F.split(body, rf"<{name}(?=[\s/>])", 2), F.lit(1))
    opening = F.substring_index(rest, ">", 1)
    inside = F.substring(rest, F.length(opening) + 2, F.length(rest))
    closed = F.when(inside.contains(f"</{name}>"), F.substring_index(inside, f"</{name}>", 1))
    return F.when(opening.endswith("/"), F.lit("")).otherwise(closed)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _number(text: Column) -> Column:
    return F.when(_stripped(text).rlike(r"^\d+$"), _stripped(text).cast("long"))


def parse_pages(rows: DataFrame) -> DataFrame:
    """``doc_id, title, text`` of page bodies. The first id counts; a page without one raises."""
    body = F.col("body")
    read = rows.select(_number(_element(body, "id")).alias("id"), _element(body, "title").alias("title"), _element(body, "text").alias("text"), F.substring(body, 1, 80).alias("start"))
    known = F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("page record has no <id>: "), "start"))).otherwise(F.col("id"))
    whole = lambda c: unescape(F.coalesce(F.col(c), F.lit("")))
    return read.select(known.cast("long").alias("doc_id"), _stripped(whole("title")).alias("title"), whole("text").alias("text"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A corpus: ``<page><id>1</id><title>T</title><text>X</text></page>`` records. What stands
    outside pages is ignored; a last page that is cut short is dropped."""
    return parse_pages(_records(spark, path))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """The articles of an encyclopedia dump, plain, .gz or .bz2, as ``doc_id, title, text`` with
    cleaned text: no redirects (pages with a redirect element; a page that only writes of redirects
    is an article), no other name spaces (a page without one is an article), none without id, text,
    or anything left after cleaning."""
    rows = _records(spark, path, "<page").select(F.regexp_replace("body", "^[^>]*>", "").alias("body"))
    body = F.col("body")
    head = F.substring_index(body, "<text", 1)
    rows = rows.where(~head.rlike(r"<redirect[\s/>]") & _stripped(F.coalesce(_element(head, "ns"), F.lit("0"))).isin("", "0"))
    rows = rows.where(_number(_element(body, "id")).isNotNull() & _element(body, "text").isNotNull())
    return parse_pages(rows).withColumn("text", clean_wikitext(F.col("text"))).where("text != ''")


def articles(rows: DataFrame) -> DataFrame:
    """``revision_id, article_id, title, text`` of the articles among dumped revisions (``ns``,
    ``redirect``, ``text``), by the rules of a dump: the main name space or none, no redirects,
    something left after cleaning. A revision delivered twice is one."""
    kept = rows.where(F.coalesce(F.col("ns"), F.lit(0)) == 0).where(F.col("redirect").isNull() & F.col("text").isNotNull())
    cleaned = kept.select("revision_id", "article_id", _stripped(F.coalesce("title", F.lit(""))).alias("title"), clean_wikitext(F.col("text")).alias("text"))
    return cleaned.where("text != ''").distinct()


def _escaped(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "&", "&amp;")
    return F.regexp_replace(F.regexp_replace(t, "<", "&lt;"), ">", "&gt;")


def page_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, title, text`` as page records, one in ``value``."""
    page = F.concat(F.lit("<page><id>"), F.col("doc_id").cast("string"), F.lit("</id><title>"), _escaped(F.col("title")), F.lit("</title><text>"), _escaped(F.col("text")), F.lit("</text></page>"))
    return docs.select(page.alias("value"))


def dump_lines(rows: DataFrame) -> DataFrame:
    """``page_id, ns, redirect, revision_id, title, text`` as pages of an encyclopedia dump."""
    ns = F.when(F.col("ns").isNull(), F.lit("")).otherwise(F.concat(F.lit("<ns>"), F.col("ns").cast("string"), F.lit("</ns>")))
    to = F.when(F.col("redirect").isNull(), F.lit("")).otherwise(F.concat(F.lit('<redirect title="'), F.regexp_replace(_escaped(F.col("redirect")), '"', "&quot;"), F.lit('" />')))
    text = F.when(F.col("text").isNull(), F.lit("")).otherwise(F.concat(F.lit('<text xml:space="preserve">'), _escaped(F.col("text")), F.lit("</text>")))
    return rows.select(
        F.concat(
            F.lit("<page>\n<title>"), _escaped(F.col("title")), F.lit("</title>"), ns, F.lit("<id>"), F.col("page_id").cast("string"), F.lit("</id>"), to,
            F.lit("<revision><id>"), F.col("revision_id").cast("string"), F.lit("</id>"), text, F.lit("</revision>\n</page>"),
        ).alias("value")
    )


def write_pages(docs: DataFrame, path: str) -> int:
    """Writes ``doc_id, title, text`` as a corpus, a page a record, and returns how many, counted
    while they are written."""
    seen = Observation()
    page_lines(docs).observe(seen, F.count(F.lit(1)).alias("pages")).write.text(path)
    return seen.get["pages"]
