"""The positional inverted index as tables.

postings    term, field, doc_id, tf, length, positions   one row for a term of a field of a document
term_stats  term, field, df, cf, max_tf
doc_stats   doc_id, length, title_length, norm   also of documents without terms
tops        term, impacts                        greatest impacts of a term, for pruning
blocks      term, block_no, last_document, document_count, max_tf

A document's postings are made where its text is read; ``length`` is that of their field, so scoring
looks for nothing but postings. They are laid out by ranges of (term, field, document): few terms
are a few row groups, and a term of very many documents is spread over many tasks and files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analysis import STOPWORDS, fingerprint, term_of, tokenize
from ..functions.batches import parts, strings
from ..functions.words import pieces
from ..plans.tables import drop_kept, keep

BLOCK = 128
#: Impacts of a term in ``tops``, and the width of the runs of document ids that give one each.
TOPS, RANGE = 64, 256
# Parameters of BM25.
K1, B = 1.2, 0.75
#: Terms of tokens a task remembers.
REMEMBERED = 1 << 18
_POSTINGS = "term string, field string, doc_id long, tf int, length int, positions array<int>"


class DuplicateDocument(ValueError):
    """A document id occurs twice."""


class StaleIndex(ValueError):
    """The documents changed after a ranking was prepared."""


def documents(df: DataFrame, key: str = "doc_id", title: str = "title", text: str = "text") -> DataFrame:
    """``doc_id, title, text`` without nulls; rows without an id are left out."""
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(title), F.lit("")).alias("title"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def postings(docs: DataFrame, stopwords: frozenset[str] = STOPWORDS, form: str = "NFC", fields: bool = True) -> DataFrame:
    """Postings of ``doc_id, title, text``: the document field '' holds title and text joined by a
    space, the field 'title' the title again, counted from 0. Very long texts are read in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}

        def places(content: str) -> tuple[dict[str, list[int]], int]:
            """The places of each term of a field, and how many terms it has."""
            at: dict[str, list[int]] = {}
            number = dropped = 0
            for piece in pieces(content):
                tokens = tokenize(piece, form)
                for position, token in enumerate(tokens, number):
                    try:
                        term = known[token]
                    except KeyError:
                        if len(known) > REMEMBERED:
                            known.clear()
                        term = known[token] = None if token in stopwords else term_of(token)
                    if term is None:
                        dropped += 1
                    elif term in at:
                        at[term].append(position)
                    else:
                        at[term] = [position]
                number += len(tokens)
            return at, number - dropped

        for batch in batches:
            for part in parts(batch, "title", "text"):
                terms, names, ids, tfs, lengths, flat, ends = [], [], [], [], [], [], [0]
                for doc, title, text in zip(part.column("doc_id").to_pylist(), strings(part, "title"), strings(part, "text")):
                    for field, content in (("", f"{title} {text}"), ("title", title))[: 2 if fields else 1]:
                        at, length = places(content)
                        terms.extend(at)
                        for positions in at.values():
                            tfs.append(len(positions))
                            flat.extend(positions)
                            ends.append(len(flat))
                        names.extend([field] * len(at))
                        ids.extend([doc] * len(at))
                        lengths.extend([length] * len(at))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(names, pa.string()), pa.array(ids, pa.int64()), pa.array(tfs, pa.int32()), pa.array(lengths, pa.int32()), lists], names=["term", "field", "doc_id", "tf", "length", "positions"])

    return docs.select("doc_id", "title", "text").mapInArrow(run, _POSTINGS)


def laid_out(post: DataFrame) -> DataFrame:
    """Postings in ranges of term, field and document, sorted in each. Range bounds come from a
    sample of ``post``, which should therefore be cheap to read again."""
    order = ["term", "field", "doc_id"]
    return post.repartitionByRange(*order).sortWithinPartitions(*order)


def term_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("term", "field").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


def blocks(post: DataFrame, size: int = BLOCK) -> DataFrame:
    """Runs of ``size`` documents of each term, in order of id, with what bounds their scores. Ids
    are numbered in ranges of their own first, so a term of all documents is not one task's."""
    rows = post.where("field = ''").select("term", "doc_id", "tf")
    rows = rows.withColumn("range", F.floor(F.col("doc_id") / (1 << 20)))
    held = rows.groupBy("term", "range").agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("term").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("term", "range", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("term", "range").orderBy("doc_id")) - 1
    rows = rows.withColumn("number", number).join(held, ["term", "range"])
    rows = rows.withColumn("block_no", F.floor((F.col("number") + F.col("before")) / size).cast("long"))
    return rows.groupBy("term", "block_no").agg(F.max("doc_id").alias("last_document"), F.count("*").alias("document_count"), F.max("tf").alias("max_tf"))


def saturate(tf: Column, length: Column, average: float, k1: float, b: float) -> Column:
    """The part of BM25 that grows with the occurrences of a term, and never beyond k1 + 1."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(average or 1.0)))


def tops(post: DataFrame, average: float, most: int = TOPS, k1: float = K1, b: float = B) -> DataFrame:
    """``term, impacts``: what a term adds to a score, but for its document weight, in documents where
    that is greatest: the greatest first, at most ``most``. Of each run of RANGE ids one document is
    taken, so the documents are different ones and a frequent term is reduced where it is read."""
    rows = post.select("term", F.floor(F.col("doc_id") / RANGE).alias("range"), saturate(F.col("tf"), F.col("length"), average, k1, b).alias("impact"))
    rows = rows.groupBy("term", "range").agg(F.max("impact").alias("impact"))
    order = F.row_number().over(Window.partitionBy("term").orderBy(F.col("impact").desc(), "range"))
    first = rows.withColumn("r", order).where(F.col("r") <= most)
    return first.groupBy("term").agg(F.sort_array(F.collect_list("impact"), asc=False).alias("impacts"))


def doc_lengths(docs: DataFrame, post: DataFrame) -> DataFrame:
    """``doc_id, length, title_length``; terms after stopwords, 0 for documents without any."""
    of = post.groupBy("doc_id").agg(
        F.coalesce(F.sum(F.when(F.col("field") == "", F.col("tf"))), F.lit(0)).alias("length"),
        F.coalesce(F.sum(F.when(F.col("field") == "title", F.col("tf"))), F.lit(0)).alias("title_length"),
    )
    return docs.select("doc_id").join(of, "doc_id", "left").na.fill(0, ["length", "title_length"])


@dataclass(frozen=True)
class SearchIndex:
    """An index as tables, with the few numbers of the whole collection."""

    docs: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    doc_stats: DataFrame
    tops: DataFrame
    document_count: int
    average_length: float
    average_title: float
    shortest: int
    fingerprint: str
    generation: int = 0

    def term_postings(self, term: str, field: str = "") -> DataFrame:
        return self.postings.where((F.col("term") == term) & (F.col("field") == field)).select("doc_id", "tf", "positions")

    def document_frequency(self, term: str, field: str = "") -> int:
        row = self.term_stats.where((F.col("term") == term) & (F.col("field") == field)).select("df").first()
        return row["df"] if row else 0

    def document_length(self, doc_id: int) -> int:
        row = self.doc_stats.where(F.col("doc_id") == doc_id).select("length").first()
        return row["length"] if row else 0

    def contains(self, doc_id: int) -> bool:
        return bool(self.doc_stats.where(F.col("doc_id") == doc_id).take(1))

    def terms(self) -> DataFrame:
        """Terms as they are shown: those of a field with its name before a colon."""
        return self.term_stats.select(qualified(F.col("field"), F.col("term")).alias("term"))

    def vocabulary_size(self) -> int:
        return self.term_stats.count()

    def document_ids(self) -> DataFrame:
        return self.doc_stats.select("doc_id")

    def checked(self, of: SearchIndex) -> SearchIndex:
        """This index, if it still has as many documents as the one something was prepared for."""
        if self.document_count != of.document_count:
            raise StaleIndex(f"prepared for {of.document_count} documents, there are {self.document_count}")
        return self

    def at(self, generation: int) -> SearchIndex:
        return replace(self, generation=generation)


def qualified(field, term):
    return F.when(field == "", term).otherwise(F.concat(field, F.lit(":"), term))


def is_field_term(term: str) -> bool:
    return ":" in term


def field_term(field: str, term: str) -> str:
    return f"{field}:{term}"


def from_tables(docs: DataFrame, post: DataFrame, print_: str) -> SearchIndex:
    """An index of postings that exist already."""
    stats = keep(term_stats(post))
    lengths = doc_lengths(docs, post)
    n = docs.count()
    idf = stats.where("field = ''").select("term", F.log(F.lit(float(max(n, 1))) / F.col("df")).alias("idf"))
    norms = post.where("field = ''").join(idf, "term").groupBy("doc_id").agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)).alias("norm"))
    of_docs = keep(lengths.join(norms, "doc_id", "left").na.fill(0.0, ["norm"]))
    whole = of_docs.agg(F.avg("length").alias("a"), F.avg("title_length").alias("t"), F.min("length").alias("m")).first()
    highest = keep(tops(post.where("field = ''"), whole["a"] or 0.0))
    return SearchIndex(docs, post, stats, of_docs, highest, n, whole["a"] or 0.0, whole["t"] or 0.0, whole["m"] or 0, print_)


def build_index(docs: DataFrame, stopwords: frozenset[str] = STOPWORDS, form: str = "NFC", strict: bool = True) -> SearchIndex:
    """Indexes ``doc_id, title, text`` (see ``documents``). With ``strict`` an id that occurs twice
    raises DuplicateDocument; otherwise the row of greatest title and text is taken. An empty table
    makes an empty index."""
    if strict:
        twice = docs.groupBy("doc_id").count().where("count > 1").limit(1).collect()
        if twice:
            raise DuplicateDocument(f"document {twice[0]['doc_id']} occurs {twice[0]['count']} times")
    else:
        one = docs.groupBy("doc_id").agg(F.max(F.struct("title", "text")).alias("d"))
        docs = one.select("doc_id", "d.title", "d.text")
    raw = keep(postings(docs, stopwords, form))
    post = keep(laid_out(raw))
    drop_kept(raw)
    return from_tables(docs, post, fingerprint(stopwords, form))


def derive_stopwords(index: SearchIndex, threshold: float = 0.5) -> DataFrame:
    """``term, df`` of the terms at least this share of the documents hold, those of fields too;
    none if there are no documents."""
    least = threshold * index.document_count
    return index.term_stats.where((F.col("df") >= least) & F.lit(index.document_count > 0)).select(qualified(F.col("field"), F.col("term")).alias("term"), "df")
