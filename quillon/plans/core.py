"""Queries of the core operators, over whole tables.

The index of a data folder is built by the first query that needs it and kept in the shared folder
for the session, as an index is: built once, queried often.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import CJK, STOPWORDS, stem_column, tokens_column
from ..operators import evaluate as ev
from ..operators import rank as rk
from ..operators.index import SearchIndex, blocks, build_index, derive_stopwords, documents, postings
from ..operators.match import execute, expand, match_any, match_phrase, parsed, query_cost, refused
from ..operators.present import snippet_windows, snippets, suggest
from ..operators.prune import rank_pruned as pruned
from ..operators.prune import upper_bounds
from ..operators.store import SegmentStore, text_export, text_import
from ..sources.pages import articles as of_articles
from ..sources.pages import dump_lines, read_dump, read_pages, write_pages
from ..sources.small import judgements as load_judgements
from ..sources.small import synonym_table
from ..sources.small import synonyms as load_synonyms
from ..sources.wikitext import clean_wikitext
from ..streaming.changes import apply_changes, current, rebuilt
from ..streaming.ingest import ingest, read_stream
from .tables import cut, shared_path, signature, spread, table

_BUILT: dict[tuple, SearchIndex] = {}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(documents(table(spark, sf_dir, "documents")))


def index_of(spark: SparkSession, sf_dir: str) -> SearchIndex:
    at = (spark.sparkContext.applicationId, sf_dir, *signature(spark, f"{sf_dir}/documents.parquet"))
    if at not in _BUILT:
        _BUILT[at] = build_index(_docs(spark, sf_dir))
    return _BUILT[at]


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.clean_judgements(table(spark, sf_dir, "qrels"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judged queries, parsed once."""
    return cut(parsed(_judged(spark, sf_dir).select("query").distinct()))


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queries as phrases."""
    quoted = _judged(spark, sf_dir).select("query").distinct().withColumn("text", F.concat(F.lit('"'), "query", F.lit('"')))
    return cut(parsed(quoted, "query", "text"))


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return docs.select("doc_id", tokens_column(F.concat_ws(" ", "title", "text")).alias("tokens"))


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(spark, sf_dir).select("doc_id", F.posexplode("tokens").alias("position", "token"))


def token_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = _content(spark, sf_dir).join(langs, "doc_id").select("lang", F.explode("tokens").alias("token"))
    counts = rows.groupBy("lang", "token").agg(F.count("*").alias("n"))
    return counts.groupBy("lang").agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct_tokens"))


def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(spark, sf_dir).where(~F.col("token").isin(sorted(STOPWORDS)))


def cjk_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(spark, sf_dir).where(F.col("token").rlike(f"[{CJK}]")).groupBy("token").agg(F.count("*").alias("n"))


def stem_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(spark, sf_dir).select("token").distinct().select("token", stem_column(F.col("token")).alias("stem"))


def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = postings(_docs(spark, sf_dir), fields=False)
    return made.select("doc_id", F.explode("positions").alias("position"), "term")


def all_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).postings.drop("length").withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).term_stats


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).doc_stats.select("doc_id", "length", "title_length")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = index_of(spark, sf_dir)
    return i.doc_stats.agg(F.count("*").alias("documents"), F.round(F.avg("length"), 6).alias("average_length"), F.round(F.avg("title_length"), 6).alias("average_title"), F.min("length").alias("shortest"))


def common_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_stopwords(index_of(spark, sf_dir), 0.25)


def parse_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark, sf_dir)


def match_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _queries(spark, sf_dir)
    one = q.groupBy("query").agg(F.count("*").alias("n")).where("n = 1").select("query")
    return match_any(index_of(spark, sf_dir), q.join(one, "query", "left_semi"))


def match_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute(index_of(spark, sf_dir), _queries(spark, sf_dir))


def match_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_phrase(index_of(spark, sf_dir), _phrases(spark, sf_dir))


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_cost(index_of(spark, sf_dir), _queries(spark, sf_dir))


def _ranked(ranker: rk.Ranker) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ranker.rank(index_of(spark, sf_dir), _queries(spark, sf_dir)).withColumn("score", F.round("score", 6))

    return run


rank_bm25 = _ranked(rk.Ranker("bm25"))


def rank_permitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = table(spark, sf_dir, "documents").where("lang = 'en' AND source <> 'atlas-core'").select("doc_id")
    return rk.Ranker("bm25").rank(index_of(spark, sf_dir), _queries(spark, sf_dir), permit=allowed).withColumn("score", F.round("score", 6))


def rank_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, _ = pruned(index_of(spark, sf_dir), _queries(spark, sf_dir))
    return best.withColumn("score", F.round("score", 6))


def minimum_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.minimum_span(index_of(spark, sf_dir), _queries(spark, sf_dir))


def bm25_upper_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upper_bounds(index_of(spark, sf_dir)).withColumn("bound", F.round("bound", 6))


def postings_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(index_of(spark, sf_dir).postings)


def document_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.document_vector(index_of(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


def cosine_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of documents judged best for the same query."""
    best = _judged(spark, sf_dir).where("grade = 3")
    pairs = best.select("query", F.col("doc_id").alias("doc_id_a")).join(best.select("query", F.col("doc_id").alias("doc_id_b")), "query").where("doc_id_a < doc_id_b")
    return rk.cosine(rk.document_vector(index_of(spark, sf_dir)), pairs).withColumn("cosine", F.round("cosine", 6))


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_bm25(spark, sf_dir)


def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev.precision_recall_at_k(_run(spark, sf_dir), _judged(spark, sf_dir))
    return rows.select("query", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def _measure(how) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return how(_run(spark, sf_dir), _judged(spark, sf_dir)).withColumn("value", F.round("value", 6))

    return run


def map_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev.summary(cut(_run(spark, sf_dir)), cut(_judged(spark, sf_dir)))
    return rows.select("queries", *[F.round(c, 6).alias(c) for c in ("map", "mrr", "ndcg", "precision")])


def _asked(terms: DataFrame) -> DataFrame:
    """Query terms, and misspelt ones made of them."""
    return terms.union(terms.where(F.length("term") > 3).select(F.concat(F.lit("x"), "term", F.lit("q")).alias("term")))


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For all query terms the index lacks and for misspelt ones, of the whole vocabulary."""
    return suggest(index_of(spark, sf_dir), _asked(_queries(spark, sf_dir).select("term").distinct()))


def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = snippets(rank_bm25(spark, sf_dir), index_of(spark, sf_dir))
    marks = F.array_join(F.transform("highlights", lambda h: F.concat_ws("-", h["start"], h["end"])), ",")
    return shown.select("query", "rank", "doc_id", "title", "passage", marks.alias("highlights"))


def snippet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippet_windows(rank_bm25(spark, sf_dir), index_of(spark, sf_dir))


def gap_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the first run of term, stopword, term of each evaluation text, as a phrase:
    any stopword may stand in the gap."""
    stop = F.array(*map(F.lit, sorted(STOPWORDS)))
    tokens = table(spark, sf_dir, "eval_items").select(tokens_column(F.col("text")).alias("t")).where("size(t) > 2")
    runs = F.filter(F.transform(F.sequence(F.lit(1), F.size("t") - 2), lambda i: F.slice("t", i, 3)), lambda r: F.array_contains(stop, r[1]) & ~F.array_contains(stop, r[0]) & ~F.array_contains(stop, r[2]))
    asked = tokens.select(F.array_join(F.get(runs, F.lit(0)), " ").alias("query")).where("query IS NOT NULL").distinct()
    q = parsed(asked.withColumn("text", F.concat(F.lit('"'), "query", F.lit('"'))), "query", "text")
    return match_phrase(index_of(spark, sf_dir), cut(q))


def refused_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refused(index_of(spark, sf_dir), _queries(spark, sf_dir), most_terms=2, most_cost=100)


def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of BM25 against tf-idf."""
    rels = cut(_judged(spark, sf_dir))
    values = [ev.average_precision(_ranked(rk.Ranker(n))(spark, sf_dir), rels) for n in ("bm25", "tfidf")]
    return ev.paired_sign_test(*values).withColumn("probability", F.round("probability", 6))


def synonym_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text with every query term's synonyms."""
    groups = synonym_table(table(spark, sf_dir, "synonyms"))
    q = expand(_queries(spark, sf_dir).where("NOT is_phrase"), groups)
    return match_any(index_of(spark, sf_dir), q)


def synonym_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synonym_table(table(spark, sf_dir, "synonyms"))


def _store(spark: SparkSession) -> SegmentStore:
    return SegmentStore(spark, shared_path(spark, f"store-{uuid.uuid4().hex}"))


def merge_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as four segments, which merge into one: the same statistics as of one index."""
    store, docs = _store(spark), _docs(spark, sf_dir)
    for part in range(4):
        store.upsert(docs.where(F.pmod("doc_id", F.lit(4)) == part))
    return store.open().term_stats


def directory_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segments, the second replacing documents of the first, and one language deleted."""
    store, docs = _store(spark), _docs(spark, sf_dir)
    store.upsert(docs.withColumn("text", F.concat(F.lit("stale "), "text")), merge=False)
    store.upsert(docs, merge=False)
    store.delete(table(spark, sf_dir, "documents").where("lang = 'fr'").select("doc_id"), merge=False)
    return store.open().term_stats.where("field = ''").select("term", "df")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, with the current state of the change log written over them."""
    store = _store(spark)
    store.upsert(_docs(spark, sf_dir))
    store.upsert(rebuilt(spark, f"{sf_dir}/wal_records.parquet").withColumnRenamed("document_id", "doc_id"))
    return store.table("docs").select("doc_id", "title", "text")


def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of files into a store: the same statistics as of one index."""
    path = shared_path(spark, f"store-{uuid.uuid4().hex}")
    ingest(documents(read_stream(spark, f"{sf_dir}/documents.parquet", 4)), path, f"{path}-checkpoint").awaitTermination()
    return SegmentStore(spark, path).open().term_stats


def index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the document field, written as lines of text and read again."""
    path = shared_path(spark, f"lines-{uuid.uuid4().hex}")
    text_export(index_of(spark, sf_dir).postings).write.text(path)
    return text_import(spark.read.text(path)).drop("field").withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


def dump_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of a dump: no redirects, no other name spaces, something left of their wikitext."""
    return of_articles(table(spark, sf_dir, "articles")).select("revision_id", "article_id", "title")


def dump_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All revisions written as pages of a dump, and its articles read again."""
    path = shared_path(spark, f"dump-{uuid.uuid4().hex}")
    rows = table(spark, sf_dir, "articles").where("revision_id IS NOT NULL").withColumnRenamed("article_id", "page_id")
    dump_lines(rows).write.text(path)
    return read_dump(spark, path).select("doc_id", "title")


def wiki_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constructed pages of wikitext, cleaned."""
    pages = spark.createDataFrame(list(enumerate(WIKITEXT, 1)), "page int, wikitext string")
    return pages.select("page", clean_wikitext(F.col("wikitext")).alias("text"))


def corpus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as page records, and read again."""
    path = shared_path(spark, f"corpus-{uuid.uuid4().hex}")
    write_pages(_docs(spark, sf_dir), path)
    return read_pages(spark, path)


def judgement_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judgements written as a file of JSON lines, and loaded from it."""
    path = shared_path(spark, f"judgements-{uuid.uuid4().hex}")
    of_query = _judged(spark, sf_dir).where("query <> ''").groupBy("query").agg(F.sort_array(F.collect_list(F.array("doc_id", F.col("grade").cast("long")))).alias("judgements"))
    of_query.select(F.to_json(F.struct("query", "judgements"))).write.text(path)
    return load_judgements(spark, path)


def synonym_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonyms written as lines of a file, a pair of single words of two terms a line, and loaded
    from it."""
    path = shared_path(spark, f"synonyms-{uuid.uuid4().hex}")
    word = lambda c: F.filter(tokens_column(F.col(c)), lambda t: ~t.isin(sorted(STOPWORDS)))
    pairs = table(spark, sf_dir, "synonyms").select("term", "member", word("term").alias("x"), word("member").alias("y")).where("size(x) = 1 AND size(y) = 1")
    pairs = pairs.where(stem_column(F.col("x")[0]) != stem_column(F.col("y")[0]))
    pairs.select(F.concat_ws(", ", "term", "member")).write.text(path)
    return load_synonyms(spark, path)


#: Wikitext as pages have it, whole and broken.
WIKITEXT = [
    "The ''mill'' of [[Orvane]] stands by the '''[[river Tal|Tal]]'''.",
    "{{Infobox mill|name={{nowrap|Orvane {{circa|1640}}}}|height={{convert|12|m}}}}It has two floors.",
    "{|class=x\n|-\n| old {|\n| inner\n|}\n|}\nAfter the table.",
    "Corn<ref>Hale, p. 4</ref> was ground<ref name=\"h\" /> until 1901.<REF name=z>see\nHale</REF>",
    "== The wheel ==\nIt turned.\n=== Gear ===\nOf oak.",
    "[[File:mill.jpg|thumb|left|The mill near [[Tal bridge|the bridge]] in May]]Seen from the east.",
    "See [https://mill.example/x the survey] and [https://mill.example/plain].",
    "Rye &lt; wheat &amp;amp; barley&nbsp;&mdash; all <br/>ground <span class=\"n\">here</span>.",
    "<!-- hidden {{a}} -->Open<!-- never closed",
    "An article that explains how #redirect lines work in a wiki.",
    "{{cut off|[[Orvane|the mill]] and more",
    "a }} b ]] c |} d </ref> e",
    "{{" * 40 + "deep" + "}}" * 40 + " shallow",
    "3 < 4 and 5 > 2, so x = y = z",
    "It is the miller's, not the ''bakers''.",
    "{{{1|default}}} and {{a|{{{2}}}}} end",
    "[[a {{b ]] c }} d",
    "plain text\n\twith  gaps",
    "",
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tokenize": tokenize,
    "token_counts_by_lang": token_counts_by_lang,
    "stopword_filter": stopword_filter,
    "cjk_bigrams": cjk_bigrams,
    "stem_vocabulary": stem_vocabulary,
    "analyze": analyze,
    "postings": all_postings,
    "term_stats": term_stats,
    "doc_lengths": doc_lengths,
    "corpus_stats": corpus_stats,
    "derive_stopwords": common_terms,
    "parse_queries": parse_queries,
    "match_word": match_word,
    "match_any": match_free,
    "match_phrase": match_quoted,
    "query_cost": costs,
    "rank_tfidf": _ranked(rk.Ranker("tfidf")),
    "rank_bm25": rank_bm25,
    "rank_bm25f": _ranked(rk.Ranker("bm25f")),
    "rank_bm25_permit": rank_permitted,
    "rank_bm25_proximity": _ranked(rk.Ranker("bm25", proximity=True)),
    "rank_pruned": rank_pruned,
    "minimum_span": minimum_span,
    "bm25_upper_bounds": bm25_upper_bounds,
    "postings_blocks": postings_blocks,
    "document_vector": document_vector,
    "cosine_judged": cosine_judged,
    "precision_recall_at_k": precision_recall,
    "average_precision": _measure(ev.average_precision),
    "mrr": _measure(ev.reciprocal_rank),
    "ndcg": _measure(ev.ndcg),
    "map_summary": map_summary,
    "suggest": suggestions,
    "snippet": snippet,
    "snippet_window": snippet_window,
    "match_phrase_with_stopword_gap": gap_phrases,
    "refused_queries": refused_queries,
    "sign_test": sign_test,
    "ingest_stream": ingest_stream,
    "index_text": index_text,
    "dump_pages": dump_pages,
    "wiki_clean": wiki_clean,
    "corpus_pages": corpus_pages,
    "judgement_file": judgement_file,
    "synonym_file": synonym_file,
    "synonym_groups": synonym_groups,
    "synonym_match": synonym_match,
    "merge_segments": merge_segments,
    "directory_df": directory_df,
    "upsert_latest": upsert_latest,
    "dump_articles": dump_articles,
}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt(spark, f"{sf_dir}/wal_records.parquet").select("document_id", "generation", "seq")


def p4_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt(spark, f"{sf_dir}/wal_records.parquet").select("document_id", "title", "text")


def p4_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in 24 files in no order, in micro-batches of four files: late and repeated records
    meet the state of batches before, and versions are compacted."""
    path = shared_path(spark, f"log-{uuid.uuid4().hex}")
    table(spark, sf_dir, "wal_records").repartition(24, F.xxhash64("generation", "seq", "received_at")).write.parquet(path)
    out = apply_changes(spark, path, f"{path}-out", files_per_batch=4, batches=2)
    return current(spark, out).select("document_id", "generation", "seq")


QUERIES |= {"p4_found": p4_found, "p4_current": p4_current, "p4_replayed": p4_replayed}
