"""Command line: ``index CORPUS OUTPUT`` and ``search INDEX QUERY``. Exit codes: 0 found, 1 none, 2
bad input."""

from __future__ import annotations

import argparse
import json
import logging
import shutil
import sys

from pyspark.sql import SparkSession

from . import __version__
from .operators.engine import Searcher
from .operators.match import QueryTooExpensive, parse
from .operators.metrics import JsonLines
from .operators.present import cut_short, json_lines, passage_lines, result_lines, suggest, visible
from .operators.store import AnalyzerMismatch, ManifestFormatError, SegmentStore
from .sources.pages import read_dump, read_pages, write_pages

FOUND, NONE, BAD = 0, 1, 2


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillon")
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("index", help="index a corpus of page records")
    build.add_argument("corpus")
    build.add_argument("output")
    make = commands.add_parser("corpus", help="make a corpus from an encyclopedia dump")
    make.add_argument("dump")
    make.add_argument("output")
    make.add_argument("--limit", type=int)
    find = commands.add_parser("search", help="search an index")
    find.add_argument("index")
    find.add_argument("query")
    find.add_argument("--limit", type=int, default=10)
    find.add_argument("--scorer", choices=("tfidf", "bm25", "bm25f"), default="tfidf")
    find.add_argument("--no-snippet", action="store_true")
    find.add_argument("--json", action="store_true")
    find.add_argument("--log", action="store_true", help="JSON lines on stderr, without the query")
    return top


def index_corpus(spark: SparkSession, corpus: str, output: str) -> int:
    store = SegmentStore(spark, output)
    store.upsert(read_pages(spark, corpus))
    opened = store.open()
    print(f"indexed {opened.document_count} documents, {opened.term_stats.where('field = ' + repr('')).count()} distinct terms -> {output}")
    return FOUND


def make_corpus(spark: SparkSession, dump: str, output: str, limit: int | None = None) -> int:
    articles = read_dump(spark, dump)
    print(f"{write_pages(articles if limit is None else articles.limit(limit), output)} articles -> {output}")
    return FOUND


def search(spark: SparkSession, path: str, text: str, limit: int = 10, scorer: str = "tfidf", snippet: bool = True, as_json: bool = False) -> int:
    searcher = Searcher(SegmentStore(spark, path), scorer)
    index = searcher.index
    rows = searcher.search(text, limit)
    if not rows:
        missing = sorted({t for t in parse(text).terms if not index.document_frequency(t)})
        for term in missing:
            near = [r["candidate"] for r in suggest(index, spark.createDataFrame([(term,)], "term string")).orderBy("distance", "candidate").collect()]
            if near:
                print(f"no {term}; did you mean {', '.join(near)}?", file=sys.stderr)
        return NONE
    if as_json:
        print("\n".join(json_lines(rows)))
        return FOUND
    if not snippet:
        print("\n".join(result_lines(rows)))
        return FOUND
    columns = shutil.get_terminal_size().columns
    for r in rows:
        print(f"{r.rank:>3}. {r.score:.4f}  {cut_short(visible(r.title) or 'document ' + str(r.doc_id), columns - 14)}")
        print("\n".join(passage_lines(r.passage, r.highlights, columns, sys.stdout.isatty())))
    return FOUND


def main(arguments: list[str] | None = None) -> int:
    options = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    try:
        if options.command == "index":
            return index_corpus(spark, options.corpus, options.output)
        if options.command == "corpus":
            return make_corpus(spark, options.dump, options.output, options.limit)
        if options.log:
            handler = logging.StreamHandler()
            handler.setFormatter(JsonLines(redact=True))
            logging.getLogger("quillon").addHandler(handler)
            logging.getLogger("quillon").setLevel(logging.INFO)
        return search(spark, options.index, options.query, options.limit, options.scorer, not options.no_snippet, options.json)
    except (QueryTooExpensive, AnalyzerMismatch, ManifestFormatError, json.JSONDecodeError, OSError) as error:
        print(error, file=sys.stderr)
        return BAD
    except Exception as error:
        if "page record has no <id>" in str(error) or "PATH_NOT_FOUND" in str(error):
            print(str(error).splitlines()[0], file=sys.stderr)
            return BAD
        raise


if __name__ == "__main__":
    sys.exit(main())
