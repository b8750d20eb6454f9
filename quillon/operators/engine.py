"""One open store, asked one query at a time: the interactive way in.

Many queries at once go through ``match`` and ``rank`` directly; this is for a user who waits.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .index import SearchIndex, StaleIndex
from .match import MOST_COST, MOST_TERMS, execute, parse, parsed, refuse_expensive
from .metrics import MISSING, REGISTRY, LruCache, Registry, correlated, counted_get, result_key, timed_query
from .present import snippets
from .rank import Ranker
from .store import SegmentStore

LOG = logging.getLogger("quillon")


@dataclass(frozen=True)
class Result:
    rank: int
    doc_id: int
    score: float
    title: str
    passage: str
    highlights: tuple[tuple[int, int], ...]


class Searcher:
    """Searches a store as it was when it was opened.

    A query is refused, matched, ranked and shown; results are kept by generation, so a change of the
    store never shows old ones. After a change by any writer a search raises StaleIndex until
    ``reopen``.
    """

    def __init__(self, store: SegmentStore, scorer: str = "tfidf", synonyms: DataFrame | None = None, kept: int = 256, registry: Registry = REGISTRY) -> None:
        self.store, self.scorer, self.synonyms, self.registry = store, scorer, synonyms, registry
        self.ranker = Ranker(scorer)
        self.queries, self.results = LruCache(kept), LruCache(kept)
        self.index: SearchIndex
        self.reopen()

    def reopen(self) -> None:
        self.store.manifest = self.store.on_disk()
        self.index = self.store.open()
        self.registry.gauge("segments_open", "Segments of the open index.").value = len(self.store.manifest.segments)
        self.registry.gauge("documents_open", "Documents of the open index.").value = self.index.document_count

    def check(self) -> None:
        now = self.store.on_disk().generation
        if now != self.index.generation:
            raise StaleIndex(f"opened at generation {self.index.generation}, the store is at {now}")

    def search(self, text: str, limit: int = 10, permit=None, most_terms: int = MOST_TERMS, most_cost: int = MOST_COST) -> list[Result]:
        """The best documents with their passages, at most ``limit``. What is permitted is no part of
        the key of kept results, so with ``permit`` nothing is kept."""
        with correlated(), timed_query(self.registry):
            self.check()
            if counted_get(self.queries, text, "parse", self.registry) is MISSING:
                self.queries.put(text, parse(text))
            key = result_key(self.index.generation, text, limit, self.scorer)
            found = counted_get(self.results, key, "result", self.registry) if permit is None else MISSING
            if found is MISSING:
                refuse_expensive(self.index, text, most_terms, most_cost)
                found = self._ranked(text, limit, permit)
                if permit is None:
                    self.results.put(key, found)
            if not found:
                self.registry.counter("query_zero_results_total", "Queries that found nothing.").increment()
            LOG.info("search", extra={"fields": {"query": text, "scorer": self.scorer, "limit": limit, "results": len(found)}})
            return list(found)

    def _ranked(self, text: str, limit: int, permit) -> tuple[Result, ...]:
        spark = self.store.spark
        q = parsed(spark.createDataFrame([(text,)], "query string"))
        scored = self.ranker.candidates(self.index, q, execute(self.index, q, synonyms=self.synonyms), permit=permit).cache()
        try:
            self.registry.counter("documents_scored_total", "Documents scored.").increment(scored.count())
            rows = snippets(self.ranker.best(scored, limit), self.index).orderBy("rank").collect()  # at most limit
        finally:
            scored.unpersist()
        return tuple(Result(r["rank"], r["doc_id"], r["score"], r["title"], r["passage"], tuple((h["start"], h["end"]) for h in r["highlights"])) for r in rows)
