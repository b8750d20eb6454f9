"""Problems 1 and 3."""

import math
import random
from collections import Counter

import pytest

from quillon.functions.words import words
from quillon.llm import distinctive, frequency
from quillon.llm.distinctive import BM25, TF_IDF, most_distinctive, term_scores
from quillon.llm.frequency import heavy_terms, marked_terms, term_counts

SCHEMA = "doc_id long, title string, text string, term string, documents long"


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(["the"] * 8 + ["of"] * 4 + [f"w{rng.randrange(60)}" for _ in range(8)]) for _ in range(rng.randint(0, 30)))
        rows.append((i, rng.choice([None, "", "The title", "Été"]), rng.choice([text, text, None, ""]), "clash", 5))
    rows.append((n, "x", "w1 " * 3000, None, None))
    rows += rows[:3]  # repeated rows
    return rows


def brute(rows):
    occurrences, holding = Counter(), Counter()
    for _, title, text, *_ in rows:
        found = words(f"{title or ''} {text or ''}")
        occurrences.update(found)
        holding.update(set(found))
    return occurrences, holding


@pytest.mark.parametrize("flush", [5, 1 << 17])
def test_counts(spark, monkeypatch, flush):
    monkeypatch.setattr(frequency, "FLUSH", flush)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    counts, records = term_counts(df, ["title", "text"])
    occurrences, holding = brute(rows)
    assert records == len(rows)
    found = {r["term"]: (r["occurrences"], r["documents"]) for r in counts.collect()}
    assert found == {t: (n, holding[t]) for t, n in occurrences.items()}
    marks = {r["term"]: r["mark"] for r in marked_terms(df, ["title", "text"]).collect()}
    assert marks == {t: "rare" if n <= 2 else "common" if n > 0.4 * len(rows) else None for t, n in holding.items()}


def test_heavy_terms_are_a_matter_of_routing(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert "the" in heavy_terms(df, ["title", "text"])[0]
    occurrences, _ = brute(rows)
    for share in (1.0, 0.02):
        monkeypatch.setattr(frequency, "HEAVY_SHARE", share)
        assert {r["term"]: r["occurrences"] for r in term_counts(df, ["title", "text"])[0].collect()} == dict(occurrences)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(frequency, "PIECE", 50)
    monkeypatch.setattr(distinctive, "PIECE", 50)
    rows = corpus(30)
    df = spark.createDataFrame(rows, SCHEMA)
    occurrences, holding = brute(rows)
    assert {r["term"]: r["documents"] for r in term_counts(df, ["title", "text"])[0].collect()} == dict(holding)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    counts, records = term_counts(df, ["title", "text"])
    assert counts.count() == 0 and records == 0
    assert marked_terms(df, ["text"]).count() == 0
    assert term_scores(df, "doc_id", ["text"]).count() == 0
    assert most_distinctive(df, "doc_id", ["text"]).count() == 0
    none = spark.createDataFrame([(1, None, None, "x", 1)], SCHEMA)
    assert most_distinctive(none, "doc_id", ["title", "text"]).count() == 0


def distinct(rows):
    seen = {}
    for r in rows:
        seen.setdefault(r[0], r)
    return list(seen.values())


@pytest.mark.parametrize("broadcast", [0, 3, 20_000])
def test_scores(spark, monkeypatch, broadcast):
    monkeypatch.setattr(distinctive, "BROADCAST_TERMS", broadcast)
    rows = distinct(corpus(60))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    _, holding = brute(rows)
    n = len(rows)
    tfs = {r[0]: Counter(words(f"{r[1] or ''} {r[2] or ''}")) for r in rows}
    average = sum(c.total() for c in tfs.values()) / n
    expected = {}
    for doc, counts in tfs.items():
        for t, tf in counts.items():
            idf = math.log(1 + (n - holding[t] + 0.5) / (holding[t] + 0.5))
            expected[doc, t] = idf * tf * (BM25.k1 + 1) / (tf + BM25.k1 * (1 - BM25.b + BM25.b * counts.total() / average))
    found = {(r["doc_id"], r["term"]): r["score"] for r in term_scores(df, "doc_id", ["title", "text"]).collect()}
    assert found == pytest.approx(expected)
    for weighting, weight in ((TF_IDF, lambda d, t: tfs[d][t] * math.log(n / holding[t])), (BM25, lambda d, t: expected[d, t])):
        best = {}
        for doc, counts in tfs.items():
            ranked = sorted((-round(weight(doc, t), 6), t) for t in counts if holding[t] >= 2)
            if ranked:
                best[doc] = ranked[0][1]
        top = {r["doc_id"]: r["term"] for r in most_distinctive(df, "doc_id", ["title", "text"], weighting=weighting).collect()}
        assert top == best
