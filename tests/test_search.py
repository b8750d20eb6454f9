import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import evaluate as ev
from quillon.operators.index import DuplicateDocument, StaleIndex, blocks, build_index, derive_stopwords, documents, is_field_term, laid_out, postings
from quillon.operators.match import Query, QueryTooExpensive, execute, match_phrase, parse, parsed, query_cost, refuse_expensive, refused, segment_query
from quillon.operators.present import best_window, edit_distance, extract, snippets, suggest, visible
from quillon.operators.prune import rank_pruned
from quillon.operators.rank import Ranker, cosine, document_vector, minimum_span, narrowest, score_bm25, score_bm25f, top_k

# A corpus of five documents and the published scores of its ranking.
RANKING = {
    1: "the computer science department teaches computer science",
    2: "a short note about computers",
    3: "science journal about biology and chemistry",
    4: "computer computer computer computer computer",
    5: "unrelated text about gardening",
}
PHRASES = {
    1: "The granite bridge toll rose again",
    2: "A bridge and granite pillars were drawn",
    3: "The toll of granite bridge is low",
    4: "Willows line a quiet harbour",
    5: "granite bridge granite bridge",
}


def make(spark, corpus, titles=None):
    rows = [(i, (titles or {}).get(i, ""), t) for i, t in corpus.items()]
    return build_index(documents(spark.createDataFrame(rows, "doc_id long, title string, text string")))


def asked(spark, *texts):
    return parsed(spark.createDataFrame([(t,) for t in texts], "query string"))


@pytest.fixture(scope="module")
def ranking(spark):
    return make(spark, RANKING)


def best(df):
    return [(r["doc_id"], round(r["score"], 4)) for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("computer science", [(1, 0.6778), (4, 0.4869), (3, 0.2687), (2, 0.1042)]),
        ("computer", [(4, 1.0), (1, 0.33), (2, 0.2139)]),
        ("science", [(1, 0.592), (3, 0.3076)]),
        ("about", [(2, 0.2139), (5, 0.1802), (3, 0.1715)]),
        ("gardening", [(5, 0.5679)]),
    ],
)
def test_tfidf(spark, ranking, text, expected):
    assert best(Ranker().rank(ranking, asked(spark, text))) == expected


def test_bm25_of_a_single_worded_document(spark, ranking):
    scores = dict(best(Ranker("bm25").rank(ranking, asked(spark, "computer science"))))
    assert scores[4] == 0.9505
    assert round(scores[4] / scores[1], 2) == 0.52


def test_fields(spark):
    index = make(spark, {1: "apples grow", 2: "apples apples grow", 3: ""}, {1: "apples", 2: "pears", 3: "none"})
    q = asked(spark, "apples")
    same = {r["doc_id"]: r["score"] for r in score_bm25f(index, q, weights={"": 1.0}).collect()}
    plain = {r["doc_id"]: r["score"] for r in score_bm25(index, q).collect()}
    assert same == pytest.approx(plain)
    zero = {r["doc_id"]: r["score"] for r in score_bm25f(index, q, weights={"": 1.0, "title": 0.0}).collect()}
    assert zero == pytest.approx(plain)
    assert best(Ranker("bm25f").rank(index, q))[0][0] == 1
    with pytest.raises(ValueError):
        Ranker("bm25f", proximity=True).scores(index, q)
    assert is_field_term("title:appl") and not is_field_term("appl")
    assert index.document_length(1) == 3 and index.document_frequency("appl", "title") == 1


def test_index_of_empty_and_repeated_documents(spark):
    empty = build_index(documents(spark.createDataFrame([], "doc_id long, title string, text string")))
    assert empty.document_count == 0 and empty.vocabulary_size() == 0
    assert derive_stopwords(empty).count() == 0
    assert Ranker("bm25").rank(empty, asked(spark, "x y")).count() == 0
    twice = spark.createDataFrame([(1, "a", "b"), (1, "a", "c"), (None, "x", "y")], "doc_id long, title string, text string")
    with pytest.raises(DuplicateDocument):
        build_index(documents(twice))
    one = build_index(documents(twice), strict=False)
    assert one.document_count == 1 and one.contains(1) and not one.contains(2)
    with pytest.raises(StaleIndex):
        one.checked(empty)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("computer", Query(("comput",), (0,), False)),
        ('"computer science"', Query(("comput", "scienc"), (0, 1), True)),
        ('"the computer science"', Query(("comput", "scienc"), (1, 2), True)),
        ("", Query((), (), False)),
        ('""', Query((), (), True)),
        ('"', Query((), (), False)),
        ('computer "science"', Query(("comput", "scienc"), (0, 1), False)),
    ],
)
def test_parse(text, expected):
    assert parse(text) == expected


def test_phrases(spark):
    index = make(spark, PHRASES)
    q = asked(spark, '"granite bridge"', '"toll of granite"', '"bridge granite"', '"granite"', "granite harbour")
    found = {(r["query"], r["doc_id"]) for r in execute(index, q).collect()}
    assert {d for t, d in found if t == '"granite bridge"'} == {1, 3, 5}
    assert {d for t, d in found if t == '"toll of granite"'} == {3}
    # a gap takes any stopword, and only one
    assert {d for t, d in found if t == '"bridge granite"'} == {5}
    assert {d for t, d in found if t == '"granite"'} == {1, 2, 3, 5}
    assert {d for t, d in found if t == "granite harbour"} == {1, 2, 3, 4, 5}
    assert match_phrase(index, q.where("false")).count() == 0


def test_every_span_of_a_document_is_found_as_a_phrase(spark):
    rng = random.Random(3)
    corpus = {i: " ".join(rng.choice("ash birch cedar elm fir".split()) for _ in range(rng.randint(2, 9))) for i in range(12)}
    index = make(spark, corpus)
    texts = []
    for i, t in corpus.items():
        w = t.split()
        a = rng.randrange(len(w) - 1)
        texts.append((i, '"' + " ".join(w[a : a + rng.randint(1, 3)]) + '"'))
    found = {(r["query"], r["doc_id"]) for r in execute(index, asked(spark, *{t for _, t in texts})).collect()}
    assert all((t, i) in found for i, t in texts)


def test_cost(spark, ranking):
    row = query_cost(ranking, asked(spark, "computer computer science nothing")).first()
    assert (row["terms"], row["cost"]) == (4, 5)
    refuse_expensive(ranking, "computer science")
    with pytest.raises(QueryTooExpensive):
        refuse_expensive(ranking, "computer", most_cost=2)
    with pytest.raises(QueryTooExpensive):
        refuse_expensive(ranking, " ".join(["computer"] * 33))


def test_permit_comes_before_the_limit(spark, ranking):
    allowed = spark.createDataFrame([(2,), (3,)], "doc_id long")
    assert best(Ranker().rank(ranking, asked(spark, "computer science"), k=1, permit=allowed))[0][0] == 3
    assert best(Ranker().rank(ranking, asked(spark, "computer science"), k=1, permit=F.col("doc_id") == 2))[0][0] == 2


def test_top_k_limits(spark, ranking):
    scored = Ranker().scores(ranking, asked(spark, "computer science"))
    assert top_k(scored, 0).count() == 0
    assert top_k(scored, 2).count() == 2


def brute_span(lists):
    flat = sorted(p for x in lists for p in x)
    spans = [b - a + 1 for a in flat for b in flat if b >= a and all(any(a <= p <= b for p in x) for x in lists)]
    return min(spans) if spans else None


def test_span(spark):
    assert narrowest([[0, 10, 20], [11], [21]]) == 11
    assert narrowest([[1], []]) is None and narrowest([]) is None
    rng = random.Random(1)
    for _ in range(200):
        lists = [sorted(rng.sample(range(20), rng.randint(1, 5))) for _ in range(rng.randint(1, 4))]
        assert narrowest(lists) == brute_span(lists)
    index = make(spark, {1: "alpha x beta", 2: "alpha beta", 3: "alpha"})
    rows = {r["doc_id"]: r["span"] for r in minimum_span(index, asked(spark, "alpha beta")).collect()}
    assert rows == {1: 3, 2: 2}
    raised = {r["doc_id"]: r["score"] for r in Ranker("bm25", proximity=True).scores(index, asked(spark, "alpha beta")).collect()}
    plain = {r["doc_id"]: r["score"] for r in score_bm25(index, asked(spark, "alpha beta")).collect()}
    assert raised[2] == pytest.approx(plain[2] * 1.3) and raised[1] == pytest.approx(plain[1] * 1.2) and raised[3] == pytest.approx(plain[3])


def test_pruned_equals_full(spark):
    rng = random.Random(7)
    words = ["common"] * 30 + ["middle"] * 6 + ["rare", "scarce"]
    corpus = {i * 3: " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for i in range(150)}
    index = make(spark, corpus)
    q = asked(spark, "common rare", "middle scarce common", "rare", "nowhere", "common")
    full = {(r["query"], r["rank"], r["doc_id"]) for r in Ranker("bm25").rank(index, q, k=3).collect()}
    pruned, scored = rank_pruned(index, q, k=3)
    assert {(r["query"], r["rank"], r["doc_id"]) for r in pruned.collect()} == full
    held = {r["query"]: r["scored"] for r in scored.collect()}
    assert all(held.get(t, 0) <= 150 for t in ("common rare", "rare"))
    with pytest.raises(ValueError):
        rank_pruned(index, q, k=0)


def test_blocks(spark):
    index = make(spark, {i: "word" for i in range(300)})
    rows = blocks(index.postings).orderBy("block_no").collect()
    assert [(r["block_no"], r["document_count"], r["last_document"]) for r in rows] == [(0, 128, 127), (1, 128, 255), (2, 44, 299)]


def test_vectors(spark, ranking):
    v = document_vector(ranking)
    for r in v.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect():
        assert r["n"] == pytest.approx(1.0)
    pairs = spark.createDataFrame([(1, 4), (4, 5)], "doc_id_a long, doc_id_b long")
    found = {(r[0], r[1]): r[2] for r in cosine(v, pairs).select("doc_id_a", "doc_id_b", "cosine").collect()}
    assert found[(1, 4)] == pytest.approx(0.33, abs=1e-3) and found[(4, 5)] == 0


def test_pruning_drops_documents_of_frequent_terms_only(spark):
    """Only the few documents of the rare term can reach the threshold; permits and limits beyond the
    kept impacts give the full scan's result too."""
    rng = random.Random(11)
    corpus = {i * 300: "common " * rng.randint(1, 3) + "filler " * rng.randint(5, 20) + ("rare rare rare" if i % 20 == 0 else "") for i in range(200)}
    index = make(spark, corpus)
    q = asked(spark, "common rare")
    best_of = lambda df: [(r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.orderBy("rank").collect()]
    pruned, scored = rank_pruned(index, q, k=3)
    assert best_of(pruned) == best_of(Ranker("bm25").rank(index, q, k=3))
    assert scored.first()["scored"] <= 10
    for k, permit in ((100, None), (3, F.col("doc_id") % 7 == 0), (150, F.col("doc_id") > 3000)):
        assert best_of(rank_pruned(index, q, k=k, permit=permit)[0]) == best_of(Ranker("bm25").rank(index, q, k=k, permit=permit))


def test_windows(spark):
    terms = "a b c a d e b a".split()
    rng = random.Random(4)
    for _ in range(100):
        rng.shuffle(terms)
        width, wanted = rng.randint(1, 9), set(rng.sample("abcdez", 2))
        scores = []
        for end in range(len(terms)):
            window = [t for t in terms[max(0, end - width + 1) : end + 1] if t in wanted]
            scores.append((len(set(window)), len(window)))
        top = max(scores)
        first = max(0, scores.index(top) - width + 1) if top > (0, 0) else 0
        assert best_window(terms, wanted, width) == (first, *top)


def test_suggestions_equal_brute_force(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(150)}
    index = make(spark, {i: w for i, w in enumerate(sorted(words))})
    known = {r["term"] for r in index.term_stats.where("field = ''").collect()}
    unknown = {"".join(rng.choice("abéz") for _ in range(rng.randint(1, 8))) for _ in range(40)} - known
    found = {(r["term"], r["candidate"], r["distance"]) for r in suggest(index, spark.createDataFrame([(t,) for t in unknown], "term string"), limit=1000).collect()}
    assert found == {(t, c, edit_distance(t, c)) for t in unknown for c in known if edit_distance(t, c) <= 2}


def test_refused(spark, ranking):
    rows = {r["query"]: r["reason"] for r in refused(ranking, asked(spark, "computer", "computer science note", "gardening"), most_terms=2, most_cost=2).collect()}
    assert rows == {"computer": "cost", "computer science note": "terms"}


def test_a_hot_term_is_spread(spark):
    """Postings of a term of most documents lie in many partitions of the layout."""
    docs = documents(spark.createDataFrame([(i, "", f"hot own{i}") for i in range(4000)], "doc_id long, title string, text string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join what is as small as here
    try:
        spread = laid_out(postings(docs, fields=False)).withColumn("p", F.spark_partition_id())
        held = [r["n"] for r in spread.where("term = 'hot'").groupBy("p").agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(held) == 4000 and len(held) > 1 and max(held) < 3000


def test_very_long_texts_keep_their_places(spark):
    text = " ".join(f"w{i}" for i in range(300_000))
    rows = postings(documents(spark.createDataFrame([(1, "", text)], "doc_id long, title string, text string")), fields=False)
    assert rows.where("term = 'w299999'").first()["positions"] == [299999]
    assert rows.agg(F.max("length"), F.count("*")).first()[:] == (300_000, 300_000)


def test_snippets(spark, ranking):
    s = extract("Intro here. Apples are red. Pears are green. End.", "pears", width=2)
    assert s.text == "Apples are red. Pears are green." and s.highlights == ((16, 21),)
    assert extract("One. Two pears. Three.", "pears", width=1).text == "Two pears."
    assert extract("nothing of it", "zebra").text == "nothing of it"
    assert extract("", "x").text == "" and extract("!!!", "x").text == "!!!"
    with pytest.raises(ValueError):
        extract("a", "a", width=0)
    shown = snippets(Ranker().rank(ranking, asked(spark, "science"), k=1), ranking).first()
    text = shown["passage"]
    assert [text[h["start"] : h["end"]] for h in shown["highlights"]] == ["science", "science"]
    assert visible("a\x1b[1mb\n") == "a [1mb "


def test_suggestions(spark, ranking):
    found = [r["candidate"] for r in suggest(ranking, spark.createDataFrame([("scienx",), ("comput",)], "term string")).collect()]
    assert found == ["scienc"]
    assert edit_distance("kitten", "sitting") == 3 and edit_distance("", "éa") == 2
    assert suggest(ranking, spark.createDataFrame([("scienx",)], "term string"), limit=0).count() == 0


def test_segmented_queries():
    assert segment_query("an Old Stone Bridge toll", {"old stone", "old stone bridge"}) == ["an", '"Old Stone Bridge"', "toll"]
    assert segment_query("", {"a b"}) == []


def test_measures(spark):
    run = spark.createDataFrame([("a", 1, 1), ("a", 2, 3), ("a", 3, 2), ("b", 1, 9)], "query string, rank int, doc_id long")
    rels = ev.clean_judgements(spark.createDataFrame([("A ", 1, 1), ("a", 2, 2), ("b", 5, 1), ("c", 1, 1), ("c", 2, -1), ("c", 3, None), ("a", 3, 0)], "query string, doc_id long, grade int"))
    value = lambda df: {r["query"]: r["value"] for r in df.collect()}
    assert value(ev.average_precision(run, rels)) == pytest.approx({"a": 5 / 6, "b": 0, "c": 0})
    assert value(ev.reciprocal_rank(run, rels)) == pytest.approx({"a": 1, "b": 0, "c": 0})
    gain = (1 + 2 / math.log2(4)) / (2 + 1 / math.log2(3))
    assert value(ev.ndcg(run, rels)) == pytest.approx({"a": gain, "b": 0, "c": 0})
    rows = {r["query"]: (r["precision"], r["recall"]) for r in ev.precision_recall_at_k(run, rels, 2).collect()}
    assert rows == {"a": (0.5, 0.5), "b": (0.0, 0.0), "c": (0.0, 0.0)}
    assert ev.summary(run, rels).first()["map"] == pytest.approx(5 / 18)
    assert ev.sign_test([1, 1, 1], [0, 0, 1]) == 0.5 and ev.sign_test([1], [1]) == 1.0
    assert ev.permutation_test([1, 1], [1, 1], 100) == 1.0
    law = ev.heaps_law(spark.createDataFrame([(float(n), 3 * n**0.5) for n in (10, 100, 1000)], "tokens double, vocabulary double")).first()
    assert (law["exponent"], law["factor"]) == pytest.approx((0.5, 3.0))
