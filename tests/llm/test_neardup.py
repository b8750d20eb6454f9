"""Problems 6, 7 and 8."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions.words import words
from quillon.llm import neardup
from quillon.llm.leak import leaked
from quillon.llm.neardup import Likeness, groups, near_duplicates, near_pairs
from quillon.llm.oneform import one_form
from quillon.llm.packing import encoding, default_vocabulary, fill, pack, token_sizes, _count_tokens
from quillon.llm import packing

LIKE = Likeness(shingle=3, threshold=0.7, least_terms=10)


def family(seed=4):
    rng = random.Random(seed)
    rows, doc = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(30, 60))]
        for _ in range(rng.randint(1, 5)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = f"z{rng.randrange(99)}"
            rows.append((doc, None, " ".join(text).upper(), 0.5))
            doc += 1
    rows += [(doc, "", "same text " * 8, 0.1), (doc + 1, "same", "text " + "same text " * 7, 0.1), (doc + 2, None, None, 0.2), (doc + 3, "", "short one", 0.2), (None, "", "same text " * 8, 0.0)]
    rows += [(doc + 10 + i, "", "copy " + " ".join(f"c{j}" for j in range(30)), 0.0) for i in range(15)]
    return rows


def brute(rows, like):
    sets = {}
    for doc, title, text, _ in rows:
        t = words(one_form(f"{title or ''} {text or ''}"))
        if doc is not None and len(t) >= max(like.least_terms, like.shingle):
            sets[doc] = {tuple(t[i : i + like.shingle]) for i in range(len(t) - like.shingle + 1)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= like.threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_pairs_and_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(neardup, "BROADCAST_IDS", limit)
    rows = family()
    df = spark.createDataFrame(rows, "doc_id long, title string, text string, size double").repartition(3)
    near = near_duplicates(df, "doc_id", ["title", "text"], LIKE)
    found = [tuple(r) for r in near_pairs(near, "doc_id").select("doc_id_a", "doc_id_b").collect()]
    expected = brute(rows, LIKE)
    assert len(found) == len(set(found)) and set(found) == expected
    if limit:
        of = {r["doc_id"]: r["group"] for r in groups(near, "doc_id").collect()}
        root = {d: d for d in of}
        for _ in range(30):
            for a, b in expected:
                root[a] = root[b] = min(root[a], root[b])
        assert of == root


def test_a_key_of_several_contents_has_one(spark):
    x, y = " ".join(f"x{i}" for i in range(20)), " ".join(f"y{i}" for i in range(20))
    rows = [(1, x), (1, y), (1, y), (2, x), (3, y), (4, x), (5, y)]
    near = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", ["text"], LIKE)
    found = [tuple(r) for r in near_pairs(near, "doc_id").select("doc_id_a", "doc_id_b").collect()]
    assert len(found) == len(set(found))
    assert set(found) in ({(2, 4), (3, 5), (1, 2), (1, 4)}, {(2, 4), (3, 5), (1, 3), (1, 5)})


def test_short_records_have_groups(spark):
    long = " ".join(f"w{i}" for i in range(20))
    rows = [(1, None, None), (2, "", "!!"), (3, "Only", "a title"), (4, "only a", "TITLE"), (5, "a title", "only"), (6, "", long), (7, "", long), (8, "one", None), (6, "", "short"), (9, "", "short"), (None, "", "short"), (9, "", "short")]
    near = near_duplicates(spark.createDataFrame(rows, "doc_id long, title string, text string"), "doc_id", ["title", "text"])
    found = sorted(tuple(r) for r in groups(near, "doc_id").select("doc_id", "group", "links").collect())
    assert found == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 3, 0), (5, 5, 0), (6, 6, 0), (7, 6, 0), (8, 8, 0), (9, 9, 0)]
    assert [tuple(r) for r in near_pairs(near, "doc_id").collect()] == [(6, 7)]


def test_groups_are_whole_or_raise(spark):
    rng = random.Random(2)
    ids = rng.sample(range(1000), 60)
    members = spark.createDataFrame([(i, i) for i in ids], "id long, class long")
    links = spark.createDataFrame([(min(p), max(p), 1.0) for p in zip(ids, ids[1:])], "a long, b long, similarity double")
    near = neardup.Near(members, links, members.limit(0))
    assert {r["group"] for r in groups(near, "doc_id").collect()} == {min(ids)}
    with pytest.raises(RuntimeError):
        groups(near, "doc_id", rounds=1)


def test_no_near_duplicates(spark):
    df = spark.createDataFrame([], "doc_id long, title string, text string")
    near = near_duplicates(df, "doc_id", ["title", "text"])
    assert near_pairs(near, "doc_id").count() == 0 and groups(near, "doc_id").count() == 0


def test_chance_of_a_miss():
    """Of pairs of similarity 0.7 under 1 in 100 may miss each other."""
    like = Likeness()
    assert 2 * (1 - 0.7**like.width) ** like.half < 0.01


def test_minhash_agreement():
    functions = neardup._functions(LIKE)
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = pool[:300], pool[100:]
    same = (neardup.minhashes(a, functions) == neardup.minhashes(b, functions, chunk=7)).mean()
    assert abs(same - 0.5) < 0.17


def test_leaks(spark, monkeypatch):
    rng = random.Random(9)
    words_ = lambda n, p: " ".join(f"{p}{rng.randrange(500)}" for _ in range(n))
    items = [(i, words_(rng.randint(5, 30), "e"), "x") for i in range(20)] + [(20, None, "x"), (21, "", "x")]
    items += [(22, items[6][1], "x"), (None, words_(20, "e"), "x")]
    docs = []
    for d in range(60):
        item = rng.choice(items[:20])[1].split()
        a = rng.randrange(len(item))
        cut = item[a : a + rng.randint(1, 25)]
        docs.append((d, f"{words_(8, 'd')} {' '.join(cut).upper().replace(' ', '-' if d % 2 else ', ')}\n{words_(5, 'd')}", 1))
    docs += [(60, None, 1), (61, "", 1), (None, items[6][1] * 3, 1), (62, items[6][1].replace("e", "е"), 1), (62, items[6][1], 1)]
    expected = set()
    for d, text, _ in docs:
        t = words(one_form(text))
        have = {tuple(t[i : i + 12]) for i in range(len(t) - 11)}
        for i, item, _ in items:
            w = words(one_form(item))
            if d is not None and i is not None and any(tuple(w[j : j + 12]) in have for j in range(len(w) - 11)):
                expected.add((d, i))
    df = spark.createDataFrame(docs, "doc_id long, text string, owner int").repartition(3)
    of = spark.createDataFrame(items, "item_id long, text string, shingle string")
    for bits in (26, 12, 6):
        found = [tuple(r) for r in leaked(df, "doc_id", "text", of, "item_id", "text", bits=bits).select("doc_id", "item_id").collect()]
        assert len(found) == len(set(found)) and set(found) == expected
    assert len(expected) > 5
    assert leaked(df, "doc_id", "text", of.limit(0), "item_id", "text").count() == 0
    assert leaked(df.limit(0), "doc_id", "text", of, "item_id", "text").count() == 0


def test_very_many_windows(spark):
    """300,000 windows of one long item, and documents of them, against plain loops."""
    long = [f"t{(i * 7919) % 300_011}" for i in range(300_011)]
    rng = random.Random(1)
    docs, expected = [], set()
    for d in range(200):
        a, n = rng.randrange(300_000), rng.choice([5, 11, 12, 40])
        docs.append((d, f"x{d} " + " ".join(long[a : a + n]) + f" y{d}"))
        if min(n, 300_011 - a) >= 12:
            expected.add((d, 1))
    found = leaked(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame([(1, " ".join(long)), (2, "a b c")], "item_id long, text string"), "item_id", "text")
    assert {tuple(r) for r in found.collect()} == expected


@pytest.mark.parametrize("hot", [50_000, 100, 0])
def test_a_hot_left_key(spark, hot):
    """10,000 records of one left key; only those that share a pair of keys are candidates."""
    n = 10_000
    rows = [(i, 50 if i % 3 else 80, [7, i + 100], [i // 2, i + 20_000 if i < 10_000 else 0]) for i in range(n)]
    expected = set()
    for i in range(0, n, 2):
        if min(rows[i][1], rows[i + 1][1]) >= 0.8 * max(rows[i][1], rows[i + 1][1]):
            expected.add((i, i + 1))
    df = spark.createDataFrame(rows, "class long, size int, lefts array<long>, rights array<int>")
    found = [tuple(r) for r in neardup._candidates(df, Likeness(), hot).collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_fill(spark):
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([10, 4096, 9000, 0, 2048, 2048, 1365, 1365, 1365, 5000])], "doc_id long, tokens long")
    packed = pack(sizes, "doc_id")
    good = fill(sizes, packed, "doc_id", least=0.5).first()
    assert good[:] == (10, 0, 0, 0, True)
    bad = fill(sizes, packed.withColumn("container", F.lit("one")).where("doc_id != 3"), "doc_id").first()
    assert (bad["overfull"], bad["unequal"]) == (1, 1)
    split = packed.withColumn("part", F.col("part") + F.when(F.col("doc_id") == 0, 1).otherwise(0))
    assert fill(sizes, split, "doc_id").first()["split_needlessly"] == 1
    assert not fill(sizes, packed.withColumn("container", F.concat("container", F.lit("-"), "doc_id", F.lit("-"), "part")), "doc_id", least=0.9).first()["well_filled"]
    assert fill(sizes.limit(0), packed.limit(0), "doc_id").first()[:] == (0, 0, 0, 0, True)


@pytest.mark.parametrize("bucket", [7, 200_000])
def test_packing(spark, monkeypatch, bucket):
    monkeypatch.setattr(packing, "BUCKET_ITEMS", bucket)
    rng = random.Random(3)
    sizes = [(i % 290, rng.choice([0, 1, 3, rng.randint(1, 100), rng.randint(1, 60), 100, 50, rng.randint(90, 350)]), "x") for i in range(300)] + [(None, 40, "x"), (5, None, "x")]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long, bin string")
    rows = pack(df, "doc_id", capacity=100).collect()
    held, of = {}, {}
    for r in rows:
        held[r["container"]] = held.get(r["container"], 0) + r["tokens"]
        of.setdefault(r["doc_id"], []).append(r)
    assert max(held.values()) <= 100
    assert sum(held.values()) == sum(n for _, n, _ in sizes if n)
    assert len(rows) == sum(max(1, -(-n // 100)) for _, n, _ in sizes if n is not None)
    for r in rows:
        assert r["offset"] == 100 * r["part"] and (r["tokens"] <= 100)
    # each class but for one container is full, so little is unused
    total = sum(held.values())
    assert total / (100 * len(held)) > 0.75
    assert pack(df.limit(0), "doc_id").count() == 0
    with pytest.raises(ValueError):
        pack(df, "doc_id", capacity=0)


def test_token_sizes(spark, monkeypatch):
    texts = ["", None, "Hello  world's end, 42 ½\n\n x", "été 東京", "word " * 3000 + "Été, and 12.5 more " * 200]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, tokens int")
    enc = encoding(default_vocabulary())
    expected = {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["tokens"] for r in token_sizes(df, "doc_id", "text").collect()} == expected
    monkeypatch.setattr(packing, "PIECE", 37)
    assert _count_tokens(enc, texts[-1]) == expected[4]
