"""Registered queries of this package: against SQL where there is some, else against plain loops."""

import glob
import math
import os

import pytest

from quillon.functions.words import words
from quillon.llm.oneform import one_form
from quillon.llm.queries import QUERIES
from quillon.llm.sql import ORACLES

DATA = os.environ.get("QUILLON_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def database():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def result(spark, name, *columns):
    rows = [tuple(r[c] for c in columns) for r in QUERIES[name](spark, DATA).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = database().execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(expected)


def documents():
    return database().execute("SELECT doc_id, title, text, lang FROM documents").fetchall()


def test_same_looking(spark):
    expected = set()
    for i, field in ((1, "title"), (2, "text")):
        values = [(d[0], d[i], one_form(d[i])) for d in documents() if d[i]]
        expected |= {(min(a, b), max(a, b), field) for a, x, fx in values for b, y, fy in values if a < b and fx == fy and x != y}
    assert result(spark, "p5_found", "doc_id_a", "doc_id_b", "field") == expected


def test_near_duplicates(spark):
    sets = {}
    for doc, title, text, _ in documents():
        t = words(one_form(f"{title or ''} {text or ''}"))
        if len(t) >= 40:
            sets[doc] = set(zip(t, t[1:], t[2:]))
    expected = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert result(spark, "p6_found", "doc_id_a", "doc_id_b") == expected


def test_leaks(spark):
    windows = lambda t: {tuple(t[i : i + 12]) for i in range(len(t) - 11)}
    items = [(i, windows(words(one_form(t)))) for i, t in database().execute("SELECT item_id, text FROM eval_items").fetchall()]
    expected = {(d, i) for d, _, text, _ in documents() for i, w in items if w & windows(words(one_form(text)))}
    assert result(spark, "p8_found", "doc_id", "item_id") == expected


def test_containers(spark):
    from quillon.llm.packing import default_vocabulary, encoding

    enc = encoding(default_vocabulary())
    sizes = {d: len(enc.encode_ordinary(text or "")) for d, _, text, _ in documents()}
    assert result(spark, "p7_found", "doc_id") == {(d,) for d, n in sizes.items() if n > 4096}
    held = {}
    rows = QUERIES["p7_containers"](spark, DATA).collect()
    for r in rows:
        held[r["container"]] = held.get(r["container"], 0) + r["tokens"]
    assert max(held.values()) <= 4096
    assert sum(held.values()) == sum(sizes.values())
    assert {r["doc_id"] for r in rows} == set(sizes)


def test_markup(spark):
    found = result(spark, "p2_found", "record_kind", "record_id")
    texts = dict(database().execute("SELECT revision_id, text FROM articles").fetchall())
    for revision, text in texts.items():
        if text and ("[[" in text or "{{" in text or "</" in text or "**" in text):
            assert ("article", revision) in found
        if not text or not set(text) & set("<>&[]{}*#_`~=$\\|") and "''" not in text and "\n" not in text:
            assert ("article", revision) not in found


def test_bands_are_those_of_the_features(spark):
    found = result(spark, "p9_found", "doc_id", "band")
    assert {b for _, b in found} <= {"easy", "hard"}
    english = {d[0] for d in documents() if d[3] == "en"}
    assert {d for d, _ in found} <= english
    levels = {r["doc_id"]: r["level"] for r in QUERIES["p9_levels"](spark, DATA).collect()}
    assert all(v is None or 1 <= v <= 5 and math.isfinite(v) for v in levels.values())
    assert len(levels) == len(documents())
