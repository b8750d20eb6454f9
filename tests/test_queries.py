"""Registered core queries against their SQL, over the smallest test tables where these exist."""

import glob
import os

import pytest

from quillon.plans.core import QUERIES
from quillon.plans.sql import ORACLES

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


def compare(spark, query, sql):
    df = query(spark, DATA)
    columns = sorted(df.columns)
    found = plain(tuple(r[c] for c in columns) for r in df.collect())
    expected = database().execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert found == plain(expected)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == {"snippet"}
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_snippets_show_the_query(spark):
    for r in QUERIES["snippet"](spark, DATA).collect():
        for span in filter(None, r["highlights"].split(",")):
            a, b = map(int, span.split("-"))
            assert 0 <= a < b <= len(r["passage"])


def test_suggestions_of_all_terms(spark, tmp_path):
    """Against every term by ``edit_distance``, over terms of other letters."""
    from quillon.operators.present import edit_distance
    from quillon.plans.core import _queries, index_of

    texts = ["café caffe cafés naïve", "наука наука науки", "cafe nave naive", "φως φωτα зима", "gaugе gauge", "caxy kafe"]
    docs = [(i, f"t{i}", t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, title string, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(q, 0, 1) for q in ("cafè", "науке", "naïv", "φωσ", "gauge", "зимы", "日本")]
    spark.createDataFrame(asked, "query string, doc_id long, grade int").write.parquet(f"{tmp_path}/qrels.parquet")
    known = {r["term"]: r["df"] for r in index_of(spark, str(tmp_path)).term_stats.where("field = ''").collect()}
    terms = {r["term"] for r in _queries(spark, str(tmp_path)).collect()}
    terms |= {f"x{t}q" for t in terms if len(t) > 3}
    expected = set()
    for t in terms - set(known):
        near = sorted((edit_distance(t, c), -n, c) for c, n in known.items())
        expected |= {(t, c, d, -n) for d, n, c in [x for x in near if x[0] <= 2][:3]}
    found = [tuple(r) for r in QUERIES["suggest"](spark, str(tmp_path)).select("term", "candidate", "distance", "df").collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert {("xgaugq", "gaugе"), ("науке", "наука"), ("cafè", "café")} <= {(t, c) for t, c, _, _ in found}
