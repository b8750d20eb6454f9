import bz2
import gzip

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions.analysis import analyze
from quillon.operators.components import components
from quillon.operators.metrics import MISSING, Histogram, LruCache, MetricError, Registry, correlated, timed_query
from quillon.sources.pages import read_dump, read_pages, write_pages
from quillon.sources.small import JudgementFormatError, SynonymFormatError, merged, parse_judgements, parse_synonyms, synonym_table
from quillon.sources.synthetic import zipf_corpus
from quillon.sources.wikitext import clean_wikitext, plain_text

PAGE = "<page>\n <title>Inverted index</title>\n <ns>0</ns>\n <id>42</id>\n <revision><id>99</id>\n <text xml:space=\"preserve\">An '''inverted''' [[a|index]] &amp;lt; {{x{{y}}}} maps.</text></revision>\n</page>"
OTHERS = "<page><title>R</title><ns>0</ns><id>43</id><redirect title='x' /><text>#REDIRECT [[x]]</text></page><page><title>Talk</title><ns>1</ns><id>44</id><text>t</text></page><page><id>45</id><text>{{only}}</text></page>"


def test_pages(spark, tmp_path):
    path = tmp_path / "c.xml"
    path.write_text("junk<page><id>1</id><title> A &amp; B </title><text>x &lt; y </text></page>\n<page><id>2</id></page><page><id>3</id><title>cut")
    rows = {r["doc_id"]: (r["title"], r["text"]) for r in read_pages(spark, str(path)).collect()}
    assert rows[1] == ("A & B", "x < y ") and rows[2] == ("", "")
    assert 3 not in rows
    bad = tmp_path / "bad.xml"
    bad.write_text("<page><title>none</title></page>")
    with pytest.raises(Exception, match="no <id>"):
        read_pages(spark, str(bad)).collect()


def test_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a <b>", "x & y"), (2, None, "z"), (3, "t", "")], "doc_id long, title string, text string")
    assert write_pages(docs, str(tmp_path / "out")) == 3
    back = {tuple(r) for r in read_pages(spark, str(tmp_path / "out")).collect()}
    assert back == {(1, "a <b>", "x & y"), (2, "", "z"), (3, "t", "")}


@pytest.mark.parametrize("kind", ["xml", "gz", "bz2"])
def test_dump(spark, tmp_path, kind):
    data = (PAGE + OTHERS).encode()
    path = tmp_path / ("d.xml" if kind == "xml" else f"d.xml.{kind}")
    path.write_bytes({"xml": lambda b: b, "gz": gzip.compress, "bz2": bz2.compress}[kind](data))
    rows = read_dump(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [(42, "Inverted index", "An inverted index < maps.")]


def test_a_page_that_writes_of_redirects_is_kept(spark, tmp_path):
    path = tmp_path / "d.xml"
    path.write_text(
        "<page><title>Wiki</title><id>7</id><text>An article that explains how #redirect lines work in a wiki.</text></page>"
        "<page><title>R</title><id>8</id><redirect title='x'/><text>Body</text></page><page><title>N</title><id>9</id><ns> 0 </ns><text>&lt;redirect /&gt; is a tag</text></page>"
        "<page><title>E</title><id>10</id><text/></page><page><title>X</title><id>a</id><text>no number</text></page>"
    )
    assert {r["doc_id"] for r in read_dump(spark, str(path)).collect()} == {7, 9}


def test_wikitext_of_any_depth():
    for opening, inner, closing in (("{{", "x|", "}}"), ("{|", " a ", "|}"), ("<ref>", "n", "</ref>")):
        assert plain_text("kept " + (opening + inner) * 300 + closing * 300 + " end") == "kept end"
    assert plain_text("[[a|" * 50 + "label" + "]]" * 50) == "label"
    assert plain_text(None) == "" and plain_text(" \x85 ") == ""
    # a text of nothing but signs takes time in proportion to its length
    for sign in ("{{", "[[", "]]", "<!--", "{|", "[http://x ", "<ref>", "|"):
        plain_text(sign * 50_000)


@given(st.text(alphabet="ab{}[]|<>!-=' \n", max_size=80))
def test_wikitext_ends_and_only_loses_text(text):
    assert sum(map(plain_text(text).count, "ab")) <= sum(map(text.count, "ab"))


def test_wikitext(spark):
    text = "== Head ==\nA<!-- c --><ref name=x>r</ref> b<ref/> {| t |} [[T|label]] [http://x.y site] ''i'' &amp; <br> end"
    row = spark.createDataFrame([(text,)], "t string").select(clean_wikitext(F.col("t")).alias("c")).first()
    assert row["c"] == "Head A b label site i & end"


def test_judgements():
    assert parse_judgements(["# c", "", '{"query": "a", "judgements": [[1, 2], [2, 0]]}']) == [("a", 1, 2), ("a", 2, 0)]
    for bad in ("x", "[]", '{"query": " ", "judgements": []}', '{"query": "a", "judgements": 1}', '{"query": "a", "judgements": [[true, 1]]}', '{"query": "a", "judgements": [[1, -1]]}', '{"query": "a", "judgements": [[1, 1], [1, 2]]}'):
        with pytest.raises(JudgementFormatError, match="line 2"):
            parse_judgements(["# ok", bad])


def test_synonyms(spark):
    groups = parse_synonyms(["laptop, notebook", "# x", "", "notebook, computer"])
    assert groups["laptop"] == {"laptop", "notebook", "comput"}
    for bad in ("laptop", "big laptop, notebook", "laptop, laptops"):
        with pytest.raises(SynonymFormatError):
            parse_synonyms([bad])
    pairs = spark.createDataFrame([("Car", "automobile"), ("car", "vehicle"), ("", "x"), (None, "y")], "term string, member string")
    rows = {tuple(r) for r in synonym_table(pairs).collect()}
    assert (analyze("car")[0], analyze("vehicle")[0]) in rows and (analyze("automobile")[0], analyze("vehicle")[0]) in rows
    assert {tuple(r) for r in synonym_table(pairs, most=1).collect()} == rows


def test_synonyms_beyond_the_driver(spark):
    """A long chain and many small groups, closed in exchanges, against the closure on the driver."""
    chain = [(f"link{i}", f"link{i + 1}") for i in range(30)]
    others = [(f"w{i}", f"v{i % 7}") for i in range(40)]
    pairs = spark.createDataFrame([*chain, *others, ("two words", "w1"), ("The", "w2")], "term string, member string")
    expected = {(t, m) for t, group in merged([(analyze(a)[0], analyze(b)[0]) for a, b in chain + others]).items() for m in group if m != t}
    assert {tuple(r) for r in synonym_table(pairs, most=10).collect()} == expected


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (4, 4), (None, 5), (3, 2)], "v long, u long")
    assert {tuple(r) for r in components(edges).collect()} == {(2, 1), (3, 1), (9, 8)}
    path = spark.createDataFrame([(i + 1, i) for i in range(64)], "v long, u long")
    assert {r["root"] for r in components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(path, rounds=1)
    assert components(path.where("false")).count() == 0


def test_zipf(spark):
    rows = zipf_corpus(spark, 200, words=100, vocabulary=1000, spread=0.5)
    assert {tuple(r) for r in rows.collect()} == {tuple(r) for r in zipf_corpus(spark, 200, words=100, vocabulary=1000, spread=0.5).repartition(3).collect()}
    words = [w for r in rows.collect() for w in r["text"].split()]
    first, tenth = words.count("w1"), sum(words.count(f"w{i}") for i in range(10, 20)) / 10
    assert 6 < first / tenth < 22
    sizes = [len(r["text"].split()) for r in rows.collect()]
    assert min(sizes) >= 50 and max(sizes) <= 150 and max(sizes) - min(sizes) > 60


def test_metrics():
    registry = Registry()
    with pytest.raises(RuntimeError), timed_query(registry):
        raise RuntimeError
    assert registry.counter("query_errors_total").value == 1
    h = Histogram("h", "x", (1.0, 2.0))
    assert h.quantile(0.5) == 0.0
    for v in (0.5, 1.5, 9):
        h.observe(v)
    assert h.quantile(0.5) == 2.0 and h.quantile(1) == float("inf")
    assert 'le="+Inf"} 3' in "\n".join(h.expose())
    with pytest.raises(MetricError):
        registry.gauge("queries_total")
    assert "# TYPE queries_total counter" in registry.render()
    cache = LruCache(1)
    cache.put("a", 1)
    cache.put("b", 2)
    assert cache.get("a") is MISSING and cache.get("b") == 2 and cache.hit_rate == 0.5
    with pytest.raises(ValueError):
        LruCache(0)
    with correlated("x") as identifier:
        assert identifier == "x"
