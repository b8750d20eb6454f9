import pathlib
import random
import shutil
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillon.cli import index_corpus, search
from quillon.operators.engine import Searcher
from quillon.operators.index import StaleIndex, build_index, documents
from quillon.operators.match import QueryTooExpensive, parsed
from quillon.operators.metrics import Registry
from quillon.operators.present import cut_short, folded, passage_lines
from quillon.operators.rank import Ranker
from quillon.plans.tables import drop_kept, keep, one_machine, shared_dir
from quillon.operators.store import AnalyzerMismatch, IndexWriter, Manifest, ManifestFormatError, Segment, SegmentCorrupt, SegmentFormatError, SegmentStore, select_merge, text_export, text_import, tier_of


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, title string, text string")


def test_any_split_is_one_index(spark, tmp_path):
    rng = random.Random(5)
    rows = {i: (i, "t", " ".join(rng.choice("ash birch cedar elm fir".split()) for _ in range(6))) for i in range(20)}
    store = SegmentStore(spark, str(tmp_path / "s"))
    ids = list(rows)
    store.upsert(frame(spark, [rows[i] for i in ids[:12]]))
    rows[3] = (3, "new", "ash ash ash")
    store.upsert(frame(spark, [rows[i] for i in (3, *ids[12:])]))
    store.delete(spark.createDataFrame([(5,), (999,)], "doc_id long"))
    del rows[5]
    opened = SegmentStore(spark, str(tmp_path / "s")).open()
    whole = build_index(documents(frame(spark, list(rows.values()))))
    assert opened.document_count == whole.document_count == 19
    stats = lambda i: {tuple(r) for r in i.term_stats.select("term", "field", "df", "cf", "max_tf").collect()}
    assert stats(opened) == stats(whole)
    q = parsed(spark.createDataFrame([("ash elm",)], "query string"))
    ranked = lambda i: [(r["doc_id"], round(r["score"], 9)) for r in Ranker("bm25").rank(i, q).orderBy("rank").collect()]
    assert ranked(opened) == ranked(whole)
    assert opened.generation == 3
    lines = [r["value"] for r in text_export(opened.postings).collect()]
    assert any(line.startswith("ash|") for line in lines)


def test_merging(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "m"))
    for i in range(4):
        store.upsert(frame(spark, [(i, "", f"word{i} shared")]))
    assert len(store.manifest.segments) == 1 and store.manifest.segments[0].documents == 4
    names = {p.name for p in (tmp_path / "m").iterdir() if p.name.startswith("segment")}
    assert names == {store.manifest.segments[0].name}
    assert store.open().document_frequency("share") == 4
    store.delete(spark.createDataFrame([(i,) for i in range(4)], "doc_id long"))
    assert store.manifest.segments == () and store.open().document_count == 0


def test_a_segment_no_manifest_names_is_no_part(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "r"))
    store.upsert(frame(spark, [(1, "", "a")]))
    store._write(frame(spark, [(2, "", "b")]), None)  # as after a crash before publication
    again = SegmentStore(spark, str(tmp_path / "r"))
    assert again.open().document_count == 1
    again.upsert(frame(spark, [(3, "", "c")]))
    assert {s.name for s in again.manifest.segments} == {"segment-1", "segment-3"}


def test_verify(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "v"))
    store.upsert(frame(spark, [(1, "", "ash elm"), (2, "", "fir")]), merge=False)
    store.upsert(frame(spark, [(2, "", "oak")]), merge=False)
    store.verify()
    name = store.manifest.segments[-1].name
    path = str(tmp_path / "v" / name / "postings")
    rows = spark.read.parquet(path)
    other = spark.createDataFrame(rows.collect(), rows.schema).withColumn("tf", F.col("tf") + 1)
    other.write.mode("overwrite").parquet(path)
    with pytest.raises(SegmentCorrupt, match=name):
        store.verify()
    other.drop("length").write.mode("overwrite").parquet(path)
    with pytest.raises(SegmentFormatError, match="other columns"):
        store.verify()
    shutil.rmtree(path)
    with pytest.raises(SegmentFormatError, match="has no postings"):
        store.verify()


def test_writer(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "w"))
    with IndexWriter(store, capacity=3) as writer:
        writer.add(1, None, "ash")
        writer.add(2, "t", "elm")
        writer.delete(1)
        assert store.manifest.segments == ()
        writer.add(3, "t", "fir")  # the third document: flushed
        assert {r["doc_id"] for r in store.table("docs").collect()} == {2, 3}
        writer.delete(3)
    assert {r["doc_id"] for r in store.table("docs").collect()} == {2}
    with pytest.raises(ValueError, match="closed"):
        writer.add(4, "", "")


def test_text_round_trip(spark):
    index = build_index(documents(frame(spark, [(1, "", "ash elm ash"), (70_000, "x", "ash"), (3, "", "")])))
    back = text_import(text_export(index.postings)).select("term", "doc_id", "tf", "length", "positions")
    expected = index.postings.where("field = ''").select("term", "doc_id", "tf", "length", "positions")
    assert sorted(map(str, back.collect())) == sorted(map(str, expected.collect()))
    assert text_export(index.postings).where("value LIKE 'ash|%'").count() == 2


def test_searcher(spark, tmp_path):
    store, registry = SegmentStore(spark, str(tmp_path / "q")), Registry()
    store.upsert(frame(spark, [(1, "one", "ash elm"), (2, "two", "elm elm"), (3, "", "fir")]))
    searcher = Searcher(store, "bm25", registry=registry)
    value = lambda name: registry.counter(name).value
    found = searcher.search("elm")
    assert [r.doc_id for r in found] == [2, 1] and found[0].passage == "elm elm" and found[0].highlights == ((0, 3), (4, 7))
    assert searcher.search("elm") == found
    assert (value("result_cache_hits_total"), value("result_cache_misses_total"), value("documents_scored_total")) == (1, 1, 2)
    assert [r.doc_id for r in searcher.search("elm", permit=F.col("doc_id") == 1)] == [1]
    assert searcher.search("nothing") == [] and value("query_zero_results_total") == 1
    with pytest.raises(QueryTooExpensive):
        searcher.search("elm ash fir", most_terms=2)
    assert value("query_errors_total") == 1 and registry.gauge("segments_open").value == 1
    SegmentStore(spark, str(tmp_path / "q")).upsert(frame(spark, [(2, "two", "oak")]))
    with pytest.raises(StaleIndex):
        searcher.search("elm")
    searcher.reopen()
    assert [r.doc_id for r in searcher.search("elm")] == [1]


def test_kept_tables_go(spark):
    df = keep(spark.range(3))
    assert df.count() == 3
    folder = pathlib.Path(df.inputFiles()[0].removeprefix("file://").removeprefix("file:")).parent
    assert folder.exists()
    drop_kept(df)
    assert not folder.exists()


def test_the_shared_folder_of_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return default

    def session(master):
        context = SimpleNamespace(master=master, getConf=lambda: Conf(), _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
        return SimpleNamespace(sparkContext=context, conf=Conf())

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
    assert one_machine(session("local[4]")) and one_machine(session("local"))


def test_manifest():
    m = Manifest(3, 5, segments=(Segment("segment-1", 4, 1, "t"),))
    assert Manifest.load(m.dump()) == m
    for bad in ("{", "{}", '{"format": 9}'):
        with pytest.raises(ManifestFormatError):
            Manifest.load(bad)
    with pytest.raises(AnalyzerMismatch):
        Manifest.load(Manifest(analyzer="other").dump())
    assert [tier_of(n) for n in (0, 3, 4, 15, 16, 64)] == [0, 0, 1, 1, 2, 3]
    assert select_merge(tuple(Segment(f"s{i}", 1) for i in range(3))) == ()


SAMPLE = {
    "computer": "  1. 0.7397  document 2\n",
    "connecting": "  1. 0.4637  document 3\n",
    '"computer science department"': "  1. 0.8541  document 2\n",
}


def test_command_line(spark, tmp_path, capsys):
    pages = [
        (1, "Inverted index", "An inverted index maps each term to the documents and positions where it occurs. It is the data structure that makes keyword search possible at any corpus size."),
        (2, "Computer science", "Computer science is the study of computation. The computer science department teaches algorithms and data structures."),
        (3, "Porter stemmer", "The Porter stemming algorithm reduces inflected words to a common form, so connect and connecting meet on one term."),
        (4, "Gardening", "Gardening involves growing plants in a garden. Roses and tulips are popular flowers."),
        (5, "Term frequency", "Term frequency and inverse document frequency together weight how well a term describes a document. Rare terms weigh more."),
        (6, "Special characters &amp; entities", "An ampersand &amp; a less-than &lt; sign should survive unescaping."),
        (7, "Empty body", ""),
    ]
    corpus = tmp_path / "c.xml"
    corpus.write_text("".join(f"<page><id>{i}</id><title>{t}</title><text>{x}</text></page>\n" for i, t, x in pages))
    out = str(tmp_path / "index")
    assert index_corpus(spark, str(corpus), out) == 0
    assert "indexed 7 documents, 66 distinct terms" in capsys.readouterr().out
    for query, expected in SAMPLE.items():
        assert search(spark, out, query, snippet=False) == 0
        assert capsys.readouterr().out == expected
    assert search(spark, out, "term frequency document", limit=3, snippet=False) == 0
    assert capsys.readouterr().out == "  1. 0.7604  document 5\n  2. 0.1030  document 1\n  3. 0.0347  document 3\n"
    assert search(spark, out, "computr") == 1
    assert "did you mean" in capsys.readouterr().err
    assert search(spark, out, "computer", as_json=True) == 0
    assert '"identifier":2' in capsys.readouterr().out
    assert search(spark, out, "gardening") == 0
    assert "Gardening involves growing plants" in capsys.readouterr().out


def test_terminal_lines():
    text = "one two three\x1b four"
    assert [text[a:b] for a, b in folded(text, 8)] == ["one two", "three\x1b", "four"]
    assert [("abcdefghij")[a:b] for a, b in folded("abcdefghij", 4)] == ["abcd", "efgh", "ij"]
    assert passage_lines("one two three", [(4, 9)], columns=9, colour=True, indent=" ") == [" one \x1b[1mtwo\x1b[0m", " \x1b[1mt\x1b[0mhree"]
    assert "".join(passage_lines("a b", [], 80, False)).strip() == "a b"
    assert cut_short("abcdef", 4) == "abc…" and cut_short("ab", 4) == "ab"
