import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions.analysis import analyze, analyze_positioned, analyze_spans, fingerprint, tokenize, tokenize_spans, tokens_column
from quillon.functions.stem import measure, skeleton, stem
from quillon.functions.words import pieces, words


# The examples of Porter (1980).
@pytest.mark.parametrize(
    ("word", "expected"),
    [
        ("tr", 0), ("ee", 0), ("tree", 0), ("y", 0), ("by", 0), ("trouble", 1), ("oats", 1), ("trees", 1), ("ivy", 1),
        ("troubles", 2), ("private", 2), ("oaten", 2), ("orrery", 2),
    ],
)
def test_measure(word, expected):
    assert measure(skeleton(word)) == expected


# The examples of Porter (1980).
@pytest.mark.parametrize(
    ("word", "expected"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
        ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
        ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("fizzed", "fizz"),
        ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"),
        ("vietnamization", "vietnam"), ("radically", "radic"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("goodness", "good"),
        ("adoption", "adopt"), ("replacement", "replac"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"),
        ("roll", "roll"), ("possibly", "possibl"), ("archaeology", "archaeolog"), ("is", "is"), ("computers", "comput"), ("science", "scienc"),
    ],
)
def test_stem(word, expected):
    assert stem(word) == expected


@pytest.mark.parametrize(
    ("word", "expected"),
    [
        ("bridges", "bridg"), ("harvesting", "harvest"), ("shaky", "shaki"), ("quarries", "quarri"), ("willingness", "willing"), ("mapped", "map"),
        ("glorious", "gloriou"), ("dusty", "dusti"), ("organizer", "organ"), ("gardening", "garden"), ("ferries", "ferri"), ("42nd", "42nd"),
    ],
)
def test_stem_of_other_words(word, expected):
    """Derived by hand from the published rules."""
    assert stem(word) == expected


def test_stopwords_leave_gaps_and_go_before_stemming():
    assert analyze_positioned("the department of computer science") == [(1, "depart"), (3, "comput"), (4, "scienc")]
    assert analyze("Cafés running") == ["cafés", "run"]


def test_unspaced_scripts_are_pairs():
    assert tokenize("東京都 ABC東") == ["東京", "京都", "abc", "東"]
    assert [(t, a, b) for t, a, b in tokenize_spans("a 東京都")] == [("a", 0, 1), ("東京", 2, 4), ("京都", 3, 5)]


@given(st.text(max_size=60))
def test_spans_name_what_they_match(text):
    import unicodedata

    normal = unicodedata.normalize("NFC", text)
    assert [t for t, _, _ in tokenize_spans(text)] == tokenize(text)
    for token, a, b in tokenize_spans(text):
        assert 0 <= a < b <= len(normal)
        assert token in normal.lower()
    assert [t for t, _, _ in analyze_spans(text)] == analyze(text)


@given(st.text(alphabet="ab é_1", max_size=80), st.integers(1, 10))
def test_pieces_keep_words(text, size):
    assert "".join(pieces(text, size)) == text
    assert [w for p in pieces(text, size) for w in words(p)] == words(text)


def test_fingerprint_changes_with_the_stopwords():
    assert len(fingerprint()) == 16
    assert fingerprint() != fingerprint(stopwords={"x"})
    assert fingerprint() != fingerprint(form="NFKC")


def test_column_equals_function(spark):
    texts = ["", None, "Hello_World 42", "Été 東京都", "Ångström ΣΣ", "x" * 5000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", tokens_column(F.col("t")).alias("k")).collect()
    assert {r["id"]: r["k"] for r in rows} == {i: tokenize(t) for i, t in enumerate(texts)}
