"""Problem 5."""

import itertools

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillon.llm.oneform import connection, form_sql, one_form, same_looking_pairs, unify

SAME = [
    ("Ｈｉ　１", "Hi 1"), ("cafe\u0301", "café"), ("a\u200bb\ufeff\u00ad", "ab"), ("a\u00a0b\u202f\u2007c", "a b  c"), ("non\u2011stop", "non-stop"),
    ("сосна".replace("н", "n"), "cocna"), ("Κalpha", "Kalpha"), ("ｶﾞ", "ガ"), ("\u212b", "Å"), ("\u212a", "K"), ("ﬁn", "fin"), ("Ⅳ", "IV"), ("ё", "ë"), ("е\u200d\u0308", "ë"),
]
APART = [("A", "a"), ("é", "e"), ("ß", "ss"), ("x²", "x2"), ("½", "1/2"), ("a  b", "a b"), ("a\nb", "a b"), ("a’b", "a'b"), ("①", "1"), ("–", "-")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert one_form(a) == one_form(b) == b


@pytest.mark.parametrize(("a", "b"), APART)
def test_apart(a, b):
    assert one_form(a) != one_form(b)


def in_sql(values):
    import pyarrow as pa

    db = connection()
    db.register("given", pa.table({"x": pa.array(values, pa.string())}))
    return [r for (r,) in db.execute(f"SELECT {form_sql('x')} FROM given").fetchall()]


@given(st.lists(st.text(alphabet=st.sampled_from("aе́\u0301\u200b ﬁⅣ\uff9e\uff76\u00a0éё½Å'\\%\n"), max_size=12), max_size=20))
def test_sql_equals_python(values):
    assert in_sql(values) == [one_form(v) for v in values]
    for v in values:
        assert one_form(one_form(v)) == one_form(v)


def test_every_character_alike():
    from quillon.llm.oneform import TABLE

    values = [f"x{c}y" for c in TABLE] + ["", "plain"]
    assert in_sql(values) == [one_form(v) for v in values]


def test_unify_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "Ｈ", None, 9), (1, "Ｈ", None, 9), (2, "", "x" * 10000, None), (3, "\u200b", "é", 1)], "id long, title string, text string, text_form int")
    rows = unify(df, ["title", "text"]).collect()
    assert sorted((r["id"], r["title"], r["title_form"], (r["text_form"] or "")[:3]) for r in rows) == [(1, "Ｈ", "H", ""), (1, "Ｈ", "H", ""), (2, "", "", "xxx"), (3, "\u200b", "", "é")]
    assert unify(df.limit(0), ["title"]).count() == 0


def brute(rows):
    found = set()
    for a, b in itertools.combinations(sorted(rows), 2):
        for i, field in ((1, "title"), (2, "text")):
            x, y = a[i], b[i]
            if x and y and x != y and one_form(x) == one_form(y) and a[0] != b[0]:
                found.add((a[0], b[0], field))
    return found


def test_pairs(spark):
    base = ["Hi 1", "Ｈｉ 1", "Hi\u00a01", "hi 1", "", "\u200b", None, "Нi 1"]
    rows = [(i, base[i % len(base)] or "", base[(i * 3) % len(base)] or "") for i in range(40)]
    df = spark.createDataFrame([(i, t or None, x, "f", "r") for i, t, x in rows] + [(None, "Hi 1", "Hi 1", "f", "r")], "doc_id long, title string, text string, form string, raw string")
    found = [tuple(r) for r in same_looking_pairs(df, "doc_id", ["title", "text"]).select("doc_id_a", "doc_id_b", "field").collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)
    assert same_looking_pairs(df.limit(0), "doc_id", ["title", "text"]).count() == 0
