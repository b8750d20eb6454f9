"""Problem 9."""

import numpy as np
import pytest

from quillon.llm.boosting import Boosted, isotonic
from quillon.llm.reading import FEATURES, bands, features, reading_levels, sentences, train


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("It is a dog. It is approx. 2.5 m long! Is it (e.g. a cat)?", 3),
        ("As vol. 5, p. 37 says, it is. See No. 4, vol. II of it.", 2),
        ("Dr. J. Smith went. He\nwrapped a line.", 2),
        ("no end here", 1),
        ("文です。次です。", 2),
        ("He said \"stop.\" Then he went.", 2),
        ("... !!", 0),
        ("", 0),
        ("fish, etc. and more. Cats etc. They ran.", 3),
    ],
)
def test_sentences(text, n):
    assert len(sentences(text)) == n


def test_features():
    n, sentence, term, row = features(["The cat sat. The dog ran off.", "It was fun"])
    assert (n, round(sentence, 3)) == (10, round(10 / 3, 3))
    assert len(row) == len(FEATURES) and np.isfinite(row).all()
    assert features([]) == (0, 0.0, 0.0, [0.0] * len(FEATURES))
    assert np.isfinite(features(["one"])[3]).all()


def test_boosting_learns_and_calibration_rises():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = np.where(x[:, 0] > 0, 2.0, 0.0) + x[:, 1] * (x[:, 2] > 0) + rng.normal(scale=0.1, size=2000)
    fitted = Boosted().fit(x[:1500], y[:1500])
    rest = y[1500:] - fitted.predict(x[1500:])
    assert rest.var() < 0.15 * y[1500:].var()
    at, value = isotonic(rng.normal(size=300), rng.normal(size=300))
    assert (np.diff(value) >= 0).all() and (np.diff(at) >= 0).all()
    flat = Boosted().fit(np.zeros((5, 2)), np.ones(5))
    assert flat.predict(np.zeros((3, 2))).tolist() == pytest.approx([1, 1, 1])


def test_the_error_is_of_sources_nothing_was_fitted_to():
    """Grades that follow the source alone cannot be told for a source held out: no better than the mean."""
    rng = np.random.default_rng(5)
    sources = [f"s{i % 40}" for i in range(1200)]
    x = rng.normal(size=(1200, 4))
    y = np.array([1.0 + hash_ % 5 for hash_ in (int(s[1:]) * 7 for s in sources)]) + 0.01 * x[:, 0]
    judged = train(x, y, sources, judged=True)
    assert len(judged.folds) == 4
    assert all(error > 0.9 * mean for _, _, error, mean, _ in judged.folds)
    told = train(np.c_[x, y], y, sources, judged=True)
    assert all(error < 0.2 * mean and together > 0.95 for _, _, error, mean, together in told.folds)


def test_few_labels():
    assert train(np.zeros((0, 3)), np.zeros(0), [])(np.zeros((2, 3))).tolist() == [3.0, 3.0]
    assert train(np.zeros((2, 3)), np.array([4.0, 5.0]), ["a", "b"])(np.zeros((1, 3))).tolist() == [4.5]


EASY = "The cat sat on a mat. The dog ran to it. She saw a red bird. He fed the hen. "
HARD = "Notwithstanding considerable heterogeneity, methodological interpretation fundamentally necessitates multidimensional classification whereby contemporaneous institutional representation approximates epistemological correspondence, thereby transforming comparative generalisation into probabilistic normalisation of systematic configuration. "


def test_levels_and_bands(spark):
    docs, labels = [], []
    for i in range(120):
        easy = i % 2
        docs.append((i, (EASY if easy else HARD) * 4, "en", f"s{i % 7}", 1.0))
        labels += [(i, 1 if easy else 5, "r1"), (i, 1 if easy else 5, "r1"), (i, None, "r2"), (i, 9, "r3")]
    docs += [(200, EASY, "en", None, 1.0), (201, HARD * 4, "fr", "x", 1.0), (202, "<p>" + EASY * 4, "en", "x", 1.0), (203, None, "en", "x", 1.0), (204, "", None, None, None), (None, EASY * 4, "fr", "x", 1.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, level double").repartition(3)
    of = spark.createDataFrame(labels, "doc_id long, level int, rater string")
    levels, known = reading_levels(df, of, "doc_id", "text")
    rows = {r["doc_id"]: r for r in levels.collect()}
    assert len(rows) == len(docs) and rows[203]["level"] is None and rows[202]["pieces"] > 0
    assert rows[1]["level"] < 2 and rows[0]["level"] > 4
    assert known.folds == []
    _, judged = reading_levels(df, of, "doc_id", "text", judged=True)
    assert sum(n for _, n, *_ in judged.folds) == 120 and all(e < 0.5 < mean for _, _, e, mean, _ in judged.folds)
    found = {r["doc_id"]: r["band"] for r in bands(levels, "doc_id").collect()}
    assert found == {i: "easy" if i % 2 else "hard" for i in range(120)}
    none, _ = reading_levels(df.limit(0), of, "doc_id", "text")
    assert none.count() == 0


@pytest.mark.parametrize("level", [1, 5])
def test_bands_without_a_model(spark, tmp_path, level):
    """Under 50 rated documents give one grade, which leaves out neither band."""
    from quillon.llm.queries import QUERIES

    docs = [(i, (EASY if i % 2 else HARD) * 4, "en", "s") for i in range(8)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, level, "r") for i in range(8)], "doc_id long, level int, rater string").write.parquet(f"{tmp_path}/reading_labels.parquet")
    assert {r["level"] for r in QUERIES["p9_levels"](spark, str(tmp_path)).collect()} == {float(level)}
    found = {r["doc_id"]: r["band"] for r in QUERIES["p9_found"](spark, str(tmp_path)).collect()}
    assert found == {i: "easy" if i % 2 else "hard" for i in range(8)}
