"""Reading level of each document (problem 9).

Features of length, vocabulary, syntax and cohesion of the prose of every document feed
gradient-boosted regression trees, trained on a bounded sample of rated documents. Predictions for
sources held out of training are calibrated to the raters' scale by an isotonic map. The error that
is reported is that on sources held out of both, training and calibration.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import words
from ..plans.tables import keep
from .arrow import parts, strings
from .boosting import Boosted, isotonic
from .markup import kind, parse
from .oneform import one_form

#: Rated documents used for training at most, chosen by a hash of their id.
TRAINING = 20_000
FOLDS = 4
LEVELS = (1.0, 5.0)

# Abbreviations after which no sentence ends; those of NUMBERED only before a number,
# those of ENDING may end one before a capital.
ABBREVIATIONS = frozenset(
    "e.g i.e cf viz approx ca fig figs eq eqs ed eds ch sec vs dr mr mrs ms prof st rev hon gen col lt sgt capt dept "
    "univ resp incl excl est max min temp bzw z.b d.h u.a ggf evtl ca vgl nr bd hrsg p.ex env éd ej pág págs núm sr sra dra".split()
)
NUMBERED = frozenset("no nos vol vols p pp art para par jan feb mar apr jun jul aug sep sept oct nov dec".split())
ENDING = frozenset("etc al inc ltd co corp jr".split())

_END = re.compile(r"([.!?…]+)([\"'”’»)\]]*)(?=\s|$)|([。！？]+)")
_SUBORDINATE = frozenset(
    "although because whereas whereby which whose whenever insofar notwithstanding considering while if unless though "
    "since that quoique bien lorsque obwohl weil dass während aunque porque mientras".split()
)
_PRONOUNS = frozenset("i you he she it we they him her them us me il elle nous vous ils er sie es wir ihr él ella nosotros ellos".split())


def sentences(prose: str) -> list[str]:
    """The sentences of one paragraph, whose line wraps are spaces. Not parted at abbreviations,
    initials or decimals. What is left at the end is a sentence too, if it holds a term."""
    text = " ".join(prose.split())
    found, start = [], 0
    for m in _END.finditer(text):
        if m[1] and m[1][0] == "." and len(m[1]) == 1:
            before = text[max(start, m.start() - 24) : m.start()]
            word = before[before.rfind(" ") + 1 :].lstrip("([“\"'«")
            low = word.lower()
            after = text[m.end() : m.end() + 2].strip()
            if low in ABBREVIATIONS or (len(word) == 1 and word.isalpha() and word.isupper() and after):
                continue
            if low in NUMBERED and (after[:1].isdigit() or re.match(r"[IVXLC]+\b", text[m.end() :].lstrip())):
                continue
            if low in ENDING and after and not after[0].isupper():
                continue
        found.append(text[start : m.end()])
        start = m.end()
    found.append(text[start:])
    return [s for s in found if any(c.isalnum() for c in s)]


FEATURES = (
    "log_terms", "sentence_mean", "sentence_sd", "sentence_p90", "term_mean", "term_sd", "long_share", "very_long_share",
    "short_share", "variety", "once_share", "commas", "other_signs", "subordinate", "pronouns", "overlap", "new_share",
    "paragraph_terms", "digit_share", "foreign_share",
)


def features(paragraphs: list[str]) -> tuple[int, float, float, list[float]]:
    """Terms, terms a sentence, characters a term, and the features of a document's prose."""
    lengths: list[int] = []
    counts: Counter[str] = Counter()
    overlaps: list[float] = []
    fresh: list[float] = []
    commas = signs = 0
    foreign = False
    before: set[str] = set()
    for paragraph in paragraphs:
        for sentence in sentences(paragraph):
            terms = words(sentence)
            if not terms:
                continue
            lengths.append(len(terms))
            here = {t for t in set(terms) if len(t) > 3}
            if here:
                if before:
                    shared = len(here & before)
                    overlaps.append(shared / (len(here) + len(before) - shared))
                fresh.append(len(here.difference(counts)) / len(here))
                before = here
            counts.update(terms)
            commas += sentence.count(",")
            if not sentence.isascii():
                foreign = True
                commas += sentence.count("、") + sentence.count("，")
            signs += sentence.count(";") + sentence.count(":") + sentence.count("(") + sentence.count(")")
    n = sum(lengths)
    if not n:
        return 0, 0.0, 0.0, [0.0] * len(FEATURES)
    chars = np.fromiter(map(len, counts), dtype=np.int64, count=len(counts))
    weights = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    by_length = np.bincount(np.minimum(chars, 30), weights=weights, minlength=31) / n
    mean = float(chars @ weights) / n
    sd = max(0.0, float((chars * chars) @ weights) / n - mean * mean) ** 0.5
    k = len(lengths)
    per = n / k
    spread = max(0.0, sum(x * x for x in lengths) / k - per * per) ** 0.5
    row = [
        math.log(n), per, spread, float(sorted(lengths)[round(0.9 * (k - 1))]), mean, sd, float(by_length[7:].sum()), float(by_length[11:].sum()),
        float(by_length[:4].sum()), len(counts) / n**0.5, int((weights == 1).sum()) / len(counts), commas / k, signs / k,
        sum(map(counts.__getitem__, _SUBORDINATE)) / n, sum(map(counts.__getitem__, _PRONOUNS)) / n, sum(overlaps) / len(overlaps) if overlaps else 0.0,
        sum(fresh) / len(fresh) if fresh else 0.0, n / max(1, len(paragraphs)), sum([w for t, w in counts.items() if t[0] <= "9"]) / n,
        sum([w for t, w in counts.items() if not t.isascii()]) / n if foreign else 0.0,
    ]
    return n, per, mean, row


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch, "text"):
            rows: list[tuple] = []
            for text in strings(part, "text"):
                form = one_form(text)
                blocks, pieces = parse(form)
                n, sentence, term, values = features([x for t, x in blocks if kind(t) in ("p", "li", "quote")])
                rows.append((pieces, n, sentence, term, values))
            pieces, n, sentence, term, values = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    part.column("lang"),
                    part.column("source"),
                    pa.array(pieces, pa.int32()),
                    pa.array(n, pa.int64()),
                    pa.array(sentence, pa.float64()),
                    pa.array(term, pa.float64()),
                    pa.array(values, pa.list_(pa.float64())),
                ],
                names=["id", "lang", "source", "pieces", "terms", "sentence_terms", "term_chars", "features"],
            )


def profiles(docs: DataFrame, key: str, text: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """``id, lang, source, pieces, terms, sentence_terms, term_chars, features`` of every document."""
    src = docs.select(F.col(key).cast("long").alias("id"), F.col(lang).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))
    return src.mapInArrow(_profile, "id long, lang string, source string, pieces int, terms long, sentence_terms double, term_chars double, features array<double>")


@dataclass
class Grader:
    """A trained model with its calibration and its error on held-out sources."""

    model: Boosted | None
    knots: tuple[np.ndarray, np.ndarray]
    mean: float
    #: fold, documents, mean absolute error, that of the mean grade, correlation; only if judged
    folds: list[tuple[int, int, float, float, float]]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.model is None:
            return np.full(len(x), self.mean)
        return np.clip(np.interp(self.model.predict(x), *self.knots), *LEVELS)


def _fold(source: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(source) % FOLDS


def _calibrated(x: np.ndarray, y: np.ndarray, folds: np.ndarray) -> tuple[Boosted, tuple[np.ndarray, np.ndarray]]:
    """Trees on all rows, and the map from what trees say of sources they never saw to the grades."""
    held = np.full(len(y), y.mean())
    for k in range(FOLDS):
        out = folds == k
        if out.any() and (~out).sum() >= 20:
            held[out] = Boosted().fit(x[~out], y[~out]).predict(x[out])
    return Boosted().fit(x, y), isotonic(held, y)


def train(x: np.ndarray, y: np.ndarray, sources: list[str], judged: bool = False) -> Grader:
    """Trees on all rows, calibrated by what trees that never saw a row's source said of it. With
    ``judged`` also the error on sources that neither trees nor calibration saw: for each fold of
    sources both are made anew from the others. Under 50 rated documents the grade is their mean,
    without any the middle of the scale."""
    mean = float(y.mean()) if len(y) else sum(LEVELS) / 2
    if len(y) < 50:
        return Grader(None, (np.zeros(1), np.zeros(1)), mean, [])
    folds = np.array([_fold(s) for s in sources])
    errors = []
    for k in range(FOLDS if judged else 0):
        out = folds == k
        if not out.any() or (~out).sum() < 50:
            continue
        model, knots = _calibrated(x[~out], y[~out], folds[~out])
        graded = np.clip(np.interp(model.predict(x[out]), *knots), *LEVELS)
        together = float(np.corrcoef(graded, y[out])[0, 1]) if graded.std() > 0 and y[out].std() > 0 else 0.0
        errors.append((k, int(out.sum()), float(np.abs(graded - y[out]).mean()), float(np.abs(y[~out].mean() - y[out]).mean()), together))
    return Grader(*_calibrated(x, y, folds), mean, errors)


def grader(profiled: DataFrame, labels: DataFrame, key: str, level: str = "level", rater: str = "rater", judged: bool = False) -> Grader:
    """Trains on the mean level of each rated document, repeated ratings of a rater counting once.
    Null levels and levels off the scale are no ratings."""
    rated = labels.select(F.col(key).cast("long").alias("id"), F.col(level).cast("double").alias("level"), F.coalesce(F.col(rater).cast("string"), F.lit("")).alias("rater"))
    rated = rated.where(F.col("level").between(*LEVELS) & F.col("id").isNotNull()).distinct()
    rated = rated.groupBy("id").agg(F.avg("level").alias("level"))
    sample = profiled.where("terms > 0").select("id", "source", "features").join(rated, "id")
    rows = sample.orderBy(F.xxhash64("id"), "id").limit(TRAINING).collect()
    x = np.array([r["features"] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return train(x, np.array([r["level"] for r in rows], dtype=float), [r["source"] for r in rows], judged)


def reading_levels(docs: DataFrame, labels: DataFrame, key: str, text: str, judged: bool = False) -> tuple[DataFrame, Grader]:
    """``<key>, level, lang, source, pieces, terms, sentence_terms, term_chars`` of every document,
    and the grader.

    A text without terms has a null level. A null language or source passes through (the source as
    the empty string); a null key stays null; repeated rows stay repeated; an empty table gives no
    rows.
    """
    profiled = keep(profiles(docs, key, text))
    known = grader(profiled, labels, key, judged=judged)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("features").to_pylist(), dtype=float).reshape(batch.num_rows, len(FEATURES))
            graded = shared.value(x)
            none = batch.column("terms").to_numpy(zero_copy_only=False) == 0
            names = ["id", "lang", "source", "pieces", "terms", "sentence_terms", "term_chars"]
            arrays = [batch.column(c) for c in names]
            arrays.insert(1, pa.array(graded, pa.float64(), mask=none))
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "level", *names[1:]])

    schema = f"`{key}` long, level double, lang string, source string, pieces int, terms long, sentence_terms double, term_chars double"
    return profiled.mapInArrow(run, schema), known


def bands(levels: DataFrame, key: str, lang: str = "en", least: int = 40, graded: bool = True) -> DataFrame:
    """``<key>, band``: plain prose of one language that is clearly ``easy`` or ``hard``: graded on
    that half of the scale, and short or long in sentences and terms. Where no model was trained
    (``graded`` is false) all levels are the same, and sentences and terms decide alone."""
    low, high = LEVELS
    middle = (low + high) / 2
    easy = ((F.col("level") < middle + 0.5) | F.lit(not graded)) & (F.col("sentence_terms") < 10) & (F.col("term_chars") < 4.8)
    hard = ((F.col("level") > middle - 0.5) | F.lit(not graded)) & (F.col("sentence_terms") > 22) & (F.col("term_chars") > 6)
    of = levels.where((F.col("lang") == lang) & (F.col("pieces") == 0) & (F.col("terms") >= least))
    return of.select(key, F.when(easy, "easy").when(hard, "hard").alias("band")).where("band IS NOT NULL")
