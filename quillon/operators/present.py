"""Showing results: passages with highlights, suggestions for unknown terms, plain lines."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analysis import analyze, analyze_spans
from .index import SearchIndex
from .match import bounded, parse

WIDTH, TOLERANCE = 40, 10
# What a terminal takes as bold on and off.
BOLD, RESET = "\x1b[1m", "\x1b[0m"
_STOP = re.compile(r"[.!?]")
_CONTROL = {i: " " for i in (*range(0x20), *range(0x7F, 0xA0))}


@dataclass(frozen=True)
class Snippet:
    text: str
    highlights: tuple[tuple[int, int], ...]


def best_window(terms: list[str], wanted: set[str], width: int = WIDTH) -> tuple[int, int, int]:
    """Where the window of ``width`` terms begins that shows most of ``wanted``, how many different
    ones it shows, and how many in all; the first of equals, 0 where nothing is shown."""
    best, first = (0, 0), 0
    inside: dict[str, int] = {}
    hit = [t if t in wanted else None for t in terms]
    for i, term in enumerate(hit):
        if term:
            inside[term] = inside.get(term, 0) + 1
        if i >= width and (old := hit[i - width]):
            inside[old] -= 1
            if not inside[old]:
                del inside[old]
        score = (len(inside), sum(inside.values()))
        if score > best:
            best, first = score, max(0, i - width + 1)
    return first, *best


def extract(text: str | None, query: str, width: int = WIDTH, form: str = "NFC") -> Snippet:
    """The passage of ``width`` terms that shows most of the query (distinct terms, then all), the
    earliest of equals, widened to sentence edges at most ten terms away. Highlights are ranges in
    the passage, touching ones merged. A text without terms is shown whole."""
    if width < 1:
        raise ValueError("width must be positive")
    normal = unicodedata.normalize(form, text or "")
    spans = analyze_spans(normal, form=form)
    if not spans:
        return Snippet(normal, ())
    wanted = set(parse(query).terms)
    n = len(spans)
    first, _, _ = best_window([t for t, _, _ in spans], wanted, width)
    last = min(n - 1, first + width - 1)
    start, end = spans[first][1], spans[last][2]
    for i in range(first, max(0, first - TOLERANCE) - 1, -1):
        if i == 0:
            start = 0
            break
        gap = normal[spans[i - 1][2] : spans[i][1]]
        stops = [m.end() for m in _STOP.finditer(gap)]
        if stops:
            rest = gap[stops[-1] :]
            start = spans[i - 1][2] + stops[-1] + len(rest) - len(rest.lstrip())
            break
    for i in range(last, min(n - 1, last + TOLERANCE) + 1):
        if i == n - 1:
            end = len(normal)
            break
        stop = _STOP.search(normal, spans[i][2], spans[i + 1][1])
        if stop:
            end = stop.end()
            break
    marks: list[list[int]] = []
    for term, a, b in spans:
        if term in wanted and a >= start and b <= end:
            if marks and a - start <= marks[-1][1]:
                marks[-1][1] = max(marks[-1][1], b - start)
            else:
                marks.append([a - start, b - start])
    return Snippet(normal[start:end], tuple((a, b) for a, b in marks))


def snippets(ranked: DataFrame, index: SearchIndex, key: str = "query", width: int = WIDTH) -> DataFrame:
    """``<key>, rank, doc_id, score, title, passage, highlights`` of ranked documents: only their
    texts are read, and passages are made where they lie."""

    @F.pandas_udf("passage string, highlights array<struct<start int, end int>>")
    def show(texts: pd.Series, queries: pd.Series) -> pd.DataFrame:
        made = [extract(t, q or "", width) for t, q in zip(texts, queries)]
        return pd.DataFrame({"passage": [m.text for m in made], "highlights": [[{"start": a, "end": b} for a, b in m.highlights] for m in made]})

    rows = index.docs.join(bounded(ranked), "doc_id").withColumn("s", show("text", key))
    return rows.select(key, "rank", "doc_id", "score", "title", "s.passage", "s.highlights")


def snippet_windows(ranked: DataFrame, index: SearchIndex, key: str = "query", width: int = WIDTH) -> DataFrame:
    """``<key>, rank, doc_id, first, kinds, hits`` of ranked documents: which term of the text the
    passage begins with before it is widened, and how many terms of the query it shows."""

    @F.pandas_udf("first int, kinds int, hits int")
    def window(texts: pd.Series, queries: pd.Series) -> pd.DataFrame:
        made = [best_window(analyze(t), set(parse(q or "").terms), width) for t, q in zip(texts, queries)]
        return pd.DataFrame(made, columns=["first", "kinds", "hits"])

    return index.docs.join(bounded(ranked), "doc_id").withColumn("w", window("text", key)).select(key, "rank", "doc_id", "w.*")


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements between two words, by code point."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def suggest(index: SearchIndex, unknown: DataFrame, limit: int = 3, most: int = 2) -> DataFrame:
    """``term, candidate, distance, df``: for each unknown ``term`` the nearest known ones, by
    distance, then documents, then alphabet. A known term and a limit under 1 give none.

    A known term is cut into ``most + 1`` segments. Of at most ``most`` edits at least one segment is
    untouched and stands at most ``most`` places off, so terms meet by (length, segment, its
    letters); what meets is measured.
    """
    known = index.term_stats.where("field = ''").select(F.col("term").alias("candidate"), "df")
    asked = unknown.select("term").distinct().join(known.select(F.col("candidate").alias("term")), "term", "left_anti")
    start = lambda i: F.floor(i * F.col("n") / (most + 1)).cast("int")
    number = F.explode(F.sequence(F.lit(0), F.lit(most)))
    segments = known.withColumn("n", F.length("candidate")).withColumn("i", number)
    segments = segments.select("candidate", "df", "n", "i", F.substring("candidate", start(F.col("i")) + 1, start(F.col("i") + 1) - start(F.col("i"))).alias("segment"))
    lengths = F.explode(F.sequence(F.greatest(F.length("term") - most, F.lit(0)), F.length("term") + most))
    probes = asked.withColumn("n", lengths).withColumn("i", number).withColumn("at", F.explode(F.sequence(start(F.col("i")) - most, start(F.col("i")) + most)))
    width = start(F.col("i") + 1) - start(F.col("i"))
    probes = probes.where((F.col("at") >= 0) & (F.col("at") + width <= F.length("term")))
    probes = probes.select("term", "n", "i", F.substring("term", F.col("at") + 1, width).alias("segment")).distinct()
    near = segments.join(bounded(probes), ["n", "i", "segment"]).select("term", "candidate", "df").distinct()
    near = near.withColumn("distance", F.levenshtein("term", "candidate", most)).where("distance >= 0")
    order = F.row_number().over(Window.partitionBy("term").orderBy("distance", F.col("df").desc(), "candidate"))
    return near.withColumn("r", order).where(F.col("r") <= limit).select("term", "candidate", "distance", "df")


def visible(text: str) -> str:
    """Control characters as spaces, one for one."""
    return text.translate(_CONTROL)


def folded(text: str, room: int) -> list[tuple[int, int]]:
    """Ranges of the lines of a text: as many words as fit, longer words cut."""
    room = max(1, room)
    return [m.span() for m in re.finditer(rf"\S.{{0,{room - 1}}}(?=\s|$)|\S{{1,{room}}}", text, re.S)]


def cut_short(text: str, room: int) -> str:
    return text if len(text) <= room else text[: max(0, room - 1)] + "…"


def passage_lines(text: str, highlights, columns: int = 80, colour: bool = False, indent: str = "     ") -> list[str]:
    """A passage for a terminal: folded, indented, its highlights bold if ``colour``."""
    shown, lines = visible(text), []
    for start, end in folded(shown, columns - len(indent)):
        line, at = "", start
        for a, b in highlights if colour else ():
            a, b = max(a, start), min(b, end)
            if a < b:
                line += shown[at:a] + BOLD + shown[a:b] + RESET
                at = b
        lines.append(indent + line + shown[at:end])
    return lines


def result_lines(rows: list, limit: int | None = None) -> list[str]:
    """Results as plain lines."""
    return [f"{r.rank:>3}. {r.score:.4f}  document {r.doc_id}" for r in rows[:limit]]


def json_lines(rows: list) -> list[str]:
    """Results as JSON lines."""
    shown = [{"identifier": r.doc_id, "title": r.title, "score": r.score, "snippet": r.passage, "highlights": [{"start": a, "end": b} for a, b in r.highlights]} for r in rows]
    return [json.dumps(line, ensure_ascii=False, separators=(",", ":")) for line in shown]
