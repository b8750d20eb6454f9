"""Wikitext to plain text, by one scan with a stack.

The scan stops only at signs that can open or close something. An opening sign puts a frame on the
stack; a closing sign ends the innermost open frame of its kind, whatever was opened in between and
never closed stays as it is written. So structures of any depth are read in one pass, in time that
grows with the text.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SIGN = re.compile(
    r"""(?P<braces>\{\{+) | (?P<ends>\}\}+) | (?P<table>\{\|) | (?P<tableend>\|\}(?!\})) | (?P<link>\[\[) | (?P<brackets>\]+)
      | (?P<outer>\[https?://[^\s\[\]]+[ \t]) | (?P<pipe>\|) | (?P<quotes>''+)
      | (?P<note>(?i:<ref)(?:\s[^<>]*)?>) | (?P<noteend>(?i:</ref)\s*>) | (?P<tag></?[a-zA-Z][^<>]*>)""",
    re.X,
)
#: What a text must hold for the scan to change more than its white space.
MARKED = r"[<{\[&=]|''"
_WHITE = r"[\s\x1c-\x1f]+"


class _Frame:
    """Something open: its kind, where its sign stands in the output, where its last part begins."""

    __slots__ = ("kind", "at", "part")

    def __init__(self, kind: str, at: int) -> None:
        self.kind, self.at, self.part = kind, at, at + 1


class _Scan:
    def __init__(self) -> None:
        self.out: list[str] = []
        self.open: list[_Frame] = []
        self.count: dict[str, int] = {}

    def push(self, kind: str, sign: str) -> None:
        self.open.append(_Frame(kind, len(self.out)))
        self.count[kind] = self.count.get(kind, 0) + 1
        self.out.append(sign)

    def pop(self, kind: str) -> _Frame | None:
        """The innermost open frame of the kind; the ones opened after it are plain text."""
        if not self.count.get(kind):
            return None
        while True:
            frame = self.open.pop()
            self.count[frame.kind] -= 1
            if frame.kind == kind:
                return frame

    def drop(self, kind: str, sign: str) -> None:
        """The end of something without text of its own: a space takes its place."""
        frame = self.pop(kind)
        if frame is None:
            self.out.append(sign)
        else:
            del self.out[frame.at :]
            self.out.append(" ")

    def label(self, kind: str) -> bool:
        """The end of a link, of which its last part stays."""
        frame = self.pop(kind)
        if frame is not None:
            del self.out[frame.at : frame.part]
        return frame is not None

    def brackets(self, sign: str) -> None:
        left = len(sign)
        while left:
            inner = self.open[-1].kind if self.open else ""
            if inner != "outer" and left > 1 and self.label("link"):
                left -= 2
            elif self.label("outer"):
                left -= 1
            elif left > 1 and self.label("link"):
                left -= 2
            else:
                self.out.append("]" * left)
                return


def _without_comments(text: str) -> str:
    kept, start = [], 0
    while (at := text.find("<!--", start)) >= 0 and (end := text.find("-->", at + 4)) >= 0:
        kept += [text[start:at], " "]
        start = end + 3
    return "".join([*kept, text[start:]]) if kept else text


def _heading(line: str) -> str:
    """A line between equal signs without them."""
    inner = line.strip()
    return inner.strip("=") if len(inner) > 2 and inner[0] == "=" and inner[-1] == "=" else line


def plain_text(text: str | None) -> str:
    """Wikitext without comments, references, tables, templates, targets of links, signs of
    headings, tags and quotes, of any depth; character references resolved, white space collapsed.
    Of a link its last part stays, of an outer link its label; an outer link without one stays.
    What is opened and never closed is plain text. Null counts as empty."""
    text = _without_comments(text or "")
    scan, start = _Scan(), 0
    for m in _SIGN.finditer(text):
        if m.start() > start:
            scan.out.append(text[start : m.start()])
        start = m.end()
        kind, sign = m.lastgroup, m.group()
        if kind == "braces":
            for _ in range(len(sign) // 2):
                scan.push("template", "{{")
        elif kind == "ends":
            for _ in range(len(sign) // 2):
                scan.drop("template", "}}")
        elif kind == "table":
            scan.push("table", sign)
        elif kind == "tableend":
            scan.drop("table", sign)
        elif kind in ("link", "outer"):
            scan.push(kind, sign)
        elif kind == "brackets":
            scan.brackets(sign)
        elif kind == "pipe":
            scan.out.append(sign)
            if scan.open and scan.open[-1].kind == "link":
                scan.open[-1].part = len(scan.out)
        elif kind == "note" and sign[-2] != "/":
            scan.push("note", " ")
        elif kind == "noteend":
            scan.drop("note", " ")
        elif kind in ("note", "tag"):
            scan.out.append(" ")
    scan.out.append(text[start:])
    text = "".join(scan.out)
    if "=" in text:
        text = "\n".join(map(_heading, text.split("\n")))
    return " ".join(html.unescape(text).split())


def clean_wikitext(text: Column) -> Column:
    """``plain_text`` as a column. Texts without any sign of markup stay in the JVM; null stays null."""

    @F.pandas_udf("string")
    def scanned(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else plain_text(v))

    marked = text.rlike(MARKED)
    collapsed = F.regexp_replace(F.regexp_replace(text, "(?U)" + _WHITE, " "), "^ | $", "")
    return F.when(marked, scanned(F.when(marked, text))).otherwise(collapsed)
