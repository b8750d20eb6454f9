"""Words: maximal runs of letters and digits of NFC, lower-cased text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_BREAK = re.compile(r"[\s_]")

#: Texts longer than this are cut into pieces, at white space, before matching, so that one text
#: never has all its tokens in memory at once.
PIECE = 1 << 20


def fold(text: str | None) -> str:
    """NFC, then lower case. Null counts as the empty string."""
    if not text:
        return ""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()


def words(text: str | None) -> list[str]:
    """The words of a text, in order."""
    folded = fold(text)
    return (_ASCII_WORD if folded.isascii() else WORD).findall(folded)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut only where no word runs on."""
    start, n = 0, len(text)
    while n - start > size:
        cut = _BREAK.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]
