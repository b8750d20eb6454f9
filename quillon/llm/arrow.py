"""Arrow plumbing shared by the operators of this package."""

from __future__ import annotations

from ..functions.batches import PART_CHARS, parts, strings

__all__ = ["PART_CHARS", "parts", "strings"]
