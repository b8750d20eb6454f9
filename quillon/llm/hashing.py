"""Hashes of terms, shingles and sets."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)
#: Terms whose hash a task remembers.
REMEMBERED = 1 << 18


class TermHasher:
    """64-bit hashes of terms, remembering those it met."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, terms: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        try:
            return np.array([known[t] for t in terms], dtype=np.uint64)
        except KeyError:
            for t in terms:
                if t not in known:
                    known[t] = xxhash.xxh3_64_intdigest(t)
            return np.array([known[t] for t in terms], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_hashes(terms: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for each run of ``size`` terms, in order."""
    n = len(terms) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    found = terms[:n].copy()
    for i in range(1, size):
        found = mix(found * _A + terms[i : n + i] + np.uint64(i))
    return found
