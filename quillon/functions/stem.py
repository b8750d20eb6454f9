"""Suffix stripping after Porter (1980), with the two later changes of its author (bli, logi).

A word is read through its skeleton, a string of the same length with c for each consonant and v
for each vowel; every condition of the algorithm is then a look at a prefix of the skeleton.
"""

from __future__ import annotations

import re
from functools import lru_cache

# The published rules, longest suffix first within a step.
STEP2 = [
    ("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"),
    ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"),
    ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("alli", "al"), ("ator", "ate"), ("logi", "log"), ("bli", "ble"), ("eli", "e"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = [
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou",
]

_VC = re.compile("v+c+")
_CVC = re.compile("cvc$")


def skeleton(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant; digits are consonants."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def measure(shape: str) -> int:
    """How often vowels are followed by consonants."""
    return len(_VC.findall(shape))


def _star_o(word: str, shape: str) -> bool:
    return _CVC.search(shape) is not None and word[-1] not in "wxy"


def _longest(word: str, shape: str, rules, least: int) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            n = len(word) - len(suffix)
            return word[:n] + new if measure(shape[:n]) > least else word
    return word


def _plural(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    shape = skeleton(w)
    if w.endswith("eed"):
        return w[:-1] if measure(shape[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix):
            base, left = w[: -len(suffix)], shape[: -len(suffix)]
            if "v" not in left:
                return w
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if len(base) > 1 and base[-1] == base[-2] and left[-1] == "c" and base[-1] not in "lsz":
                return base[:-1]
            return base + "e" if measure(left) == 1 and _star_o(base, left) else base
    return w


def _fourth(w: str) -> str:
    for suffix in STEP4:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            fits = measure(skeleton(base)) > 1 and (suffix != "ion" or base.endswith(("s", "t")))
            return base if fits else w
    return w


def _final(w: str) -> str:
    if w.endswith("e"):
        base = w[:-1]
        shape = skeleton(base)
        m = measure(shape)
        if m > 1 or (m == 1 and not _star_o(base, shape)):
            w = base
    return w[:-1] if w.endswith("ll") and measure(skeleton(w)) > 1 else w


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case ASCII word; words under three letters are their own."""
    if len(word) < 3:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and "v" in skeleton(w)[:-1]:
        w = w[:-1] + "i"
    w = _longest(w, skeleton(w), STEP2, 0)
    w = _longest(w, skeleton(w), STEP3, 0)
    return _final(_fourth(w))
