"""Small text functions that run inside Arrow-batched functions of the operators."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd

_FENCE = re.compile(r"```[ \t]*(?:json)?[ \t]*\n?(.*?)```", re.IGNORECASE | re.DOTALL)
MOST_STARTS = 25


def ratio_at_least(a: str, b: str, threshold: float) -> float:
    """Sequence similarity of two strings, 0 below the threshold; cheap upper bounds are tried first."""
    if not a or not b:
        return 0.0
    if 2 * min(len(a), len(b)) / (len(a) + len(b)) < threshold:
        return 0.0
    match = SequenceMatcher(None, a, b)
    if match.quick_ratio() < threshold:
        return 0.0
    found = match.ratio()
    return found if found >= threshold else 0.0


def _valid(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def _closing(text: str, opens: int) -> int | None:
    """Index of the bracket that closes the one at ``opens``; brackets in strings do not count."""
    mark, end = text[opens], {"{": "}", "[": "]"}[text[opens]]
    depth = 0
    for piece in re.finditer(r'"(?:[^"\\]|\\.)*"?|' + re.escape(mark) + "|" + re.escape(end), text[opens:], re.DOTALL):
        depth += {mark: 1, end: -1}.get(piece[0], 0)
        if depth == 0:
            return opens + piece.start()
    return None


def salvage_json(response: str | None) -> str | None:
    """The JSON text in a model's reply: the first fenced block that parses, else, of at most 25 balanced spans that
    parse, the one that closes last (then the longest); null where there is none."""
    text = (response or "").strip()
    for block in _FENCE.findall(text):
        if _valid(block.strip()):
            return block.strip()
    best: tuple[int, int] | None = None
    for n, start in enumerate(re.finditer(r"[{\[]", text)):
        if n >= MOST_STARTS:
            break
        end = _closing(text, start.start())
        if end is not None and (best is None or (end, -start.start()) > (best[1], -best[0])) and _valid(text[start.start() : end + 1]):
            best = (start.start(), end)
    if best is not None:
        return text[best[0] : best[1] + 1]
    return text if _valid(text) else None


# Porter's suffix stripping as ordered rules: (suffix, replacement, least measure of what is left).
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """The word as c and v; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def porter_stem(word: str) -> str:
    """Stem of a lower-case word by Porter's algorithm."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in _shape(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        fit = max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)
        if fit and _measure(word[: -len(fit[0])]) > 0:
            word = word[: -len(fit[0])] + fit[1]
    fit = max((s for s in (*_STEP4, "ion") if word.endswith(s)), key=len, default=None)
    if fit and _measure(word[: -len(fit)]) > 1 and (fit != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(fit)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def each(f: Callable) -> Callable:
    """A function of one value as a function of a pandas series."""
    return lambda s: pd.Series([f(x) for x in s], index=s.index, dtype=object)
