"""The Porter stemmer (Porter, 1980) for arrays of words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiou"
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(w: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in VOWELS or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return _shape(w).count("vc")


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _swap(w: str, rules: dict[str, str]) -> str:
    """The longest of the endings is replaced where what is before it has a measure."""
    end = max((e for e in rules if w.endswith(e)), key=len, default=None)
    return w[: -len(end)] + rules[end] if end and _measure(w[: -len(end)]) > 0 else w


def porter(w: str) -> str:
    """Stem of a lower-case word; words of other letters than a to z, and of one or two letters, stay."""
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + to
            break
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2), STEP3)
    end = max((e for e in STEP4 if w.endswith(e)), key=len, default="")
    rest = w[: len(w) - len(end)]
    if end and _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
        w = rest
    if w.endswith("e") and ((m := _measure(w[:-1])) > 1 or (m == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stemmed(words: Column) -> Column:
    """An array of lower-case words as their stems; null stays null. Each distinct word of a batch is stemmed once."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def one(w: str) -> str:
            if w not in known:
                known[w] = porter(w)
            return known[w]

        return lists.map(lambda ws: None if ws is None else [one(w) for w in ws])

    return run(words)
