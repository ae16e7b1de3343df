"""Stemmers: the published Porter algorithm for English, and a light suffix stemmer for French; other languages keep their words.

Words are stemmed once each where possible: callers stem the distinct words of a column and join, or use the
pandas UDF, which remembers words within a batch.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

_C = "[^aeiou](?:[^aeiouy]*)"
_V = "[aeiouy][aeiou]*"
_MEASURED = re.compile(f"^(?:{_C})?{_V}{_C}")
_MEASURE_1 = re.compile(f"^(?:{_C})?{_V}{_C}(?:{_V})?$")
_MEASURE_2 = re.compile(f"^(?:{_C})?{_V}{_C}{_V}{_C}")
_VOWEL = re.compile("^(?:[^aeiou][^aeiouy]*)?[aeiouy]")
_CVC = re.compile(f"^{_C}[aeiouy][^aeiouwxy]$")
#: Suffixes and what replaces them, by step. Fixed values of the published algorithm.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")
#: Suffixes of French words, longest first, for the light stemmer. Fixed values.
_FRENCH = ("issements", "issement", "atrices", "ations", "atrice", "ateurs", "ateur", "ements", "ation", "ement", "euses", "ments", "istes", "ables", "ences", "ance", "ence", "euse", "eurs", "ment", "iste", "able", "eux", "eur", "ions", "ives", "ive", "ifs", "ité", "ités", "ées", "ée", "és", "er", "ez", "é", "es", "s", "e")


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The stem of an English word in lower case; words under three letters stay."""
    if len(word) < 3:
        return word
    w = word
    if w[0] == "y":
        w = "Y" + w[1:]
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _MEASURED.search(w[:-3]):
            w = w[:-1]
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and _VOWEL.search(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"([^aeiouylsz])\1$", w):
                w = w[:-1]
            elif _CVC.search(w):
                w += "e"
    if w.endswith("y") and _VOWEL.search(w[:-1]):
        w = w[:-1] + "i"
    for step in (_STEP2, _STEP3):
        for suffix in sorted(step, key=len, reverse=True):
            if w.endswith(suffix):
                if _MEASURED.search(w[: -len(suffix)]):
                    w = w[: -len(suffix)] + step[suffix]
                break
    if re.search(r"[st]ion$", w) and not w.endswith(_STEP4):
        if _MEASURE_2.search(w[:-3]):
            w = w[:-3]
    else:
        for suffix in _STEP4:
            if w.endswith(suffix):
                if _MEASURE_2.search(w[: -len(suffix)]):
                    w = w[: -len(suffix)]
                break
    if w.endswith("e"):
        base = w[:-1]
        if _MEASURE_2.search(base) or (_MEASURE_1.search(base) and not _CVC.search(base)):
            w = base
    if w.endswith("ll") and _MEASURE_2.search(w):
        w = w[:-1]
    return w.lower()


@lru_cache(maxsize=200_000)
def french(word: str) -> str:
    """A light stem of a French word: one suffix off, if three letters stay."""
    for suffix in _FRENCH:
        if word.endswith(suffix) and len(word) - len(suffix) >= 3:
            return word[: -len(suffix)]
    return word


def stem(word: str, lang: str = "en") -> str:
    return porter(word) if lang == "en" else french(word) if lang == "fr" else word


def stem_udf():
    """A pandas UDF over columns of distinct words and their language codes: callers stem each word once and join."""

    @F.pandas_udf("string")
    def run(words: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else stem(w, lang or "") for w, lang in zip(words, langs)], dtype=object)

    return run


def group_key(term: str, lang: str = "en") -> str:
    """The key under which forms of a term meet: its words' stems, sorted, hyphens as spaces."""
    return " ".join(sorted(stem(w, lang) for w in term.replace("-", " ").split()))


def group_key_udf(lang: str = "en"):
    @F.pandas_udf("string")
    def run(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: None if t is None else group_key(t, lang))

    return run


def damerau(a: str, b: str) -> int:
    """Edit distance with adjacent transpositions, without editing a part twice being forbidden."""
    last: dict[str, int] = {}
    wide = len(a) + len(b)
    d = [[wide] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        seen = 0
        for j, y in enumerate(b, 1):
            i0, j0 = last.get(y, 0), seen
            cost = x != y
            if not cost:
                seen = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[i0][j0] + (i - i0 - 1) + 1 + (j - j0 - 1))
        last[x] = i
    return d[len(a) + 1][len(b) + 1]


def damerau_udf():
    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else damerau(x, y) for x, y in zip(a, b)], dtype="Int32")

    return run


def damerau_norm_udf():
    """1 - distance / longer length; 1 for two empty texts."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else 1 - damerau(x, y) / max(1, len(x), len(y)) for x, y in zip(a, b)], dtype="Float64")

    return run
