"""An English tokeniser that keeps addresses and contractions apart: white space, addresses frozen, marks at edges, contractions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

ADDRESS = re.compile(r"^(?:https?://|ftp://|www\.|mailto:)\S+$|^[\w.+-]+@[\w-]+\.[\w.]+$", re.IGNORECASE)
LEFT, RIGHT = re.compile(r"^([\"'(\[{<`«“‘]+)(.+)$"), re.compile(r"^(.+?)([\"')\]}>,.;:!?»”’]+)$")
CONTRACTION = re.compile(r"^(.+)('(?:s|m|d|ll|re|ve))$", re.IGNORECASE)
NEGATION = re.compile(r"^(.+)(n't)$", re.IGNORECASE)


def tokenise(text: str) -> list[str]:
    out: list[str] = []
    for word in text.split():
        if ADDRESS.match(word):
            out.append(word)
            continue
        after: list[str] = []
        if m := LEFT.match(word):
            out.append(m[1])
            word = m[2]
        if (m := RIGHT.match(word)) and not ADDRESS.match(word):
            word, after = m[1], [m[2]]
        m = NEGATION.match(word) or CONTRACTION.match(word)
        out += [m[1], m[2]] if m else [word]
        out += after
    return out


def tokenise_udf():
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else tokenise(t))

    return run
