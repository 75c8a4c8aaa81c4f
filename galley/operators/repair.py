"""Characters that a file's own text lacks, filled in from a recognised reading of the same line."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from galley import constants as K
from galley.functions import text as T
from galley.functions.alignment import one_to_one
from galley.operators.glyphs import CODES, unreadable

GATE = 0.8


def aligned(text: str, read: str) -> dict[int, str]:
    """Positions of text to characters of read, where an edit script pairs them one to one."""
    out = {}
    for i, j, n, _ in one_to_one(text, read):
        out |= zip(range(i, i + n), read[j : j + n], strict=True)
    return out


def agreement(text: str, pairs: dict[int, str], bad: set[int]) -> float:
    """The share of sound characters that the reading confirms; nothing speaks against a line that has none. `repaired`
    counts the same from whole stretches."""
    checked = [pairs.get(i) == c for i, c in enumerate(text) if i not in bad]
    return sum(checked) / len(checked) if checked else 1.0


@cache
def comparable() -> tuple[re.Pattern, frozenset[str], dict[int, str]]:
    """Codes that no reading shows, look-alikes, and the characters that these are read as."""
    codes = re.sub(r"\\x\{(\w+)\}", lambda m: rf"\U{int(m[1], 16):08x}", CODES)
    return re.compile(codes), frozenset(T.variants()), str.maketrans(T.variants())


def repaired(text: str, bad: list[int], read: str | None, gate: float = GATE) -> str:
    """text with each bad character read, or marked as unreadable. Line and reading are compared without codes and with
    look-alikes folded, else every one of those would count against the reading; the text itself keeps them."""
    codes, alike, fold = comparable()
    wrong = {i for i in bad if 0 <= i < len(text)}
    line, doubtful, letters = text, {i: i for i in wrong}, set(text)
    if codes.search("".join(letters)):
        shown = [i for i, c in enumerate(text) if not codes.match(c)]
        line, doubtful = "".join(text[i] for i in shown), {k: i for k, i in enumerate(shown) if i in wrong}
    if not alike.isdisjoint(letters):
        line = line.translate(fold)
    found, confirmed, paired, place, at = {}, 0, False, sorted(doubtful), 0
    for i, j, n, equal in one_to_one(line, read) if read else ():
        paired = True
        confirmed += n if equal else 0
        while at < len(place) and (k := place[at]) < i + n:
            if k >= i:
                found[doubtful[k]] = read[j + k - i]
                confirmed -= equal
            at += 1
    checked = len(line) - len(doubtful)
    sure = paired and (not checked or confirmed / checked >= gate)
    out = list(text)
    for i in wrong:
        out[i] = found.get(i, K.UNREADABLE) if sure else K.UNREADABLE
    return "".join(out)


@F.pandas_udf(StringType())
def repair(text: pd.Series, bad: pd.Series, read: pd.Series) -> pd.Series:
    return pd.Series([repaired(t, np.asarray(b).tolist(), r) for t, b, r in zip(text, bad, read, strict=True)])


def fabricated(glyphs: DataFrame, trace: DataFrame, page: list[str]) -> DataFrame:
    """glyphs that the drawing trace shows to have no character of their own, met by place to a hundredth. Codes have
    none either, but nobody takes them for characters."""
    key = [F.round("ox", 2).alias("__x"), F.round("oy", 2).alias("__y")]
    odd = trace.filter(F.col("c") == "�").select(*page, *key).distinct()
    return glyphs.filter(~unreadable(F.col("c"))).select("*", *key).join(odd, [*page, "__x", "__y"], "left_semi").drop("__x", "__y")
