"""Look-alike tests on pairs of texts, where Unicode tables or an edit script are needed: Arrow-batched UDFs."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from galley import constants as K

# Blocks of look-alike characters.
VARIANTS = ((0x2E80, 0x2EF3), (0x2F00, 0x2FD5), (0xF900, 0xFAFF), (0x2F800, 0x2FA1D))
# The wordings in which a suggestion gives its replacement.
FRAGMENT = r"[“\"']([^”\"']+)[”\"'](?:应改为|应为|改为)[“\"']([^”\"']+)[”\"']"
TO_END = r"(?:应改为|改为)[“\"'](.+)[”\"']\s*[。．.]?\s*$"
ANYWHERE = r"(?:应改为|改为)[“\"']([^”\"']+)[”\"']"
CONNECTED = r"(?:[，,、]\s*(?:且|并且|同时)\s*)?" + FRAGMENT

_fragment, _end, _any, _connected = re.compile(FRAGMENT), re.compile(TO_END, re.DOTALL), re.compile(ANYWHERE), re.compile(CONNECTED)


def nfkc(s: str) -> str:
    return unicodedata.normalize("NFKC", s)


def stands_for(odd: str, plain: str) -> bool:
    """Whether odd is a look-alike of plain; one without a compatibility form counts for any."""
    if not any(lo <= ord(odd) <= hi for lo, hi in VARIANTS):
        return False
    to = nfkc(odd)
    return to in (odd, plain) or K.TRADITIONAL.get(to) == plain


def only_variants(old: str, new: str) -> bool:
    """Whether all that an edit script changes are look-alikes, one for one."""
    if len(old) != len(new):
        return False
    steps = [s for s in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes() if s[0] != "equal"]
    return all(tag == "replace" and b - a == d - c and all(map(stands_for, old[a:b], new[c:d])) for tag, a, b, c, d in steps)


def window_of_variants(text: str, word: str) -> bool:
    """Whether some part of text, as long as word and not word, differs from it in look-alikes only."""
    parts = {text[i : i + len(word)] for i in range(len(text) - len(word) + 1)} if 0 < len(word) < len(text) else set()
    return any(p != word and only_variants(p, word) for p in parts)


def replacement(original: str | None, suggestion: str | None) -> tuple[str, str] | None:
    """The old and the new text that a suggestion is about."""
    whole, said = (original or "").strip(), suggestion or ""
    if not whole:
        return None
    if m := _fragment.search(said):
        old, new = m[1].strip(), m[2].strip()
        if old and new and old in whole:
            return old, new
    for p in (_end, _any):
        if (m := p.search(said)) and m[1].strip():
            return whole, m[1].strip()
    return (whole, said.strip()) if said.strip() else None


def changes_nothing(original: str | None, suggestion: str | None) -> bool:
    pair = replacement(original, suggestion)
    return bool(pair) and (nfkc(pair[0]) == nfkc(pair[1]) or only_variants(*pair) or window_of_variants(*pair))


def changes_space(original: str | None, suggestion: str | None) -> bool:
    """Whether the suggestion only adds or removes white space inside the text."""
    pair = replacement(original, suggestion)
    bare = lambda s: re.sub(r"\s+", "", s)
    return bool(pair) and any(bare(s) != s.strip() for s in pair) and bare(nfkc(pair[0])) == bare(nfkc(pair[1]))


def without_empty_changes(text: str | None) -> str:
    """The text without the phrases whose replacement changes nothing."""

    def keep(m: re.Match) -> str:
        old, new = m[1].strip(), m[2].strip()
        return "" if old and new and (nfkc(old) == nfkc(new) or only_variants(old, new)) else m[0]

    return _connected.sub(keep, text or "").strip()


@F.pandas_udf(BooleanType())
def no_change(original: pd.Series, suggestion: pd.Series) -> pd.Series:
    return pd.Series([changes_nothing(a, b) for a, b in zip(original, suggestion, strict=True)], dtype=bool)


@F.pandas_udf(BooleanType())
def space_change(original: pd.Series, suggestion: pd.Series) -> pd.Series:
    return pd.Series([changes_space(a, b) for a, b in zip(original, suggestion, strict=True)], dtype=bool)


@F.pandas_udf(StringType())
def cleaned_reason(reason: pd.Series) -> pd.Series:
    return reason.map(without_empty_changes)


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else nfkc(s))
