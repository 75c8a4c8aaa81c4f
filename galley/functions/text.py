"""Column expressions for text: white space, normal forms, sentences, features.

Space is Unicode white space and the four ASCII separators, as in the data model's origin; all stay in the JVM.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley import constants as K

SPACE = r"[\s\x1c-\x1f]"
YEAR = r"(?U)(?:19|20)\d{2}年?"
QUOTES = ("“([^“”]+)”", "‘([^‘’]+)’", '"([^"]+)"', "'([^']+)'")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda would compute an expression again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sub(c, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(col(c), F.lit(pattern), F.lit(by))


def strip(c) -> Column:
    return sub(c, rf"(?U)\A{SPACE}+|{SPACE}+\z")


def rstrip(c) -> Column:
    return sub(c, rf"(?U){SPACE}+\z")


def no_space(c) -> Column:
    """Without any white space: the key of dedup and of snippet search."""
    return sub(c, rf"(?U){SPACE}+")


def quoted(chars: str) -> str:
    """A character class of exactly these characters."""
    return "[" + "".join(rf"\x{{{ord(c):x}}}" for c in chars) + "]"


def pieces_after(c, ends: str) -> Column:
    """The text cut after each of these characters, which stay with what they end; no empty pieces."""
    return F.filter(F.split(col(c), f"(?<={quoted(ends)})", -1), lambda x: x != "")


def starts(lengths: Column, block: int = 64) -> Column:
    """For each element of an array of lengths the sum of those before it; summed by blocks, so that long arrays stay
    cheap."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def within(n: Column) -> Column:
        firsts = F.when(F.size(n) > 0, F.sequence(F.lit(0), F.size(n) - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))
        sums = F.transform(firsts, lambda at: total(F.slice(n, at + 1, block)))

        def placed(b: Column) -> Column:
            before = F.transform(b, lambda _, k: total(F.slice(b, F.lit(1), k)))
            return let(before, lambda base: F.transform(n, lambda _, i: F.get(base, F.floor(i / block).cast("int")) + total(F.slice(n, i - i % block + 1, i % block))))

        return let(sums, placed)

    return let(lengths, within)


def has_any(c, words) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(col(c), F.lit(w)) for w in words))


def unwrap(c) -> Column:
    """One kind of line end, and words hyphenated over a line end joined."""
    lines = F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return sub(lines, "([a-zA-Z])-\n([a-zA-Z])", "$1$2")


def normalised(c) -> Column:
    """For comparison: unwrapped, stripped, and white space kept as one blank only between Latin letters or digits."""
    even = sub(strip(unwrap(c)), rf"(?U)(?<=[A-Za-z0-9]){SPACE}+(?=[A-Za-z0-9])", " ")
    return sub(even, rf"(?U)(?<![A-Za-z0-9]){SPACE}+|{SPACE}+(?![A-Za-z0-9\s\x1c-\x1f])")


def without_unreadable(c, mark: str = K.UNREADABLE, ends: str = "。！？；…\n", closing: str = "”’」』）)》】〕\"'") -> Column:
    """The text without the clauses that hold the mark; a clause ends after one of ends unless a closing mark follows."""
    after = f"(?!{quoted(closing)})" if closing else ""
    kept = F.filter(F.split(col(c), f"(?<={quoted(ends)}){after}", -1), lambda x: ~F.contains(x, F.lit(mark)))
    return F.when(F.contains(col(c), F.lit(mark)), F.array_join(kept, "")).otherwise(col(c))


def count_of(c, chars: str) -> Column:
    return F.length(col(c)) - F.length(F.translate(col(c), chars, ""))


def years(c) -> Column:
    return F.transform(F.regexp_extract_all(col(c), F.lit(YEAR), F.lit(0)), lambda y: F.substring(y, 1, 4).try_cast("int"))


def longest_quote(c) -> Column:
    """Characters inside the longest pair of quotation marks of one kind; 0 if there is none."""
    each = [F.coalesce(F.array_max(F.transform(F.regexp_extract_all(col(c), F.lit(q), F.lit(1)), F.length)), F.lit(0)) for q in QUOTES]
    return F.greatest(*each)


def classical(c) -> Column:
    n = count_of(c, K.PARTICLES)
    return (n >= K.PARTICLE_COUNT) & (n >= F.length(col(c)) * F.lit(K.PARTICLE_DENSITY))


def stray_controls(c) -> Column:
    return col(c).rlike(r"[\p{Cc}&&[^\t\n\r]]")


def without_c0(c) -> Column:
    return sub(c, r"[\x00-\x09\x0b-\x1f\x7f]")


#: Blocks of Unicode whose characters look like ideographs that have a code point of their own.
LOOKALIKE_BLOCKS = ("KANGXI RADICAL", "CJK COMPATIBILITY IDEOGRAPH")


def variants() -> dict[str, str]:
    """Look-alike characters and those they stand for: the named ones that Unicode's own tables give a compatibility
    form, brought to simplified characters, and radicals that have none."""
    named = (chr(c) for c in range(0x2E00, 0x30000) if unicodedata.name(chr(c), "").startswith(LOOKALIKE_BLOCKS))
    forms = ((c, unicodedata.normalize("NFKC", c)) for c in named)
    return {c: K.TRADITIONAL.get(to, to) for c, to in forms if to != c} | K.RADICALS


def variant_table() -> tuple[str, str]:
    table = variants()
    return "".join(table), "".join(table.values())


def folded(c) -> Column:
    """Look-alike characters replaced by those they stand for."""
    return F.translate(col(c), *variant_table())


def html_escaped(c) -> Column:
    """Text as it may stand in HTML, in attributes too."""
    out = col(c)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def file_name(c) -> Column:
    return sub(c, r'[\\/:*?"<>|]', "_")
