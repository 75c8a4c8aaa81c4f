r"""Personal data: regular expressions propose spans, checksums confirm them, context words move the score.

Everything is a DataFrame expression on one row; there is no shuffle. Positions come from splitting a
text at the pattern and adding up the lengths of pieces and matches, in blocks, so that a text with many
matches stays cheap. Possessive quantifiers and look-behinds keep every pattern linear in the text.

Kinds `email ip card phone` are the base: what passes its check stays whatever its score. The others
need a score of ACCEPT. Spans of different kinds may overlap; `masked` joins overlapping spans.

Defined results: null and empty texts have no spans; texts of any length are searched whole; rows repeat as they
come; an empty table gives an empty result; other columns pass through, and `with_spans` replaces one of its
column's name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, spare

ACCEPT = 0.5
#: Code points before and after a span in which context words count.
BEFORE, AFTER = 48, 16
#: Score of a proposal, of a passed checksum, and of a context word.
PROPOSED, CHECKED, CONTEXT = 0.3, 0.3, 0.3
#: Matches whose lengths are added up together.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, F.lit("[^0-9]"), F.lit(""))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def share(i: Column, reverse: Column) -> Column:
        d = F.substring(reverse, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    return let(F.reverse(number), lambda r: total(F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: share(i, r))) % 10 == 0)


def mod97(code: Column) -> Column:
    """Whether a bank account number in capitals and digits passes the mod-97 check."""

    def step(acc: Column, i: Column, moved: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c < 58, acc * 10 + c - 48).otherwise(acc * 100 + c - 55) % 97

    def run(moved: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), lambda acc, i: step(acc, i, moved)) == 1

    return let(F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4)), run)


def card_ok(lo: int, hi: int) -> Callable[[Column], Column]:
    return lambda m: let(digits(m), lambda d: F.when(F.length(d).between(lo, hi), luhn(d)).otherwise(False))


def count_ok(lo: int, hi: int) -> Callable[[Column], Column]:
    return lambda m: F.length(digits(m)).between(lo, hi)


OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column] | None
    words: str
    checked: bool = False
    needs: str = ""


#: In the order in which spans are listed; the first four are the base kinds.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, "mail|contact|write|kontakt|correo|courriel", needs="@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), r"\bip\b|address|host|server|login", needs="."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", card_ok(16, 19), "card|visa|master|credit|karte|carte|tarjeta", checked=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", count_ok(8, 15), "phone|tel|call|mobile|fax|anruf|appel|llama", needs="+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda m: let(F.replace(m, F.lit(" "), F.lit("")), lambda c: F.when(F.length(c).between(15, 34), mod97(c)).otherwise(False)), "iban|account|bank|konto|compte|cuenta", checked=True),
    Kind("short_card", r"(?<![0-9.,+])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])", card_ok(15, 15), "card|amex|credit|karte|carte|tarjeta", checked=True),
    Kind("national_id", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", None, "ssn|social security|tax id|national id"),
    Kind("local_phone", r"(?<![0-9+().-])\(?[2-9][0-9]{2}\)?[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}(?![0-9])", None, "phone|tel|call|mobile|fax"),
    Kind("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])", None, "token|secret|api[_ -]?key|passw"),
)
BASE = tuple(k.name for k in KINDS[:4])
SPAN = "array<struct<k:int,start:int,end:int,score:double>>"


def ends_of(steps: Column) -> Column:
    """Running sums of an array, by blocks."""

    def within(blocks: Column) -> Column:
        base = F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b)))
        return let(base, lambda p: F.transform(steps, lambda _, i: F.get(p, F.floor(i / BLOCK).cast("int")) + total(F.slice(steps, i - i % BLOCK + 1, i % BLOCK + 1))))

    starts = F.sequence(F.lit(1), F.size(steps), F.lit(BLOCK))
    return let(F.transform(starts, lambda s: total(F.slice(steps, s, F.lit(BLOCK)))), within)


def spans_of(text: Column, no: int) -> Column:
    """The spans of one kind, in order."""
    kind, none = KINDS[no], F.array().cast(SPAN)
    pattern = F.lit(kind.pattern)
    fixed = PROPOSED + CHECKED * (kind.checked or no < len(BASE))

    def scored(s: Column) -> Column:
        begin = F.greatest(s.start - BEFORE, F.lit(0))
        near = F.lower(F.substring(text, begin + 1, s.end + AFTER - begin))
        return F.struct(F.lit(no).alias("k"), s.start.alias("start"), s.end.alias("end"), (F.lit(fixed) + F.when(near.rlike(kind.words), CONTEXT).otherwise(0.0)).alias("score"))

    def placed(found: Column, pieces: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(pieces, i)))
        ends = let(steps, ends_of)
        rows = let(ends, lambda e: F.transform(found, lambda m, i: F.struct(m.alias("m"), (F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"))))
        if kind.valid:
            rows = F.filter(rows, lambda s: kind.valid(s.m))
        return F.filter(F.transform(rows, scored), lambda s: (s.score >= ACCEPT) | F.lit(no < len(BASE))).cast(SPAN)

    whole = let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(let(F.split(text, kind.pattern, -1), lambda pieces: placed(found, pieces))))
    return F.when(F.contains(text, F.lit(kind.needs)), whole).otherwise(none) if kind.needs else whole


def with_spans(docs: DataFrame, column: str = "pii_spans") -> DataFrame:
    """docs and the spans of each text by kind and start; positions in code points, ends exclusive."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn(column, F.array_sort(F.concat(*(spans_of(text, no) for no in range(len(KINDS))))))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    names = F.array(*(F.lit(f"<{k.name.upper()}>") for k in KINDS))
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("neg"), s.k.alias("k"))))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, acc.at + 1, s.start - acc.at), F.get(names, s.k))
        return F.struct(F.greatest(acc.at, -s.neg).alias("at"), F.when(s.start >= acc.at, F.concat(acc.out, F.array(piece))).otherwise(acc.out).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    end = lambda acc: F.concat(F.array_join(acc.out, ""), F.substring(text, acc.at + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(by_start, start, step, end))


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced; a null text stays null."""
    spans = spare(docs, "spans")
    return with_spans(docs, spans).withColumn("text", F.when(F.col("text").isNotNull(), masked(F.col("text"), F.col(spans)))).drop(spans)


def listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.k), s.start, s.end)), ",")


def number_of(no: int) -> Column:
    return F.size(F.filter("pii_spans", lambda s: s.k == no))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = with_spans(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "pii_spans")
    count = [number_of(no).cast("long").alias(f"n_{name}") for no, name in enumerate(BASE)]
    base = listed(F.filter("pii_spans", lambda s: s.k < len(BASE)))
    return spans.select("doc_id", *count, F.sha2(base, 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"))
