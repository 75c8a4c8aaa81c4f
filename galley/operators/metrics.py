"""Figures about parsed text and about the findings of two runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from galley import constants as K
from galley.functions import text as T

FRAGMENT, LONG = 4, 40
MISORDER = (r"《\s", r"\d\s*《\s*\.")


def misordered(c: str) -> Column:
    return F.col(c).rlike(MISORDER[0]) | F.col(c).rlike(MISORDER[1])


def noise(blocks: DataFrame, stops: str = K.LINE_STOPS, mark: str = K.UNREADABLE, ends: str = "。！？；…\n", closing: str = "”’」』）)》】〕\"'", key: str = "doc_id") -> DataFrame:
    """For each document: breaks within sentences (between blocks and lines), broken locations, misordered brackets,
    unreadable marks and the characters that go with them, blocks; and a row with a null key for all."""
    before = F.lag("text").over(Window.partitionBy(key).orderBy("block_index"))
    goes_on = lambda t: ~F.substring(t, -1, 1).isin(*stops)
    inside = F.size(F.regexp_extract_all("text", F.lit(f"[^{T.quoted(stops)[1:-1]}](?=\n)"), F.lit(0)))
    rows = blocks.select(
        key,
        (F.coalesce(goes_on(before) & (before != ""), F.lit(False)).cast("int") + inside).alias("a"),
        F.contains(F.coalesce("source_location", F.lit("")), F.lit("\n")).cast("int").alias("b"),
        misordered("text").cast("int").alias("c"),
        T.count_of("text", mark).alias("d"),
        (F.length("text") - F.length(T.without_unreadable("text", mark, ends, closing))).alias("e"),
    )
    sums = [F.sum(c).cast("long").alias(n) for c, n in zip("abcde", ("mid_sentence_breaks", "location_breaks", "bracket_misorder", "unreadable_marks", "excluded_chars"), strict=True)]
    return rows.rollup(key).agg(*sums, F.count("*").alias("n_blocks"))


def names_break(original: Column, suggestion: Column) -> Column:
    """Whether a finding is about the line end that it quotes: the suggestion has a fragment that only stands in the
    quoted text without its line ends, or quotes both sides of one."""
    flat, s = F.replace(original, F.lit("\n"), F.lit("")), F.coalesce(suggestion, F.lit(""))
    part = lambda t, i: F.substring(t, i, F.lit(FRAGMENT))
    starts = F.when(F.length(s) >= FRAGMENT, F.sequence(F.lit(1), F.length(s) - FRAGMENT + 1)).otherwise(F.array().cast("array<int>"))
    across = F.exists(starts, lambda i: ~F.contains(part(s, i), F.lit("\n")) & F.contains(flat, part(s, i)) & ~F.contains(original, part(s, i)))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(original), F.lit(1))), lambda i: F.substring(original, i, F.lit(1)) == "\n")
    both = F.exists(at, lambda i: (i > FRAGMENT) & (F.length(original) - i >= FRAGMENT) & F.contains(s, part(original, i - FRAGMENT)) & F.contains(s, part(original, i + 1)))
    return F.contains(original, F.lit("\n")) & (across | both)


def issue_noise(issues: DataFrame, key: str = "record_id") -> DataFrame:
    """For each record: findings in all, misordered brackets, broken locations, findings about line ends, long and short."""
    t = F.coalesce("original_text", F.lit(""))
    rows = issues.select(key, misordered("original_text").alias("n1"), F.contains(F.coalesce("page_location", F.lit("")), F.lit("\n")).alias("n2"), names_break(t, F.col("suggestion")).alias("n3"), (F.length(t) >= LONG).alias("long"))
    return rows.groupBy(key).agg(F.count("*").alias("total"), F.count_if("n1").alias("n1"), F.count_if("n2").alias("n2"), F.count_if(F.col("n3") & F.col("long")).alias("n3_long"), F.count_if(F.col("n3") & ~F.col("long")).alias("n3_short"))


def delta(pairs: DataFrame, figures: DataFrame, key: str = "record_id") -> DataFrame:
    """pairs (baseline, current) with the change of each figure between the two records."""
    names = [c for c in figures.columns if c != key]
    side = lambda s: figures.select(F.col(key).alias(s), *(F.col(n).alias(f"{s}_{n}") for n in names))
    both = pairs.join(side("baseline"), "baseline").join(side("current"), "current")
    return both.select("baseline", "current", *((F.col(f"current_{n}") - F.col(f"baseline_{n}")).alias(f"d_{n}") for n in names))


def repair_rates(lines: DataFrame, gates=(0.0, 0.5, 0.7, 0.8, 0.9, 1.0)) -> DataFrame:
    """For each rate of agreement, to a tenth: lines, and how many pass each gate. lines: rate."""
    kept = [F.count_if(F.col("rate") >= g).alias(f"kept_{round(g * 100)}") for g in gates]
    return lines.groupBy(F.round("rate", 1).alias("rate")).agg(F.count("*").alias("lines"), *kept)


def chunk_sizes(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("n_chunks"), F.avg("char_count").alias("avg_chars"), F.max("char_count").alias("max_chars"))


def finding_counts(issues: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each record and category: findings, and how many of them have no place."""
    return issues.groupBy(key, "category").agg(F.count("*").alias("n"), F.count_if(~F.coalesce("located", F.lit(False))).alias("n_unlocated"))


def text_source(pages: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text_source: the one way in which all pages of a document were read, else mixed, also without pages.
    pages: key, route."""
    ways = pages.groupBy(key).agg(F.min("route").alias("a"), F.max("route").alias("b"))
    return documents.select(key).join(ways, key, "left").select(key, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("mixed").alias("text_source"))


def summaries(figures: DataFrame, key: str = "record_id") -> DataFrame:
    """key, summary, alarm: the sentence about a record's findings; an alarm where nothing was found but warnings were
    given, as then most likely nothing was read. figures: those of `classify.stats`, and warnings, their number."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    # The words of the sentence and of the alarm.
    parts = [F.concat(F.lit(f"{name} "), n(c)) for name, c in zip(K.LAYERS, ("count_confirmed", "count_doubtful", "count_quotation", "count_optional"), strict=True)]
    text = F.concat(F.lit("本次共发现 "), n("total_issues"), F.lit(" 处："), F.concat_ws("、", *parts), F.lit("（其中高优先级 "), n("high_priority_count"), F.lit("）。"))
    empty = (F.coalesce("total_issues", F.lit(0)) == 0) & (F.col("warnings") > 0)
    alarm = F.when(empty, F.concat(F.lit("本次结果为0条问题，但同时有"), n("warnings"), F.lit("条处理失败/异常提示")))
    return figures.select(key, text.alias("summary"), alarm.alias("alarm"))


def cards(issues: DataFrame) -> DataFrame:
    """Stored findings as they are shown: texts escaped, a place or the mark for none, and notes on the layer, of which
    stored ones have none."""
    notes = F.coalesce(F.col("layer_notes"), F.array().cast("array<string>")) if "layer_notes" in issues.columns else F.array().cast("array<string>")
    shown = {c: T.html_escaped(F.coalesce(c, F.lit(""))) for c in ("original_text", "suggestion", "note")}
    return issues.withColumns(shown | {"page_location": F.coalesce("page_location", F.lit(K.UNLOCATED)), "layer_notes": notes})


@F.pandas_udf(StringType())
def quoted_line(place: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([f"{p!r}\t{t!r}" for p, t in zip(place, text, strict=True)], dtype=object)


def text_dump(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, block_index, line: place and text of each block as quoted literals on one line, for comparing two readings
    with line tools. Write it sorted: ``.sort(key, "block_index").select("line").write.text(path)``."""
    return blocks.select(key, "block_index", quoted_line("source_location", "text").alias("line"))


def findings_json(issues: DataFrame, path: str) -> None:
    """Raw findings as JSON, one object a line in the order of ord; `blocks.replayed` reads arrays of such objects."""
    issues.sort("ord").write.mode("overwrite").json(path)
