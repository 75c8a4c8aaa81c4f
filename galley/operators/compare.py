"""Comparing two versions of a document sentence by sentence.

Streams, sentences and the lookup of a position's block are DataFrame operations; the edit script of a pair of
documents is made per pair, as it needs both sentence lists at once.
"""

from __future__ import annotations

import bisect
import difflib
import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galley import constants as K
from galley.functions import text as T

DIFFS = "pair_id long, seq int, kind string, original_text string, formatted_text string, page_location string, block_index int"


def stream_pieces(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, block_index, piece_no, start, piece: the normalised lines of a document's blocks, no tables, and where each
    starts in the text that they make together."""
    lines = F.posexplode(F.split(T.unwrap("text"), "\n")).alias("piece_no", "line")
    kept = blocks.filter("block_type <> 'table'").select(key, "block_index", lines)
    pieces = kept.select(key, "block_index", "piece_no", T.normalised("line").alias("piece")).filter("piece <> ''")
    w = Window.partitionBy(key).orderBy("block_index", "piece_no").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0)))


def streams(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: each document's pieces in one text."""
    rows = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("p"))
    return rows.select(key, F.array_join("p.piece", "").alias("text"))


def sentences(texts: DataFrame, ends: str = K.SENTENCE_END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, seq, start, sentence. Starts are running sums of lengths within the row; no shuffle."""
    cut = texts.select(key, T.pieces_after(text, ends).alias("s"))
    timed = F.arrays_zip(F.col("s"), T.starts(F.transform("s", F.length)).alias("at"))
    each = cut.select(key, F.posexplode(timed).alias("seq", "x"))
    return each.select(key, "seq", F.col("x.at").alias("start"), F.col("x.s").alias("sentence"))


def stream_rows(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text, and pieces, an array of (start, block_index, piece): what `stream_pieces` and `streams` give, from
    documents with their blocks in an array (block_index, text, block_type), and without a shuffle."""
    lines = lambda b: F.transform(F.split(T.unwrap(b.text), "\n"), lambda x: F.struct(b.block_index.alias("block_index"), T.normalised(x).alias("piece")))
    texts = F.filter("blocks", lambda b: b.block_type != "table")
    pieces = F.filter(F.flatten(F.transform(texts, lines)), lambda p: p.piece != "")
    made = rows.select(key, pieces.alias("p"))
    at = T.starts(F.transform("p.piece", F.length))
    placed = F.zip_with("p", at, lambda p, a: F.struct(a.alias("start"), p.block_index.alias("block_index"), p.piece.alias("piece")))
    return made.select(key, F.array_join("p.piece", "").alias("text"), placed.alias("pieces"))


def sentence_blocks(rows: DataFrame, ends: str = K.SENTENCE_END, key: str = "doc_id") -> DataFrame:
    """key, seq, start, sentence, block_index of the piece in which each sentence starts, from documents with their
    blocks in an array. Starts of pieces and sentences are sorted together in the row: a sentence at place i of both,
    the n-th of its kind, stands in piece i - n."""
    cut = stream_rows(rows, key).select(key, "pieces", T.pieces_after("text", ends).alias("s"))
    timed = cut.select(key, "pieces", "s", T.starts(F.transform("s", F.length)).alias("at"))
    tag = lambda a, side: F.transform(a, lambda x, i: F.struct(x.alias("start"), F.lit(side).alias("side"), i.alias("seq")))
    both = F.array_sort(F.concat(tag(F.col("pieces.start"), 0), tag(F.col("at"), 1)))
    found = F.transform(both, lambda x, i: F.when(x.side == 1, F.struct(x.seq.alias("seq"), x.start.alias("start"), F.get("s", x.seq).alias("sentence"), F.get("pieces", i - x.seq - 1).block_index.alias("block_index"))))
    each = timed.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"))
    return each.select(key, "x.*")


def block_at(points: DataFrame, pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """points (key, start) with the block_index of the last piece that starts there or before; before all: the first.
    One pass over the sorted union of both, so no pairs are made."""
    a = pieces.select(key, "start", F.col("block_index").alias("b"), F.lit(0).alias("side"), F.col("piece_no").alias("o"))
    b = points.select(key, "start").distinct().select(key, "start", F.lit(None).cast("int").alias("b"), F.lit(1).alias("side"), F.lit(0).alias("o"))
    w = Window.partitionBy(key).orderBy("start", "side", "b", "o")
    both = a.unionByName(b).withColumn("block_index", F.last("b", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = pieces.groupBy(key).agg(F.min("block_index").alias("__first"))
    found = both.filter("side = 1").join(first, key, "left").select(key, "start", F.coalesce("block_index", "__first").alias("block_index"))
    return points.join(found, [key, "start"], "left")


_before = re.compile(f"[{K.CLAUSE_END}](?=[^{K.CLAUSE_END}]*$)")


def narrowed(old: str, new: str) -> tuple[str, str]:
    """The clauses around what differs: common ends are taken off and both cuts moved out to a clause's end."""
    n = min(len(old), len(new))
    head = next((i for i in range(n) if old[i] != new[i]), n)
    tail = next((i for i in range(n - head) if old[-1 - i] != new[-1 - i]), n - head)
    cut = _before.search(old[:head])
    start = cut.end() if cut else 0

    def part(t: str) -> str:
        at = re.compile(f"[{K.CLAUSE_END}]").search(t, len(t) - tail)
        return t[start : at.end() if at else len(t)]

    return part(old), part(new)


def script(old: list[str], new: list[str]) -> list[tuple]:
    """kind, old text, new text, first sentence on either side (-1: past the end)."""
    out = []
    for kind, a, b, c, d in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if kind != "equal":
            texts = "".join(old[a:b]), "".join(new[c:d])
            out.append((kind, *(narrowed(*texts) if kind == "replace" else texts), a if a < len(old) else -1, c if c < len(new) else -1))
    return out


def side(blocks: DataFrame, ids: DataFrame, ends: str, name: str) -> DataFrame:
    """name_id and name, a struct of a document's sentences (text, start) and pieces (start, block_index, place)."""
    pieces = stream_pieces(blocks.join(ids.distinct(), "doc_id", "left_semi")).join(blocks.select("doc_id", "block_index", "source_location"), ["doc_id", "block_index"])
    rows = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "piece_no", "block_index", "source_location", "piece"))).alias("p"))
    cut = T.pieces_after(F.array_join("p.piece", ""), ends)
    where = F.transform("p", lambda x: F.struct(x.start.alias("start"), x.block_index.alias("block_index"), x.source_location.alias("place")))
    return rows.select(F.col("doc_id").alias(f"{name}_id"), cut.alias(f"{name}_s"), where.alias(f"{name}_p"))


def place_of(starts: list[int], pieces: list, at: int) -> tuple:
    """block_index and place of the block in which the at-th sentence starts."""
    start = starts[at]
    p = pieces[max(0, bisect.bisect_right(pieces, start, key=lambda x: x["start"]) - 1)]
    return p["block_index"], p["place"]


def diffs(pairs: DataFrame, original: DataFrame, formatted: DataFrame, ends: str = K.SENTENCE_END) -> DataFrame:
    """One row for each difference of each pair. pairs: pair_id, original_id, formatted_id; the other two are block
    tables (doc_id, block_index, text, block_type, source_location)."""
    old = side(original, pairs.select(F.col("original_id").alias("doc_id")), ends, "original")
    new = side(formatted, pairs.select(F.col("formatted_id").alias("doc_id")), ends, "formatted")
    joined = pairs.join(old, "original_id", "left").join(new, "formatted_id", "left")

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                o, op, f, fp = (list(x) if x is not None else [] for x in (r.original_s, r.original_p, r.formatted_s, r.formatted_p))
                o_at, f_at = (list(accumulate(map(len, x), initial=0)) for x in (o, f))
                for n, (kind, a, b, i, j) in enumerate(script(o, f)):
                    here = place_of(f_at, fp, j) if j >= 0 else (None, None)
                    there = place_of(o_at, op, i)[1] if i >= 0 else None
                    gone = kind == "delete" or j < 0
                    rows.append((r.pair_id, n, kind, a, b, ("(原稿)" + there if there else "") if gone else here[1], None if gone else here[0]))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in DIFFS.split(", ")]).astype({"block_index": "Int32"})

    found = joined.select("pair_id", "original_s", "original_p", "formatted_s", "formatted_p").mapInPandas(run, DIFFS)
    label = F.create_map(*(F.lit(x) for kv in K.DIFF_KINDS.items() for x in kv))[F.col("kind")]
    # The sentences stored with a difference.
    text = F.when(F.col("kind") == "insert", "排版稿新增内容，原稿无对应文字").when(F.col("kind") == "delete", F.concat(F.lit("原稿为："), "original_text", F.lit("，排版稿中未找到对应内容"))).otherwise(F.concat(F.lit("原稿为："), "original_text"))
    return found.select("pair_id", "seq", label.alias("diff_type"), "original_text", "formatted_text", "page_location", "block_index", F.lit(K.CONFIRMED).alias("layer"), text.alias("suggestion"))
