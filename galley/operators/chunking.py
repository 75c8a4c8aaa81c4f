"""Chunks: oversized blocks split, blocks packed to a target size, each chunk led by the end of the one before.

A document is one row with its blocks in an array, so packing needs no shuffle; `gathered` makes such rows from
a table of blocks. The state of packing depends on each decision before, so it runs as a fold per row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley import constants as K
from galley.functions import text as T

CHUNKS = "array<struct<chunk_index:int,text:string,body:string,overlap:string,block_indices:array<int>,overlap_prefix_blocks:array<int>,page_lo:int,page_hi:int,char_count:int>>"


@dataclass(frozen=True)
class Sizes:
    target: int = K.CHUNK_TARGET
    most: int = K.CHUNK_MAX
    overlap: int = K.OVERLAP
    ends: str = K.TERMINAL


def split_long(text: str, sizes: Sizes) -> list[str]:
    """Whole sentences in pieces of at most sizes.most; a longer sentence is cut by length, and its rest stays alone."""
    out: list[str] = []
    held = ""
    for s in filter(None, re.split(f"(?<=[{re.escape(sizes.ends)}])", text)):
        if held and (len(s) > sizes.most or len(held) + len(s) > sizes.most):
            out.append(held)
            held = ""
        if len(s) > sizes.most:
            out += [s[i : i + sizes.most] for i in range(0, len(s), sizes.most)]
        else:
            held += s
    return out + [held] * bool(held)


def units_of(blocks, sizes: Sizes) -> list[tuple[int, str, str, int]]:
    """block_index, text, type, page of what is packed: no tables, no empty texts."""
    out = []
    for b in sorted(blocks, key=lambda b: b["block_index"]):
        if b["block_type"] != "table" and b["text"]:
            parts = [b["text"]] if len(b["text"]) <= sizes.most else split_long(b["text"], sizes)
            out += [(b["block_index"], p, b["block_type"], b["page"]) for p in parts]
    return out


def fill(units: list, start: int, room: int) -> int:
    """Where the chunk that begins at start ends: at the first unit that does not fit, or at a heading that fits
    but would stand last, because what follows does not fit or there is nothing."""
    used, at = len(units[start][1]), start + 1
    while at < len(units):
        then = used + len(units[at][1])
        if then > room:
            break
        if units[at][2] == "heading" and (at + 1 == len(units) or then + len(units[at + 1][1]) > room):
            break
        used, at = then, at + 1
    return at


def chunks_of(blocks, sizes: Sizes) -> list[dict]:
    units, out, at, before = units_of(blocks, sizes), [], 0, []
    while at < len(units):
        lead = list(dict.fromkeys(u[0] for u in before))[-sizes.overlap :] if sizes.overlap > 0 else []
        overlap = "".join(u[1] for u in before if u[0] in lead)
        head = f"{K.OVERLAP_MARK}\n{overlap}\n{K.BODY_MARK}\n" if lead else ""
        end = fill(units, at, sizes.target - len(head))
        group = units[at:end]
        body = group[0][1] + "".join(("\n" if u[0] != p[0] else "") + u[1] for p, u in zip(group, group[1:], strict=False))
        pages = [u[3] for u in group] + [u[3] for u in before if u[0] in lead]
        row = {"chunk_index": len(out), "text": head + body, "body": body, "overlap": overlap, "block_indices": list(dict.fromkeys(u[0] for u in group))}
        out.append(row | {"overlap_prefix_blocks": lead, "page_lo": min(pages), "page_hi": max(pages), "char_count": len(head + body)})
        before, at = group, end
    return out


def gathered(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each document, its blocks in an array."""
    fields = F.struct("block_index", "text", "block_type", "page")
    return blocks.groupBy(key).agg(F.array_sort(F.collect_list(fields)).alias("blocks"))


def chunks(rows: DataFrame, sizes: Sizes = Sizes(), key: str = "doc_id") -> DataFrame:
    """key and the columns of a chunk. rows: key, blocks array<struct<block_index, text, block_type, page>>."""

    @F.pandas_udf(CHUNKS)
    def pack(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda b: chunks_of(b if b is not None else [], sizes))

    return rows.select(key, F.explode(pack("blocks")).alias("c")).select(key, "c.*")


def oversized(text: str | Column, sizes: Sizes) -> Column:
    """The pieces of a text as `split_long` makes them, as a fold in the JVM."""
    n = F.lit(sizes.most)

    def add(acc: Column, s: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(s), n), lambda i: F.substring(s, i, n))
        flushed = F.when(acc.held != "", F.concat(acc.out, F.array(acc.held))).otherwise(acc.out)
        fits = F.length(acc.held) + F.length(s) <= n
        state = lambda held, out: F.struct(held.alias("held"), out.alias("out"))
        return F.when(F.length(s) > n, state(F.lit(""), F.concat(flushed, cut))).when(fits, state(F.concat(acc.held, s), acc.out)).otherwise(state(s, flushed))

    start = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(T.pieces_after(text, sizes.ends), start, add, lambda acc: F.when(acc.held != "", F.concat(acc.out, F.array(acc.held))).otherwise(acc.out))


def tails(chunk_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, block_index of the last body block of each chunk but a document's last."""
    last = chunk_rows.groupBy(key).agg(F.max("chunk_index").alias("last"))
    found = chunk_rows.join(last, key).filter("chunk_index < last")
    return found.select(key, F.element_at("block_indices", -1).alias("block_index")).distinct()


def owners(chunk_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, block_index and the first chunk that has the block in its body."""
    each = chunk_rows.select(key, "chunk_index", F.explode("block_indices").alias("block_index"))
    return each.groupBy(key, "block_index").agg(F.min("chunk_index").alias("chunk_index"))
