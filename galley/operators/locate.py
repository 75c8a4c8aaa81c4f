"""Finding snippets in blocks: whole white space aside, in one block or up to three that follow each other."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galley import constants as K
from galley.functions import text as T

#: Characters of snippets that are sought at once; a longer list goes in several passes over the documents.
PASS_CHARS = 20_000_000


def context(blocks: DataFrame, around: int = K.CONTEXT_BLOCKS, key: str = "doc_id") -> DataFrame:
    """key, block_index, snippet: each block with those around it, joined by line ends."""
    w = Window.partitionBy(key).orderBy("block_index").rowsBetween(-around, around)
    return blocks.select(key, "block_index", F.array_join(F.collect_list("text").over(w), "\n").alias("snippet"))


def contexts(rows: DataFrame, around: int = K.CONTEXT_BLOCKS, key: str = "doc_id") -> DataFrame:
    """The same from documents with their blocks in an array, in order: no shuffle."""
    near = lambda b, i: F.struct(b.block_index.alias("block_index"), F.array_join(F.slice("blocks.text", F.greatest(i - around, F.lit(0)) + 1, F.least(i, F.lit(around)) + around + 1), "\n").alias("snippet"))
    return rows.select(key, F.explode(F.transform("blocks", near)).alias("x")).select(key, "x.*")


def windows(blocks: DataFrame, group: list[str], order: str = "block_index") -> DataFrame:
    """Each run of one to three blocks within a group: first block, window size and texts without white space."""
    w = Window.partitionBy(*group).orderBy(order)
    bare = T.no_space("text")
    near = blocks.select(*group, "block_index", F.col(order).alias("__at"), bare.alias("t1"), F.lead(bare, 1).over(w).alias("t2"), F.lead(bare, 2).over(w).alias("t3"))
    runs = F.array(
        F.struct(F.lit(1).alias("window"), F.col("t1").alias("t")),
        F.struct(F.lit(2).alias("window"), F.concat("t1", "t2").alias("t")),
        F.struct(F.lit(3).alias("window"), F.concat("t1", "t2", "t3").alias("t")),
    )
    return near.select(*group, "block_index", "__at", F.explode(runs).alias("r")).filter("r.t IS NOT NULL").select(*group, "block_index", "__at", "r.window", F.col("r.t").alias("window_text"))


def located(snippets: DataFrame, blocks: DataFrame, group: list[str], ident: str) -> DataFrame:
    """group, ident, block_index, window of the first hit of each snippet by window size, then place.
    Both tables have the group's columns, so this is an equi-join with the search as residual condition."""
    bare = snippets.select(*group, ident, T.no_space("snippet").alias("__s"))
    hits = windows(blocks, group).join(bare, group).filter(F.contains(F.col("window_text"), F.col("__s")))
    first = F.min_by(F.struct("block_index", "window"), F.struct("window", "__at")).alias("hit")
    return hits.groupBy(*group, ident).agg(first).select(*group, ident, "hit.block_index", "hit.window")


def candidates(items: DataFrame, docs: DataFrame, ident: str = "item_id", key: str = "doc_id") -> DataFrame:
    """key, ident for each document that holds an item, white space aside. Items are a stated query set: they
    pass over the documents in blocks of PASS_CHARS characters, all of a block's items in one automaton."""
    spark = docs.sparkSession
    sized = items.select(F.col(ident).alias("i"), T.no_space("text").alias("s")).filter("s <> ''")
    n = sized.agg(F.coalesce(F.sum(F.length("s")), F.lit(0))).first()[0]
    passes, out = n // PASS_CHARS + 1, None
    bare = docs.select(key, T.no_space("text").alias("text")).filter("text IS NOT NULL")
    for p in range(passes):
        part = [(r["i"], r["s"]) for r in sized.filter(F.pmod(F.xxhash64("s"), F.lit(passes)) == p).collect()]
        seen = spark.sparkContext.broadcast(part)

        def run(frames, seen=seen):
            find = finder(seen.value)
            for pdf in frames:
                got = [(k, i) for k, t in zip(pdf[key], pdf["text"], strict=True) for i in find(t)]
                yield pd.DataFrame(got, columns=[key, ident])

        found = bare.mapInPandas(run, f"{key} long, {ident} long")
        out = found if out is None else out.unionByName(found)
    return out


def finder(part: list[tuple[int, str]]):
    """A function from a text to the ids of the items in it."""
    by: dict[str, list[int]] = {}
    for i, s in part:
        by.setdefault(s, []).append(i)
    try:
        import ahocorasick
    except ImportError:
        return lambda t: {i for s, ids in by.items() if s in t for i in ids}
    if not by:
        return lambda t: set()
    machine = ahocorasick.Automaton()
    for s, ids in by.items():
        machine.add_word(s, ids)
    machine.make_automaton()
    return lambda t: {i for _, ids in machine.iter(t) for i in ids}


def routed(snippets: DataFrame, chunk_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """snippets (key, chunk_index, snippet) with route: body, drop (in the overlap only) or unlocated."""
    bare = chunk_rows.select(key, "chunk_index", T.no_space("body").alias("__b"), T.no_space("overlap").alias("__o"))
    has = lambda c: F.contains(F.col(c), T.no_space("snippet"))
    route = F.when(has("__b"), "body").when(has("__o"), "drop").otherwise("unlocated")
    return snippets.join(bare, [key, "chunk_index"]).withColumn("route", route).drop("__b", "__o")
