"""Connected components over an edge table, by alternating star contraction.

Every step is a join or a partial aggregation over edges; nothing is gathered on the driver but a count.
Each round is written to the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard
from .common import written as stored

MAX_ROUNDS = 60


def written(df: DataFrame, tag: str) -> DataFrame:
    return stored(df, tag, plain=True)


def _joined(rows: DataFrame, least: DataFrame) -> DataFrame:
    """rows with their node's m. least is written first: with an exchange of its own on either side, Spark can split
    the partition of a node that has a large share of all edges."""
    return rows.join(written(least, "least").hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node next to it (or itself)."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return _joined(both.filter(F.col("v") > F.col("u")), least).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the least of them. edges: u > v, distinct."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return _joined(edges, least).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of an edge table (u, v); root is the least node of its component.

    Links of a node to itself and repeated links count for nothing; an empty table gives an empty one."""
    kind = edges.schema["u"].dataType
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    size = now.count()
    for _ in range(MAX_ROUNDS):
        star = written(_large_star(now), "edges")
        after = written(_small_star(star), "edges")
        discard(star)
        was, size = size, after.count()
        done = size == was and after.join(now, ["u", "v"], "left_anti").isEmpty()
        discard(now)
        now = after
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).select(F.col("node").cast(kind), F.col("root").cast(kind))
