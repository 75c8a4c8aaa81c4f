"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

New data is reduced to digests, deduplicated within the batch by a partial aggregation, compared with
the index by a sort-merge anti-join, and what is new is appended. Only DataFrame functions are used.

Defined results: a null text counts as empty; texts are equal when they agree after deleting ASCII
white space; of equal texts the longest original stays, then the smallest doc_id (null last), then the
first row. Rows that repeat doc_id and text are copies like any others: one row stays. An empty table
gives an empty result. Texts of any length are read whole. Columns besides doc_id and text are carried through
by `drop_copies`, whatever their names, and ignored elsewhere.

Rows are numbered in a written table, and every step reads those numbers there, so nothing depends on how an
action deals a scan out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, discard, documents, new_path, numbered, shuffle_parts, written

#: A digest with at least this share of a batch is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def normalised(text: str | Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for c in ASCII_SPACE:
        col = F.replace(col, F.lit(c), F.lit(""))
    return col


def digests(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """row_id, doc_id, n_chars, digest of each row. Without row, a number of each row, rows are numbered here: write
    the result before use."""
    return docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row_id"),
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).alias("n_chars"),
        F.unhex(F.sha2(normalised("text"), 256)).alias("digest"),
    )


class DigestIndex:
    """A table digest -> document that stays, bucketed and sorted by digest. One file per bucket and append."""

    COLUMNS = "digest binary, keep_id bigint, keep_row bigint, group_size bigint"

    def __init__(self, spark: SparkSession, table: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark, self.table = spark, table or f"digest_index_{uuid.uuid4().hex}"
        self.path, self.buckets = path or new_path(spark, "digest_index"), buckets or shuffle_parts(spark)
        if not spark.catalog.tableExists(self.table):
            self._write(spark.createDataFrame([], self.COLUMNS))

    def _write(self, rows: DataFrame) -> None:
        rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).mode("append").saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, groups: DataFrame) -> DataFrame:
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def append(self, groups: DataFrame) -> None:
        """Add the digests that the index lacks."""
        new = self.unseen(groups).select("digest", "keep_id", "keep_row", "group_size")
        self._write(new.repartition(self.buckets, "digest"))


def groups_of(rows: DataFrame) -> DataFrame:
    """One row per digest: the row that stays and the number of copies; copies are combined before the shuffle."""
    best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("n"), "doc_id", "row_id"))
    return rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")).select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row_id").alias("keep_row"), "group_size")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, row: Column | None = None) -> DataFrame:
    """One row per row of docs: row_id (row, where it is given), doc_id, keep_id, group_size, kept, digest.

    With an index that already holds a text, every new copy of it is dropped and points to the older
    document; group_size then counts the copies in the batch that brought the text. Without an index, one is
    made for this batch and dropped again.
    """
    own = DigestIndex(docs.sparkSession) if index is None else None
    index = index or own
    rows = written(digests(docs, row), "digests")
    groups = written(groups_of(rows), "groups")
    fresh = written(index.unseen(groups).select("digest", F.lit(True).alias("fresh")), "fresh")
    index.append(groups)
    found = index.read().select("digest", "keep_id", "keep_row", "group_size")
    total = rows.count()
    # The hot digests of a batch are few whatever its size, as their counts sum to the batch at most.
    hot = groups.filter(F.col("group_size") >= F.lit(max(2.0, HOT_SHARE * total))).select("digest")
    hot_found = found.join(F.broadcast(hot), "digest", "left_semi").join(fresh, "digest", "left")
    cold_found = found.join(fresh.hint("merge"), "digest", "left")
    cold = rows.join(F.broadcast(hot), "digest", "left_anti").join(cold_found.hint("merge"), "digest")
    out = rows.join(F.broadcast(hot_found), "digest").unionByName(cold)
    kept = F.coalesce(F.col("fresh"), F.lit(False)) & (F.col("row_id") == F.col("keep_row"))
    out = written(out.select("row_id", "doc_id", "keep_id", "group_size", kept.alias("kept"), "digest"), "judged")
    discard(rows, groups, fresh)
    if own:
        own.drop()
    return out


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """docs without later copies of a text, all columns as they are."""
    rows, row = numbered(docs)
    kept = exact_dedup(rows, index, F.col(row)).filter("kept").select(F.col("row_id").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h
  FROM documents),
k AS (
  SELECT doc_id, h, n, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
         row_number() OVER w AS r
  FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, r = 1 AS kept, h AS text_sha256 FROM k
"""
