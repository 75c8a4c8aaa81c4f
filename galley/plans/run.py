"""A review from blocks to a stored record, in two steps: what the model found is written, then put into the workspace.

The second step can be repeated after a failure without asking the model again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley import constants as K
from galley.operators import chunking, classify, review_map
from galley.workspace import Workspace


def compute(blocks: DataFrame, complete: Callable[[str, str], str], system: str, path: str, mode: str = K.DEEP, sizes: chunking.Sizes = chunking.Sizes(), progress: Accumulator | None = None) -> DataFrame:
    """Ask the model about all chunks of blocks (doc_id and the columns of a block) and classify what it finds. Answers and
    findings are written under path; returns the findings. progress, an accumulator, counts the chunks asked."""
    spark = blocks.sparkSession
    chunks = chunking.chunks(chunking.gathered(blocks), sizes)
    review_map.asked(chunks, complete, system, progress=progress).write.mode("overwrite").parquet(f"{path}/answers")
    answers = spark.read.parquet(f"{path}/answers")
    found = review_map.findings(answers, chunks, blocks)
    classify.reviewed(found, blocks, chunking.tails(chunks), mode).write.mode("overwrite").parquet(f"{path}/findings")
    return spark.read.parquet(f"{path}/findings")


def warnings(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, chunk_index, error of the chunks that failed."""
    return spark.read.parquet(f"{path}/answers").filter("error IS NOT NULL").select("doc_id", "chunk_index", "error")


def publish(workspace: Workspace, path: str, doc_id: int, record: DataFrame, blocks: DataFrame, tries: int = 3) -> tuple[int, range]:
    """Store what `compute` found in one document as a record with its issues, trying again if that fails."""
    rows = workspace.spark.read.parquet(f"{path}/findings").filter(F.col("doc_id") == doc_id)
    mine = blocks.filter(F.col("doc_id") == doc_id).select("block_index", "text")
    for left in range(tries - 1, -1, -1):
        try:
            return workspace.persist(record, rows, "seq", mine)
        except Exception:
            if not left:
                raise
    raise ValueError("tries must be 1 at least")
