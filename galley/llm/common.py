"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators between words.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is missing, a master on this machine alone (tests) gets a temporary folder; any other fails, as
    its executors could not see it.
    """
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="galley-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/galley-{uuid.uuid4().hex}/{tag}"


#: Folders that the innermost `scratch` of this thread will delete.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what `written` makes within, but for tables that it is told to keep. What is still to be computed
    from those tables must be written by then."""
    made: list[str] = []
    before = _scratch.set(made)
    try:
        yield
    finally:
        _scratch.reset(before)
        for path in made:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a table's folder and the one around it, which `new_path` gave to it alone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, tag: str, plain: bool = False, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a cut of lineage that survives lost executors. plain:
    without compression, for ids and hashes, which don't shrink, while the codec's buffers lie outside the heap. keep: not
    deleted with the `scratch` around it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    if (made := _scratch.get()) is not None and not keep:
        made.append(path)
    df.write.option("compression", "none" if plain else "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables from `written` that nothing will read again."""
    for df in tables:
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def spare(df: DataFrame, name: str) -> str:
    """A column name that df does not have: name, or name with underscores after it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs as a written table with a column of unique row numbers, and that column's name. The numbers are stored, so
    every later action sees the same ones, however many executors plan it."""
    name = spare(docs, "row_id")
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut_batches(frames, limit_chars: int = 4_000_000, text: str = "text"):
    """Split pandas batches so that each holds about limit_chars of text, and one row at least."""
    for pdf in frames:
        if len(pdf) == 0:
            continue
        ends = pdf[text].str.len().fillna(0).cumsum()
        for _, part in pdf.groupby((ends // limit_chars).astype("int64"), sort=True):
            yield part
