"""Review events as a stream: decisions counted by time, and the last decision of each issue.

Events have issue_id, status and ts. Late events count up to the watermark; state older than it is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "event_id bigint, issue_id bigint, status string, ts timestamp"


def read(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Events that arrive as Parquet files under a path."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within the time for late ones; sets the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def decisions(events: DataFrame, width: str = "1 day") -> DataFrame:
    """begin, status, n: decisions of each kind in each stretch of time. A stream has a watermark already."""
    counts = events.groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("begin"), "status", "n")


def last_status(events: DataFrame) -> DataFrame:
    """issue_id, status, ts of the last decision of each issue; equal times: the last event."""
    best = F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("e")
    return events.groupBy("issue_id").agg(best).select("issue_id", "e.status", "e.ts")


def append(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is final as Parquet, and end when all that is there has been read."""
    return counts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
