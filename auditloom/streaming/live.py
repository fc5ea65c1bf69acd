"""Streaming forms: an extension, as the batch operators they follow have none.

Event times must be TIMESTAMP; TIMESTAMP_NTZ columns are cast, with the session in UTC.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_gate_counts(events: DataFrame, ts: str, threshold: float, conf: str, right, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Per time window: shown and correct at a threshold. Append mode gives a window out once
    the watermark has passed it, so state is the open windows only."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", window).alias("w")).agg(
        F.count("*").alias("total"), F.count_if(F.col(conf) >= threshold).alias("shown"), F.count_if((F.col(conf) >= threshold) & right).alias("correct")
    ).select(F.col("w.start").alias("start"), "total", "shown", "correct")


def live_keep_first(files: DataFrame, ts: str, digest: str, late: str = "1 hour") -> DataFrame:
    """The first file of each digest within the watermark; older digests leave the state."""
    return files.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark([digest]).drop("_ts")


def live_history(history: DataFrame, by: str) -> DataFrame:
    """A count by class that is given out anew when rows arrive (complete mode): the nearest to
    a query that views observe. Its state is one row a class."""
    return history.groupBy(by).agg(F.count("*").alias("n"))


def save_once(path: str, key: str = "id", after: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: each scan of a stream once in the history below path.

    A batch has a folder of its own, named by its number, and replaces it as a whole. If a
    query is killed between a batch's write and its commit, Spark gives the restarted query
    the same batch under the same number, and its rows replace those of the first try. Within a
    batch, rows that repeat the key are one. `after` is called when a batch is written.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.parquet(f"{path.rstrip('/')}/batch={number}", mode="overwrite")
        if after:
            after(number)

    return save
