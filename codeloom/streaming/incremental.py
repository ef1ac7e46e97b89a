"""Keeping the symbol store up to date from a stream of changed files.

Each micro-batch holds (file_path, content) of changed files; it is parsed and replaces those files' rows in one write. A batch that runs again after a
failure gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.store import SymbolStore


def latest(batch: DataFrame, key: str = "file_path", order: str = "ts") -> DataFrame:
    """The last row of each key in a batch."""
    return batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")


def maintain(stream: DataFrame, store: SymbolStore, rows_of: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the symbol rows that ``rows_of`` makes of each micro-batch."""

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.replace_files(rows_of(latest(batch)))

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their sum of values for each window and type; rows later than ``late`` are dropped by a stream, never by a batch."""
    watched = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = watched.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def read_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(path)
