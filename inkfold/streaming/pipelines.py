"""File streams through the same operators, and event-time windows (an extension of the batch engine)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import split_text


def file_stream(spark: SparkSession, path: str, schema: T.StructType, window: int = 8, format: str = "parquet", **options: str) -> DataFrame:
    """Files of a folder as a stream, at most ``window`` in a batch."""
    reader = spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", window)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def run_available(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Works off all files that are there into Parquet, then stops. A restart goes on where it ended."""
    out = transform(stream) if transform else stream
    q = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def chunk_stream(documents: DataFrame) -> DataFrame:
    """Documents (doc_id, text) as chunks; stateless, so a stream passes through it like a table."""
    docs = documents.select(F.col("doc_id").cast("string").alias("paper_id"), "text")
    return split_text(docs).select(F.concat("paper_id", F.lit(":c"), F.col("window").cast("string")).alias("chunk_id"), F.col("piece").alias("content"))


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total: counts and sums in fixed windows, late events up to a bound."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    by = events.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"))
    return by.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, session_start, session_end (last event plus gap), n."""
    by = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return by.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
