"""Landed pages and events as streams: each address once, windowed counts, latest value per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landed(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_seen(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark; the state holds no more than the watermark's keys."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, at: str, by: list[str], window: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of `value` per time window and group; late rows beyond the watermark are left out."""
    slot = F.window(at, window, slide) if slide else F.window(at, window)
    out = stream.withWatermark(at, late).groupBy(slot.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(stream: DataFrame, at: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: a new one after each pause longer than `gap`."""
    out = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs `work` on every micro-batch of what has landed, then stops; the checkpoint makes it continue after a loss."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
