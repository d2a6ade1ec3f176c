"""Streams: the same transforms on event time, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import transforms


def _marked(df: DataFrame, time: str, late: str) -> DataFrame:
    """Streams get a watermark, which needs a timestamp with a time zone; times without one are read in the session's."""
    if not df.isStreaming:
        return df
    if isinstance(df.schema[time].dataType, T.TimestampNTZType):
        df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, late)


def tumbling(df: DataFrame, time: str, size: str, keys: list[str], aggregates: dict[str, Column], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Aggregates of each window and key; rows later than ``late`` are left out. ``slide`` makes windows overlap."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    marked = _marked(df, time, late)
    out = marked.groupBy(window.alias("w"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggregates: dict[str, Column], late: str = "10 minutes") -> DataFrame:
    """Aggregates of each run of rows of a key that lie less than ``gap`` apart."""
    marked = _marked(df, time, late)
    out = marked.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)


def transformed(df: DataFrame, steps: list[dict], path: str, checkpoint: str) -> StreamingQuery:
    """Transforms of each micro-batch, appended as Parquet."""

    def write(batch: DataFrame, epoch: int) -> None:
        transforms.apply(batch, steps).write.mode("append").parquet(path)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
