"""Streams: session windows, tumbling counts, first-seen labels with conflicts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sessions(events: DataFrame, by: str, at: str, gap: str = "8 seconds", late: str = "1 minute") -> DataFrame:
    """by, start, end, n of sessions; rows later than ``late`` are no longer waited for."""
    if events.isStreaming:
        events = events.withWatermark(at, late)
    g = events.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return g.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_counts(events: DataFrame, at: str, by: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark(at, late)
    g = events.groupBy(F.window(at, size).alias("w"), by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), by, "n")


def label_conflicts(rows: DataFrame, key: str = "key", label: str = "label") -> DataFrame:
    """key, first, other: each row whose label differs from the first one of its key, as it comes.

    State is one label a key, shared out by key.
    """

    def check(group, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first = state.get[0] if state.exists else None
        out = []
        for frame in frames:
            for value in frame[label]:
                if first is None:
                    first = value
                elif value != first:
                    out.append((group[0], first, value))
        if first is not None:
            state.update((first,))
        yield pd.DataFrame(out, columns=["key", "first", "other"])

    return rows.select(F.col(key).cast("string").alias("key"), F.col(label).cast("string").alias(label)).groupBy("key").applyInPandasWithState(
        check, "key string, first string, other string", "first string", "append", "NoTimeout"
    )
