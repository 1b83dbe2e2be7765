"""Streams over landing folders; each has a batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.storage import new_path
from feedloom.functions.text import noon_window


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that has landed (availableNow) and returns what it wrote; safe to repeat, as the checkpoint keeps offsets."""
    spark = stream.sparkSession
    out, mark = new_path(spark, "stream"), new_path(spark, "offsets")
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", mark).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def noon_counts(stream: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    """Rows of each day from noon to noon, once the watermark has passed it."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day", "1 day", "4 hours")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "n")


def noon_counts_batch(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(noon_window(F.col(ts)).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def once_per_key(stream: DataFrame, key: str, ts: str, late: str = "40 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def idle_sessions(stream: DataFrame, key: str, ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(key, started, timed_out, events) of runs of a key that had nothing for `gap`, once the watermark has passed it: what is still running isn't reported."""
    windows = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("events"))
    return windows.select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("timed_out"), "events")


def effective(stream: DataFrame, published: str, observed: str) -> DataFrame:
    """Adds at and method: when a row was published, or, where its source doesn't say, when it was observed."""
    return stream.withColumns({"at": F.coalesce(published, observed), "method": F.when(F.col(published).isNotNull(), "source").otherwise("observation")})


def within(stream: DataFrame, published: str, observed: str, start, end) -> DataFrame:
    """Rows of the window [start, end) by their effective time; old content that is observed again isn't the window's."""
    return effective(stream, published, observed).where((F.col("at") >= F.lit(start).cast("timestamp")) & (F.col("at") < F.lit(end).cast("timestamp")))


def emit_changes(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, value) of rows whose value differs from the last one emitted for their key."""
    chosen = stream.select(key, order, value)
    state = stream.select(value).schema

    def step(k: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        last = held.get[0] if held.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        keep = []
        # a null is a value of its own; in pandas it would differ from itself
        for v in rows[value].astype(object).where(rows[value].notna(), None):
            keep.append(v != last or not (keep or held.exists))
            last = v
        held.update((last,))
        yield rows[keep][[key, order, value]]

    return chosen.groupBy(key).applyInPandasWithState(step, chosen.schema, state, "append", "NoTimeout")
