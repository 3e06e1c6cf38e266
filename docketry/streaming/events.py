"""Streams over the events table: windows, sessions, duplicates and incremental upserts. Extensions of the batch engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([T.StructField(n, t) for n, t in (("event_id", T.LongType()), ("ts", T.TimestampType()), ("user_id", T.LongType()), ("event_type", T.StringType()), ("value", T.DoubleType()), ("props", T.StringType()))])


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events tables of a folder, each a file or a folder of files."""
    return spark.readStream.schema(EVENTS).parquet(f"{folder}/events*.parquet")


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; works on streams and on tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def changed(previous: DataFrame, following: DataFrame, key: str, ignore: tuple[str, ...] = ("last_seen",)) -> DataFrame:
    """Rows of following that are new or differ from previous in a column that isn't ignored; nulls compare as values."""
    cols = [c for c in following.columns if c not in (key, *ignore)]
    old = previous.select(F.col(key).alias("__k"), F.struct(*cols).alias("__old"))
    rows = following.join(old, F.col(key) == F.col("__k"), "left")
    return rows.where(F.col("__k").isNull() | ~F.struct(*cols).eqNullSafe(F.col("__old"))).select(*following.columns)


def upsert_each(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Applies each micro-batch; the batch id lets ``apply`` pass over one it has seen."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
