"""Queue and session semantics on Structured Streaming. Every function takes and returns an unbounded DataFrame.

``ts`` may be a timestamp without zone: it is read as UTC, since event time must carry a zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(stream: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def aligned_counts(stream: DataFrame, key: str, width: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Hits per key and epoch-aligned window; state ends with the watermark."""
    w = F.window(ts, width)
    out = with_event_time(stream, ts, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("hits"))
    return out.select(key, F.col("w.start").alias("opened"), "hits")


def first_seen(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """One row for each key within the watermark."""
    return with_event_time(stream, ts, late).dropDuplicatesWithinWatermark(keys)
