"""Roll-ups of event streams with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Events, their sum and mean for each kind and window; rows later than `late` are left out of a stream.

    The same plan serves a stream and a table. late None: the stream has a watermark already.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each key once; a stream forgets keys that are older than `late`."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
