"""Session expiry as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_activity(events: DataFrame, user: str, at: str, idle: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """``(user, started, ended, events)``: runs of activity closed by an idle time.

    The same plan serves a batch and a stream; in a stream a session is emitted when
    the watermark passes its end.
    """
    source = events.withWatermark(at, late) if events.isStreaming else events
    grouped = source.groupBy(F.session_window(at, idle).alias("w"), user).agg(F.count(F.lit(1)).alias("events"))
    return grouped.select(user, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")
