"""Heartbeat watch on a stream: a node that stays silent too long turns grey."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGE_EARLY = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def outages(stream: DataFrame, timeout_seconds: float, watermark: str) -> DataFrame:
    """Periods of activity per node and the moment at which the silence after them is too long.

    `stream` has node and ts. A session lasts while no gap exceeds the timeout; its end is
    the alarm. A silence of exactly the timeout does not alarm, so the window is one
    microsecond longer. A row appears once the watermark passes its alarm, hence not for
    periods that are still open when the stream ends; `graph.activity_periods` gives those
    too, from the stored events.

    Sessions of a node are merged inside each task before the shuffle, so a hot node sends
    a row per session and task.
    """
    stream.sparkSession.conf.set(MERGE_EARLY, "true")
    gap = f"{int(timeout_seconds * 1_000_000) + 1} microseconds"
    moments = stream.select("node", F.col("ts").cast("timestamp").alias("ts"))
    watched = moments.withWatermark("ts", watermark)
    sessions = watched.groupBy("node", F.session_window("ts", gap).alias("_session")).agg(
        F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_seen")
    )
    return sessions.select(
        "node",
        F.col("_session.start").alias("first_seen"),
        "last_seen",
        "events",
        F.col("_session.end").alias("grey_at"),
    )
