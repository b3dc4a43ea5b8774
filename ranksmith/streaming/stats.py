"""Event statistics: totals and trailing intervals by name, over tables and over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS, BUCKETS = 60, 5


def totals(events: DataFrame, name: str = "event_type", ts: str = "ts") -> DataFrame:
    """Count of each event name and the time of its last event."""
    return events.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("total"), F.max(ts).alias("last_event"))


def by_minute(events: DataFrame, name: str = "event_type", ts: str = "ts") -> DataFrame:
    """``name, minute`` (minutes since the epoch) and ``n``."""
    minute = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / BUCKET_SECONDS).cast("long")
    return events.groupBy(F.col(name).alias("name"), minute.alias("minute")).agg(F.count("*").alias("n"))


def trailing(events: DataFrame, name: str = "event_type", ts: str = "ts") -> DataFrame:
    """For each name and minute with events: the number in the five whole minutes before it. The window runs over one row
    for each minute, after the aggregation, so a hot name costs a row a minute."""
    w = Window.partitionBy("name").orderBy("minute").rangeBetween(-BUCKETS, -1)
    return by_minute(events, name, ts).withColumn("trailing", F.coalesce(F.sum("n").over(w), F.lit(0)))


def snapshot(events: DataFrame, now, name: str = "event_type", ts: str = "ts") -> DataFrame:
    """Totals, the count in the five whole minutes before ``now`` and minutes since the last event."""
    at = F.lit(now).cast("timestamp")
    minute = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / BUCKET_SECONDS)
    current = F.floor(F.unix_seconds(at) / BUCKET_SECONDS)
    inside = (minute >= current - BUCKETS) & (minute < current)
    out = events.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("total"), F.count_if(inside).alias("trailing"), F.max(ts).alias("last_event"))
    since = F.floor((F.unix_seconds(at) - F.unix_seconds(F.col("last_event").cast("timestamp"))) / 60)
    return out.withColumn("minutes_since_last_event", since)


def trailing_stream(events: DataFrame, name: str = "event_type", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The streaming form: counts of five-minute windows that slide by a minute, with a watermark for late events."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, "5 minutes", "1 minute"), F.col(name).alias("name")).agg(F.count("*").alias("n")).select("name", F.col("window.end").alias("minute"), "n")
