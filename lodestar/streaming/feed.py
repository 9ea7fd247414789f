"""Structured Streaming forms of the feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.events import entry_fault
from .replay import Anchored, Limited, Throttled, replayed


def anchored_dedupe_stream(events: DataFrame, seconds: int) -> DataFrame:
    """(user_id, event_type, event_id, ts) of events with a watermark on ts that open a window of their user and type."""
    return replayed(events, ["user_id", "event_type"], "ts", "event_id", Anchored(seconds))


def minute_counts_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events of each type and minute, emitted once no later ones are admitted."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("minute"), "event_type", "n")


def valid_stream(entries: DataFrame) -> DataFrame:
    """Entries (code, owner, note) that pass validation."""
    return entries.where(entry_fault(F.col("code"), F.col("owner"), F.col("note")).isNull())


def rate_limited_stream(events: DataFrame, client: str, per_minute: int, per_day: int) -> DataFrame:
    """(client, event_id, ts, allowed) of events with a watermark on ts."""
    return replayed(events, [client], "ts", "event_id", Limited(per_minute, per_day))


def throttled_stream(events: DataFrame, client: str, seconds: int, most: int) -> DataFrame:
    """(client, event_id, ts, recent, throttled) of events with a watermark on ts."""
    return replayed(events, [client], "ts", "event_id", Throttled(seconds, most))
