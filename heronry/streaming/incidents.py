"""Incidents as a stream: equal errors merged as they arrive, and counts in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def merged(errors: DataFrame) -> DataFrame:
    """One row for each fingerprint of errors (event_id, message, severity, occurrences, ts), batch or stream (complete or update mode).

    Occurrences add up, the most severe wins, and the latest message stands. The state is one row for each
    fingerprint, and partial sums are formed before the shuffle.
    """
    last = F.max(F.struct("ts", "event_id", "message"))
    found = errors.withColumn("fingerprint", T.fingerprint_error(F.col("message"))).groupBy("fingerprint")
    return found.agg(F.sum("occurrences").alias("occurrences"), F.max("severity").alias("severity"), last["message"].alias("message"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def per_window(events: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    """start, event_type, n, total of events (ts, event_type, value) in sliding windows; what comes later than `late` is left out of a stream."""
    w = F.window("ts", width, slide)
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """start, stop, user_id, n of a user's events without a pause longer than gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "user_id", "n")
