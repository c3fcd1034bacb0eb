"""Time columns. Day of week counts from Sunday = 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_to_ts(seconds: Column) -> Column:
    """Epoch seconds, also fractional ones, to an instant."""
    return F.timestamp_micros(F.round(seconds.cast("double") * 1_000_000).cast("bigint"))


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def day_of_week(ts: Column) -> Column:
    return F.dayofweek(ts) - 1


def expires_at(retrieved_at: Column, ttl_seconds: Column) -> Column:
    """ISO-8601 text or timestamp plus a time to live in seconds."""
    return F.try_to_timestamp(retrieved_at.cast("string")) + F.make_interval(secs=ttl_seconds)


def is_expired(retrieved_at: Column, ttl_seconds: Column, now: Column) -> Column:
    return now > expires_at(retrieved_at, ttl_seconds)
