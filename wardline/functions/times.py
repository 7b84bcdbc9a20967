"""Timestamp text to instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text forms accepted from tables.
TABLE_FORMS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ssXXX")


def table_time(text: Column) -> Column:
    """First form that fits, then ISO-8601; null when nothing fits."""
    t = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in TABLE_FORMS], F.try_to_timestamp(t))


def iso_time(text: Column) -> Column:
    return F.try_to_timestamp(F.trim(text))


def stream_time(text: Column) -> Column:
    """Clock of a stream record: blank is the epoch, an unreadable text is null."""
    t = F.trim(F.coalesce(text, F.lit("")))
    parsed = F.try_to_timestamp(F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2}) ", "$1T"))
    return F.when(t == "", F.timestamp_micros(F.lit(0))).otherwise(parsed)


def stream_time_reason(event_text: Column, ingest_text: Column) -> Column:
    """Dead-letter reason of a record whose clocks cannot be read."""
    return F.when(stream_time(event_text).isNull(), "invalid_timestamp").when(
        (F.trim(F.coalesce(ingest_text, F.lit(""))) != "") & stream_time(ingest_text).isNull(),
        "invalid_ingest_timestamp")


def lab_availability(charted: Column, stored: Column) -> Column:
    """A lab is knowable once stored, never before it was charted."""
    return F.greatest(charted, stored)


def availability(available: Column, event: Column) -> Column:
    return F.coalesce(available, event)
