"""Durations and log URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nanoseconds of each unit, largest first.
UNITS = {"y": 365 * 86400 * 10**9, "w": 7 * 86400 * 10**9, "d": 86400 * 10**9, "h": 3600 * 10**9, "m": 60 * 10**9, "s": 10**9, "ms": 10**6, "us": 10**3, "ns": 1}


def parse_duration(text: Column) -> Column:
    """Nanoseconds of a number with a unit; null if it is neither."""
    number, unit = F.regexp_extract(text, r"^(\d+)(y|w|d|h|ms|m|us|s|ns)$", 1), F.regexp_extract(text, r"^(\d+)(y|w|d|h|ms|m|us|s|ns)$", 2)
    out = F.lit(None).cast("long")
    for u, n in UNITS.items():
        out = F.when(unit == u, number.cast("long") * n).otherwise(out)
    return out


def format_duration(ns: Column) -> Column:
    """The largest unit that divides exactly; ``0s`` for nothing."""
    out = F.when(ns == 0, F.lit("0s"))
    for u, n in UNITS.items():
        out = out.when(ns % n == 0, F.concat((ns / F.lit(n)).cast("long").cast("string"), F.lit(u)))
    return out


def log_url(folder: Column) -> Column:
    """The URL that an ingest folder's name stands for; null without scheme and host."""
    url = F.translate(F.element_at(F.split(folder, "/"), -1), "_", "/")
    return F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+"), url)


def from_seconds(seconds: Column) -> Column:
    """The time of unix seconds."""
    return F.timestamp_seconds(seconds)


def to_seconds(time: Column) -> Column:
    """Whole unix seconds of a time."""
    return F.unix_timestamp(time)


def time_of_day(text: Column) -> Column:
    """Seconds after midnight of ``HH:MM`` or ``HH:MM:SS``; an error for anything else."""
    fine = text.rlike(r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d)?$")
    part = lambda k: F.coalesce(F.try_element_at(F.split(text, ":"), F.lit(k)).cast("int"), F.lit(0))
    return F.when(fine, part(1) * 3600 + part(2) * 60 + part(3)).otherwise(F.raise_error(F.concat(F.lit("not a time of day: "), text)))


def next_time_of_day(now: Column, seconds: Column) -> Column:
    """The next time (UTC) after ``now`` that is so many seconds after midnight."""
    today = F.unix_seconds(F.date_trunc("day", now)) + seconds
    return F.timestamp_seconds(F.when(today > F.unix_seconds(now), today).otherwise(today + 86400))
