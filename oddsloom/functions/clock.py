"""Parsing and comparing clocks. Everything becomes a UTC timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
_OFFSET = r"([+-]\d{2}:?\d{2}|[Zz])$"


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def from_iso_with_offset(text: Column) -> Column:
    """ISO text; null unless it carries a UTC offset."""
    clean = F.trim(text)
    spelled = F.regexp_replace(clean, r"([+-]\d{2})(\d{2})$", "$1:$2")
    shaped = clean.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}") & clean.rlike(_OFFSET)
    return F.when(shaped, spelled.try_cast("timestamp"))


def from_local(text: Column, zone: str) -> Column:
    """Wall clock of ``zone`` in the plain layout; null for any other layout."""
    clean = F.trim(text)
    wall = F.when(clean.rlike(_PLAIN), F.try_to_timestamp(clean, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.to_utc_timestamp(wall, zone)


def from_utc_text(text: Column) -> Column:
    clean = F.trim(text)
    return F.when(clean.rlike(_PLAIN), F.try_to_timestamp(clean, F.lit("yyyy-MM-dd HH:mm:ss")))


def update_after_start(updated: Column, started: Column) -> Column:
    """An update stamped at or before the start says nothing about the result."""
    return F.when(updated > started, updated)


def earliest_available(settled: Column, updated: Column, observed: Column) -> Column:
    """Feature rule: the first clock at which a result was known anywhere."""
    return F.least(settled, updated, observed)


def preferred_available(observed: Column, updated: Column, settled: Column) -> Column:
    """Corridor rule: our own observation first, then the source clocks."""
    return F.coalesce(observed, updated, settled)


def local_midnight(now: Column, zone: str) -> Column:
    """UTC instant at which the current local day of ``zone`` began."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(now, zone)), zone)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def plus_seconds(at: Column, seconds: Column | float) -> Column:
    step = F.lit(seconds) if isinstance(seconds, (int, float)) else seconds
    return F.timestamp_micros(F.unix_micros(at) + (step * 1000000).cast("long"))
