"""Dates and times: zones, ranges, seasons, freshness and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Toronto"


def local_day(instant: Column, zone: str = ZONE) -> Column:
    """The calendar day of a UTC instant in a zone."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def local_hour(instant: Column, zone: str = ZONE) -> Column:
    return F.hour(F.from_utc_timestamp(instant, zone))


def clock_minutes(text: Column) -> Column:
    """Minutes of the day of H:MM or HH:MM, null for anything else."""
    ok = text.rlike(r"^([01]?[0-9]|2[0-3]):[0-5][0-9]$")
    return F.when(ok, F.split_part(text, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(text, F.lit(":"), F.lit(2)).cast("int"))


def overlaps(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """Inclusive overlap of two ranges; a missing bound of the first never overlaps."""
    return F.coalesce((start <= hi) & (end >= lo), F.lit(False))


def clock_overlaps(opens: Column, closes: Column, next_day: Column, lo: int, hi: int) -> Column:
    """Half-open overlap of minutes; closing on the next day adds a day."""
    return F.coalesce((opens < hi) & (closes + F.when(next_day, 1440).otherwise(0) > lo), F.lit(False))


def in_season(month: Column, start: Column, end: Column) -> Column:
    """Whether a month lies in a season that may wrap over the year's end; unknown bounds count as in season."""
    inside = F.when(start <= end, month.between(start, end)).otherwise((month >= start) | (month <= end))
    return F.coalesce(inside, F.lit(True))


def hours_since(then: Column, now: Column) -> Column:
    """Hours between two instants, none if the first is later."""
    return F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp(then)) / 3600)


def freshness(hours: Column, fresh: int = 24, recent: int = 72) -> Column:
    """The label of a source that was checked so many hours ago; fixed values of the catalog."""
    return F.when(hours.isNull(), "Unknown").when(hours <= fresh, "Fresh").when(hours <= recent, "Recently checked").otherwise("Stale")


def iso_date(text: Column) -> Column:
    """The first ISO date in a text; null without one, or if it isn't on the calendar."""
    found = F.regexp_extract(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return F.when(found != "", F.try_to_date(found, "yyyy-MM-dd"))


def is_single_day(start: Column, end: Column, format_: Column) -> Column:
    return F.coalesce((format_ == "single_day") | ((start == end) & (format_ != "unknown")), F.lit(False))
