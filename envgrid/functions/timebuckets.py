"""Report-day rules for UTC timestamps, and the windows that they stand for. The session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TZ = "America/New_York"
RULES = ("utc_day", "abs7", "wall7_left", "wall7_right", "utc12_right")
MICRO = "interval 1 microsecond"


def report_day(t: Column | str, rule: str = "wall7_left", tz: str = TZ, hour: int = 7) -> Column:
    """The date that a UTC timestamp counts for.

    utc_day: midnight UTC. abs7: local date of t less ``hour`` hours of elapsed time, plus one day. wall7_left and
    wall7_right: ``hour`` o'clock on the local wall clock to the next day's, the end excluded or the start excluded.
    utc12_right: 12 UTC to 12 UTC, the start excluded.
    """
    t = F.col(t) if isinstance(t, str) else t
    hours = F.expr(f"interval {hour} hours")
    if rule == "utc_day":
        return F.to_date(t)
    if rule == "abs7":
        return F.date_add(F.to_date(F.from_utc_timestamp(t - hours, tz)), 1)
    if rule == "wall7_left":
        return F.date_add(F.to_date(F.from_utc_timestamp(t, tz) - hours), 1)
    if rule == "wall7_right":
        return F.date_add(F.to_date(F.from_utc_timestamp(t, tz) - hours - F.expr(MICRO)), 1)
    if rule == "utc12_right":
        return F.date_add(F.to_date(t - F.expr("interval 12 hours") - F.expr(MICRO)), 1)
    raise ValueError(f"unknown rule {rule!r}; one of {RULES}")


def window_start(day: Column, tz: str = TZ, hour: int = 7) -> Column:
    """UTC instant at which the wall-clock window of a report date begins."""
    return F.to_utc_timestamp(F.date_sub(day, 1).cast("timestamp") + F.expr(f"interval {hour} hours"), tz)


def window_end(day: Column, tz: str = TZ, hour: int = 7) -> Column:
    """UTC instant at which the wall-clock window of a report date ends."""
    return F.to_utc_timestamp(day.cast("timestamp") + F.expr(f"interval {hour} hours"), tz)


def hourly_stamps(day: Column, tz: str = TZ, hour: int = 7) -> Column:
    """The hour-ending stamps of the window (start, end]."""
    return F.sequence(window_start(day, tz, hour) + F.expr("interval 1 hour"), window_end(day, tz, hour), F.expr("interval 1 hour"))


def expected_hours(day: Column, tz: str = TZ, hour: int = 7) -> Column:
    """24, or 23 and 25 on the days of a clock change."""
    return F.size(hourly_stamps(day, tz, hour))


def lead_day(lead_hours: Column) -> Column:
    """1 for leads up to 24 hours, 2 up to 48; none for lead 0 (an analysis) and beyond."""
    return F.when((lead_hours > 0) & (lead_hours <= 24), 1).when((lead_hours > 24) & (lead_hours <= 48), 2)
