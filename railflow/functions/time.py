"""Time fields. Times are wall-clock ``TIMESTAMP_NTZ`` of one zone, so fields need no session zone."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text pattern, zone, periods of the day (first hour, last hour, code), peak hours, holidays.
PATTERN = "yyyy-MM-dd HH:mm:ss"
ZONE = "Asia/Shanghai"
PERIODS = ((6, 9, 1), (11, 13, 2), (18, 21, 3))
MORNING_PEAK = (7, 8, 9)
EVENING_PEAK = (17, 18, 19)
HOLIDAYS = (7, 8, 9)


def _origin() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def parse_time(text: Column) -> Column:
    """Wall-clock time of a ``yyyy-MM-dd HH:mm:ss`` text; null when it does not parse."""
    return F.try_to_timestamp(text, F.lit(PATTERN)).cast("timestamp_ntz")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970-01-01 00:00:00 on the same wall clock."""
    return F.timestamp_diff("SECOND", _origin(), ts)


def text_to_epoch(text: Column, zone: str = ZONE) -> Column:
    """Unix seconds of a local time text in ``zone``."""
    return epoch_seconds(F.convert_timezone(F.lit(zone), F.lit("UTC"), parse_time(text)))


def epoch_to_text(seconds: Column, zone: str = ZONE) -> Column:
    """Local time text in ``zone`` of Unix seconds."""
    utc = F.timestamp_add("SECOND", seconds, _origin())
    return time_text(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc))


def time_text(ts: Column) -> Column:
    return F.date_format(ts, PATTERN)


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def period_of_day(ts: Column) -> Column:
    hour = F.hour(ts)
    (first, last, code), *rest = PERIODS
    out = F.when(hour.between(first, last), code)
    for first, last, code in rest:
        out = out.when(hour.between(first, last), code)
    return out.otherwise(0)


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def quarter_of_day(ts: Column) -> Column:
    return F.hour(ts) * 4 + F.floor(F.minute(ts) / 15).cast("int")


def half_hour_of_month(ts: Column) -> Column:
    return (F.dayofmonth(ts) - 1) * 48 + F.hour(ts) * 2 + F.floor(F.minute(ts) / 30).cast("int")


def two_hour_slot(ts: Column) -> Column:
    return F.floor(F.hour(ts) / 2).cast("int")


def is_weekday(ts: Column) -> Column:
    """Monday to Friday (Sunday is day 1)."""
    return F.dayofweek(ts).between(2, 6)


def is_holiday(ts: Column, days: Iterable[int] = HOLIDAYS) -> Column:
    return F.dayofmonth(ts).isin(list(days))


def peak_flags(ts: Column) -> tuple[Column, Column, Column]:
    """Morning peak, evening peak and normal-hour indicators; exactly one is 1."""
    hour = F.hour(ts)
    morning, evening = hour.isin(*MORNING_PEAK), hour.isin(*EVENING_PEAK)
    return morning.cast("int"), evening.cast("int"), (~morning & ~evening).cast("int")


def day_of(ts: Column, day_key: str = "month") -> Column:
    """Day of the month, which merges months, or with ``day_key="date"`` the day number since 1970-01-01."""
    if day_key == "month":
        return F.dayofmonth(ts)
    if day_key == "date":
        return F.unix_date(ts.cast("date"))
    raise ValueError(f"unknown day_key: {day_key}")


def trip_day(ot: Column, dt: Column, day_key: str = "month") -> Column:
    """Day of a trip that starts and ends on one day, else 0; entry and exit days are compared on the same key."""
    first, last = day_of(ot, day_key), day_of(dt, day_key)
    return F.when(first == last, first).otherwise(F.lit(0))
