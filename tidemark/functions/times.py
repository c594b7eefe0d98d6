"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_time(col: Column | str, width: str) -> Column:
    """Start of the tumbling bucket of `width` ("1 hour", "4 hours", ...) that holds the timestamp."""
    return F.window(col, width)["start"]


def epoch_seconds(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.unix_seconds(col.cast("timestamp"))


def second_of_day(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.hour(col) * 3600 + F.minute(col) * 60 + F.second(col)


def month_of(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.year(col) * 12 + F.month(col)


def trading_day(col: Column | str, offset_hours: int = 5) -> Column:
    """Calendar day at a fixed UTC offset (the trading day starts at 19:00 UTC for +5)."""
    col = F.col(col) if isinstance(col, str) else col
    return F.to_date(col + F.expr(f"INTERVAL {offset_hours} HOURS"))


def week_start(day: Column) -> Column:
    """Monday of the week of a date."""
    return F.date_sub(day, F.weekday(day))


def parse_iso(col: Column | str) -> Column:
    """ISO-8601 text (``Z`` or numeric offset allowed) as UTC wall-clock time; unreadable text becomes null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.try_to_timestamp(col).cast("timestamp_ntz")
