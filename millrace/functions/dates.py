"""Date and time scalars.  Days and hours follow the session time zone."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of_millis(ts: Column | str) -> Column:
    """FN-8: epoch milliseconds to ``yyyy-MM-dd``."""
    return F.date_format(F.timestamp_millis(_col(ts)), "yyyy-MM-dd")


def hour_of_millis(ts: Column | str) -> Column:
    """FN-9: epoch milliseconds to a two-digit hour."""
    return F.date_format(F.timestamp_millis(_col(ts)), "HH")


def day_start(ts: Column | str) -> Column:
    """Start of the day of epoch milliseconds, a timestamp fit for a watermark."""
    return F.date_trunc("day", F.timestamp_millis(_col(ts)))


def date_part(text: Column | str) -> Column:
    """FN-10: date of ``yyyy-MM-dd HH:mm:ss`` text."""
    return F.split_part(_col(text), F.lit(" "), F.lit(1))


def hour_part(text: Column | str) -> Column:
    """FN-10: hour of ``yyyy-MM-dd HH:mm:ss`` text."""
    clock = F.split_part(_col(text), F.lit(" "), F.lit(2))
    return F.nullif(F.split_part(clock, F.lit(":"), F.lit(1)), F.lit(""))


def as_of_date(as_of: str | date | None) -> Column:
    """FN-12: today, or a fixed day for repeatable results."""
    return F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")


def whole_years(birthday: Column | str, as_of: Column) -> Column:
    """FN-11 and FN-13: full years from ISO date text to ``as_of``; null if not a date."""
    born = F.try_to_date(_col(birthday), "yyyy-MM-dd")
    return F.timestamp_diff("YEAR", born, as_of).cast("int")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
