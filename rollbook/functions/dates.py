"""Date and time expressions. Timestamps are UTC without zone; ``as_of`` is always an argument."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the zone in which business dates are stated.
BUSINESS_ZONE = "Europe/Berlin"


def day(value: date | str | Column) -> Column:
    """A date literal, or the column unchanged."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("date")


def moment(value: datetime | str | Column) -> Column:
    """A zone-less timestamp literal, or the column unchanged."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def local_timestamp(ts: Column, zone: str = BUSINESS_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def local_date(ts: Column, zone: str = BUSINESS_ZONE) -> Column:
    return local_timestamp(ts, zone).cast("date")


def month_of(col: Column) -> Column:
    return F.trunc(col.cast("date"), "month")


def months_between_whole(end: Column, start: Column) -> Column:
    """Completed months from ``start`` to ``end`` (31 Jan to 28 Feb is none)."""
    return F.timestamp_diff("MONTH", start, end)


def years_between_whole(end: Column, start: Column) -> Column:
    """Completed years, truncated towards zero."""
    return F.timestamp_diff("YEAR", start, end)


def seconds_between(end: Column, start: Column) -> Column:
    """Elapsed seconds with their fraction as double."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1000000.0)


def hours_between(end: Column, start: Column) -> Column:
    """Completed hours (days * 24 + hours)."""
    return F.timestamp_diff("HOUR", start, end)


def second_field(end: Column, start: Column) -> Column:
    """Only the seconds field (0 to 59.999999) of the difference: 125 s gives 5."""
    return F.extract(F.lit("SECOND"), end - start).cast("double")


def shift_minutes(ts: Column, minutes: int) -> Column:
    return ts + F.make_dt_interval(mins=F.lit(minutes))


def shift_months(col: Column, months: int | Column) -> Column:
    """Date shifted by months, clamped to the month end."""
    return F.add_months(col, months)


def time_slice(ts: Column, unit: str = "hour") -> Column:
    """Monotone time bucket used to cut long keys into bounded pieces.

    An hour keeps a key with a third of 100 TB of yearly data at a few GB per piece.
    """
    return F.date_trunc(unit, ts).cast("timestamp_ntz")
