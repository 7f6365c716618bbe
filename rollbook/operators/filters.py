"""Row filters. Every one is a plain column predicate, so it can reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day
from ..functions.text import like_any


def exclude_value(df: DataFrame, column: str, *values) -> DataFrame:
    """Drop rows equal to any value; NULL is kept."""
    keep = ~F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    return df.filter(keep)


def is_running(start: str, end: str, as_of) -> Column:
    """Half-open [start, end) contains ``as_of``."""
    return (F.col(start) <= day(as_of)) & (F.col(end) > day(as_of))


def running_at(df: DataFrame, start: str, end: str, as_of) -> DataFrame:
    return df.filter(is_running(start, end, as_of))


def running_or_ending(df: DataFrame, start: str, end: str, as_of) -> DataFrame:
    """Running at ``as_of``, or started before it and ending on it."""
    ends = (F.col(start) < day(as_of)) & (F.col(end) >= day(as_of))
    return df.filter(is_running(start, end, as_of) | ends)


def lookback(df: DataFrame, ts: str, as_of, days: int) -> DataFrame:
    """Rows from the last ``days`` days before ``as_of`` onwards."""
    return df.filter(F.col(ts) >= F.date_sub(day(as_of), days))


def exclude_test_accounts(
    df: DataFrame, column: str, names: list[str] = (), patterns: list[str] = (), test_flag: str | None = None
) -> DataFrame:
    """Drop accounts listed by name, matching a LIKE pattern, or flagged as test."""
    if names:
        df = df.filter(~F.col(column).isin(list(names)))
    if patterns:
        df = df.filter(~like_any(F.col(column), list(patterns)))
    if test_flag:
        df = df.filter(~F.col(test_flag))
    return df
