"""Joins between points, days and intervals, without a nested-loop join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day, shift_minutes
from .ordered import ordered


def expand_to_days(df: DataFrame, start: str, end: str, low, high, name: str = "date_key", inclusive: bool = False) -> DataFrame:
    """One row per calendar day of [start, end) (or [start, end]) within [low, high]."""
    last = F.col(end) if inclusive else F.date_sub(F.col(end), 1)
    first, last = F.greatest(F.col(start), day(low)), F.least(last, day(high))
    days = F.when(first <= last, F.sequence(first, last))
    return df.withColumn(name, F.explode(days))


def expand_to_months(df: DataFrame, start: str, end: str, low, high, name: str = "month_key", inclusive: bool = False) -> DataFrame:
    """One row per calendar month with at least one day of the interval within [low, high]."""
    last = F.col(end) if inclusive else F.date_sub(F.col(end), 1)
    first, last = F.greatest(F.col(start), day(low)), F.least(last, day(high))
    months = F.when(first <= last, F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("INTERVAL 1 MONTH")))
    return df.withColumn(name, F.explode(months))


def open_per_day(df: DataFrame, key: str, start: str, end: str, low, high, rows: str = "open_rows", keys: str = "open_keys") -> DataFrame:
    """Per calendar day in [low, high] with any open interval [start, end): the open rows and their distinct keys.

    No interval is expanded to its days. +1 is booked at an interval's first day and -1 at its end. The running sum of one
    key's moves shows when the key opens its first interval and closes its last, however they overlap; those moments are
    moves of their own, and the running sum of all moves over the calendar gives both counts. A key's running sum is cut
    into months, so a key with very many intervals is spread. NULL keys count as rows only.
    """
    cut = df.select(F.col(key).alias("key"), F.greatest(F.col(start), day(low)).alias("first"), F.least(F.col(end), F.date_add(day(high), 1)).alias("last"))
    both = F.array(F.struct(F.col("first").alias("date_key"), F.lit(1).alias("move")), F.struct(F.col("last").alias("date_key"), F.lit(-1).alias("move")))
    booked = cut.filter("first < last").select("key", F.explode(both).alias("m")).select("key", "m.date_key", "m.move")
    per_key = booked.groupBy("key", "date_key").agg(F.sum("move").alias("move"))
    seen = ordered(per_key, ["key"], ["date_key"], F.trunc("date_key", "month"), running={"now": "move"})
    before = F.col("now") - F.col("move")
    turn = F.when((before == 0) & (F.col("now") > 0), 1).when((before > 0) & (F.col("now") == 0), -1).otherwise(0)
    moves = seen.groupBy("date_key").agg(F.sum("move").alias("row_moves"), F.sum(F.when(F.col("key").isNotNull(), turn)).alias("key_moves"))
    calendar = df.sparkSession.range(1).select(F.explode(F.sequence(day(low), day(high))).alias("date_key"))
    so_far = Window.orderBy("date_key")  # one row per calendar day
    days = calendar.join(moves, "date_key", "left").select(
        "date_key", F.coalesce(F.sum("row_moves").over(so_far), F.lit(0)).alias(rows), F.coalesce(F.sum("key_moves").over(so_far), F.lit(0)).alias(keys)
    )
    return days.filter(F.col(rows) > 0)


TIER = 32  # slices of a tier that make one slice of the next
TIERS = 4  # days, some months, some years, some lifetimes


def interval_join(
    facts: DataFrame,
    validity: DataFrame,
    key: str,
    condition: Column,
    probe: Column,
    start: str = "valid_from",
    end: str = "valid_until",
    slice_seconds: int = 86_400,
) -> DataFrame:
    """Join facts to the validity intervals of the same key that contain the fact's ``probe`` time.

    Time is cut into slices in tiers, each ``TIER`` times as wide as the one below. An interval is listed once under the
    slices it touches of the tier that suits its length, so under ``TIER`` + 1 slices at most, but for those beyond the
    last tier. A fact is listed under its slice of every tier, and the join is an equi join on (key, tier, slice).
    ``condition`` is checked inside a slice and must imply ``start <= probe <= end``. A key with very many readings and
    facts is spread over its slices instead of meeting itself in one task.
    """

    def slice_of(time: Column, tier) -> Column:
        seconds = F.unix_seconds(time.cast("timestamp"))
        return F.floor(seconds / (F.lit(slice_seconds) * F.pow(F.lit(TIER), tier))).cast("bigint")

    span = slice_of(F.col(end), F.lit(0)) - slice_of(F.col(start), F.lit(0))
    tier = F.lit(TIERS - 1)
    for t in reversed(range(TIERS - 1)):
        tier = F.when(span < TIER ** (t + 1), t).otherwise(tier)
    placed = validity.withColumn("__tier", tier)
    first, last = slice_of(F.col(start), F.col("__tier")), slice_of(F.col(end), F.col("__tier"))
    right = placed.withColumn("__slice", F.explode(F.when(first <= last, F.sequence(first, last))))
    probes = F.array(*[F.struct(F.lit(t).alias("tier"), slice_of(probe, F.lit(t)).alias("slice")) for t in range(TIERS)])
    left = facts.withColumn("__probe", F.explode(probes)).withColumns({"__tier": F.col("__probe.tier"), "__slice": F.col("__probe.slice")})
    joined = left.drop("__probe").join(right, [key, "__tier", "__slice"])
    return joined.filter(condition).drop("__tier", "__slice")


def contains_with_tolerance(
    begin: Column, finish: Column, valid_from: Column, valid_until: Column, minutes: int
) -> Column:
    """Both the begin shifted later and the finish shifted earlier lie in [valid_from, valid_until)."""
    late, early = shift_minutes(begin, minutes), shift_minutes(finish, -minutes)
    return (late >= valid_from) & (late < valid_until) & (early >= valid_from) & (early < valid_until)
