"""Aggregate expressions and grouped shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import with_totals


def sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def has_value(col: Column, value, condition: Column | None = None) -> Column:
    """Does the group contain ``value``? False for an empty group."""
    hit = col == value if condition is None else (col == value) & condition
    return F.coalesce(F.bool_or(hit), F.lit(False))


def any_true(col: Column) -> Column:
    """Three-valued ANY: true if any is true, NULL if none is but some is NULL, else false."""
    return F.when(F.bool_or(col), F.lit(True)).when(F.count(col) == F.count(F.lit(1)), F.bool_or(col))


def priority_status(col: Column, order: list[str]) -> Column:
    """The first status of ``order`` that occurs in the group, NULL if none does."""
    rank = F.array_position(F.lit(order), col)
    best = F.min(F.when(rank > 0, rank)).cast("int")
    return F.try_element_at(F.lit(order), best)


def text_list(col: Column, separator: str = ",", distinct: bool = True) -> Column:
    """Sorted, joined text; duplicates are dropped on the map side. NULL for a group without values."""
    collected = F.collect_set(col) if distinct else F.collect_list(col)
    return F.when(F.count(col) > 0, F.array_join(F.array_sort(collected), separator))


def pivot_sum(df: DataFrame, keys: list[str], category: str, values: dict[str, str], amount: str, other: str | None = None) -> DataFrame:
    """Sum of ``amount`` per category value as columns ({value: column}), with an optional rest column."""
    col, aggs = F.col(category), []
    for value, name in values.items():
        aggs.append(F.coalesce(sum_if(col == value, F.col(amount)), F.lit(0)).alias(name))
    if other:
        aggs.append(F.coalesce(sum_if(~col.isin(list(values)), F.col(amount)), F.lit(0)).alias(other))
    return df.groupBy(*keys).agg(*aggs)


def count_over_rollup(df: DataFrame, group: Column, name: str, counted: str | None = None) -> DataFrame:
    """Add the number of rows (or non-NULL ``counted``) in the rolled-up group of each row."""
    marked = df.withColumn("__group", group)
    count = F.count(F.lit(1) if counted is None else F.col(counted))
    return with_totals(marked, ["__group"], **{name: count}).drop("__group")
