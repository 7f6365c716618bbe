"""Joins beyond a plain equi join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag_exists(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Boolean column: does the key occur in ``other``?"""
    present = other.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(present, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def join_on_expr(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, how: str = "inner") -> DataFrame:
    """Equi join on keys derived on both sides (case-folded, trimmed, part of a name)."""
    return left.withColumn("__k", left_key).join(right.withColumn("__k", right_key), "__k", how).drop("__k")


def repair_key(col: Column, sentinel: str, to: str | None = None) -> Column:
    """Replace a sentinel key by another key, or by NULL."""
    return F.when(col == sentinel, F.lit(to)).otherwise(col) if to is not None else F.nullif(col, F.lit(sentinel))


def two_grain(df: DataFrame, fine: list[str], coarse: list[str], fine_agg: Column, coarse_agg: Column) -> DataFrame:
    """Aggregate at a fine and a coarse grain (``coarse`` within ``fine``) and put both on the fine rows.

    The coarse value must be derivable from the fine rows, so the input is read once: ``coarse_agg``
    is applied to the aggregated fine rows.
    """
    by_fine = df.groupBy(*fine).agg(fine_agg)
    return by_fine.join(by_fine.groupBy(*coarse).agg(coarse_agg), coarse)
