"""Unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_tagged(tag: str, frames: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL by column name, each row tagged with the name of its frame."""
    tagged = [df.select(F.lit(name).alias(tag), *df.columns) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def union_fallback(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """All primary rows, and fallback rows whose key the primary lacks."""
    rest = fallback.join(primary.select(*keys).distinct(), keys, "left_anti")
    return primary.unionByName(rest.select(*primary.columns))
