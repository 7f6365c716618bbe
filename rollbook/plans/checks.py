"""Data checks: each yields the violating rows; ``run_checks`` counts them in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import moment


def unmapped_products(plans: DataFrame, group: str = "Other", known: list[str] = ()) -> DataFrame:
    """Recurring plans that fell into the rest group."""
    return plans.filter((F.col("product_group") == group) & ~F.col("plan_id").isin(list(known))).distinct()


def impossible_times(df: DataFrame, column: str, earliest, as_of) -> DataFrame:
    """Rows before ``earliest`` or after ``as_of``."""
    return df.filter((F.col(column) < moment(earliest)) | (F.col(column) > moment(as_of)))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def run_checks(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per check with the number of violations."""
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("check"), "rows") for name, df in checks.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)
