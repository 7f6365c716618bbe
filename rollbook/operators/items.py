"""JSON item arrays as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import ITEM_SCHEMA


def explode_items(df: DataFrame, column: str, schema: str = ITEM_SCHEMA, keep: list[str] | None = None) -> DataFrame:
    """One row per array element with its fields as columns; parents without elements are dropped."""
    keep = keep if keep is not None else [c for c in df.columns if c != column]
    rows = df.select(*keep, F.explode(F.from_json(F.col(column), schema)).alias("item"))
    return rows.select(
        *keep,
        F.col("item.product_id").alias("product_id"),
        F.col("item.quantity").alias("quantity"),
        F.col("item.price.net.amount").alias("unit_net_cents"),
        F.col("item.total_provisioned_price.net.amount").alias("total_net_cents"),
    )


def agg_items(df: DataFrame, parent_key: str, column: str, lookup: DataFrame, *aggregates: Column) -> DataFrame:
    """One row per parent: its array joined to ``lookup`` and aggregated, NULL when nothing matched."""
    summed = (
        explode_items(df, column, keep=[parent_key])
        .join(lookup, "product_id")
        .groupBy(parent_key)
        .agg(*aggregates)
    )
    return df.join(summed, parent_key, "left")
