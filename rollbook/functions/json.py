"""JSON text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEM_SCHEMA = (
    "array<struct<product_id:string, quantity:int, price:struct<net:struct<amount:bigint>>, "
    "total_provisioned_price:struct<net:struct<amount:bigint>>>>"
)


def json_get(col: Column, path: str, kind: str = "string") -> Column:
    """Value at a dotted path as ``kind``; NULL when missing or not castable."""
    value = F.get_json_object(col, "$." + path)
    return value if kind == "string" else value.try_cast(kind)


def has_json(col: Column, path: str) -> Column:
    """True when the key is present and not an empty array."""
    value = json_get(col, path)
    return F.coalesce(value != "[]", F.lit(False))


def json_flag(col: Column, path: str) -> Column:
    """True when the nested value reads ``true``."""
    return F.coalesce(json_get(col, path) == "true", F.lit(False))


def discount_type(col: Column) -> Column:
    return json_get(col, "type")


def discount_value(col: Column) -> Column:
    """Percentage or amount, chosen by the type tag."""
    kind = discount_type(col)
    return F.when(kind == "percentage", json_get(col, "value", "decimal(8,2)")).when(
        kind == "amount", json_get(col, "value.amount", "decimal(8,2)")
    )


def format_address(col: Column, category: Column, private: str = "PRIVATE") -> Column:
    """``street, postal - city, country``, or the venue name without a street; NULL for private rows."""
    street = json_get(col, "streetName")
    full = F.concat(
        street, F.lit(", "), json_get(col, "postalCode"), F.lit(" - "), json_get(col, "city"), F.lit(", "),
        json_get(col, "country"),
    )
    return F.when(category != private, F.when(street.isNotNull(), full).otherwise(json_get(col, "venueName")))
