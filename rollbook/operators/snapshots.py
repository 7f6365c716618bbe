"""Table changes expressed as new snapshots, and the repair of slowly changing dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import moment
from .keyed import first_rows
from .ordered import ordered


def apply_correction(df: DataFrame, corrections: DataFrame, key: str, column: str) -> DataFrame:
    """Replace ``column`` where ``corrections`` (key, column) has a value for the key."""
    fix = corrections.select(F.col(key), F.col(column).alias("__new"))
    merged = df.join(fix, key, "left").withColumn(column, F.coalesce("__new", column))
    return merged.select(*df.columns)


def drop_duplicate_versions(df: DataFrame, name: str = "domain_name") -> DataFrame:
    """Keep the lowest key of each (name, version)."""
    return first_rows(df, [name, "version_nr"], ["domain_key"])


def _key_slice(rows_per_slice: int = 100_000) -> Column:
    return F.floor(F.col("domain_key") / rows_per_slice)


def raise_valid_from(df: DataFrame, as_of, name: str = "domain_name") -> DataFrame:
    """Where the previous version ends after this one starts (and before ``as_of``), start at that end."""
    seen = ordered(df, [name], ["domain_key"], _key_slice(), lag={"__prev_to": "valid_to_ts"})
    fix = (F.col("__prev_to") > F.col("valid_from_ts")) & (F.col("__prev_to") < moment(as_of))
    return seen.withColumn("valid_from_ts", F.when(fix, F.col("__prev_to")).otherwise(F.col("valid_from_ts"))).select(*df.columns)


def lower_valid_to(df: DataFrame, as_of, name: str = "domain_name") -> DataFrame:
    """Where the next version starts before this one ends (and before ``as_of``), end at that start."""
    seen = ordered(df, [name], ["domain_key"], _key_slice(), lead={"__next_from": "valid_from_ts"})
    fix = (F.col("__next_from") < F.col("valid_to_ts")) & (F.col("__next_from") < moment(as_of))
    return seen.withColumn("valid_to_ts", F.when(fix, F.col("__next_from")).otherwise(F.col("valid_to_ts"))).select(*df.columns)


def clear_last_flag(df: DataFrame, as_of) -> DataFrame:
    """A version that has ended is not the last one."""
    ended = F.col("valid_to_ts") < moment(as_of)
    return df.withColumn("is_last_version", F.when(ended, F.lit(False)).otherwise(F.col("is_last_version")))


def repair_scd2(df: DataFrame, as_of, name: str = "domain_name") -> DataFrame:
    """Duplicates, then starts, then ends (which must see the repaired starts), then the flag."""
    return clear_last_flag(lower_valid_to(raise_valid_from(drop_duplicate_versions(df, name), as_of, name), as_of, name), as_of)


def collapse_versions(df: DataFrame, name: str = "domain_name") -> DataFrame:
    """Keep one row of versions that differ in nothing but key and number."""
    same = [c for c in df.columns if c not in {"domain_key", "version_nr"}]
    return first_rows(df, same, ["domain_key"])
