"""Scans and incremental reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Named Parquet table below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def load_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """Delimited file with a header. The schema is required: inferring it would read the data twice."""
    return spark.read.csv(path, schema=schema, sep=sep, header=True)


def staged_projection(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Pick, order and rename columns, given as {source: target}."""
    return df.select(*[F.col(src).alias(dst) for src, dst in columns.items()])


def incremental_slice(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows whose load id lies in [low, high]; the range reaches the Parquet scan."""
    return df.filter(F.col(column).between(low, high))


def high_water_mark(history: DataFrame, column: str, name: str = "high_water_mark", **equals) -> DataFrame:
    """One row: the highest processed id among rows matching every ``equals`` value."""
    for key, value in equals.items():
        history = history.filter(F.col(key) == value)
    return history.agg(F.max(column).alias(name))
