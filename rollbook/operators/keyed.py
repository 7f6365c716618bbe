"""One-row-per-key selection and partition totals.

Totals are computed by aggregation and joined back instead of with an un-ordered window: the
aggregation combines on the map side and the join can be split by AQE, so one key holding a large
share of all rows never lands in a single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi join on ``keys`` in which NULL equals NULL; keeps the key columns of ``left`` once."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def with_totals(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Add ``aggregate OVER (PARTITION BY keys)`` columns; with no keys the totals are global."""
    exprs = [expr.alias(name) for name, expr in aggregates.items()]
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*exprs)))  # one row
    return join_null_safe(df, df.groupBy(*keys).agg(*exprs), keys)


def with_totals_by(df: DataFrame, *levels: tuple[list[str], dict[str, Column]], source: DataFrame | None = None) -> DataFrame:
    """Totals over several key sets, each aggregated from ``source`` or ``df`` itself rather than from the previous result."""
    out = df
    for keys, aggregates in levels:
        totals = (df if source is None else source).groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggregates.items()])
        out = join_null_safe(out, totals, keys)
    return out


def with_totals_at(df: DataFrame, *grains: tuple) -> DataFrame:
    """Totals over several key sets as in ``with_totals_by``, for wide rows.

    A grain is its keys and levels of subsets of them, as ``with_totals_by`` takes. The totals of the levels meet on the
    distinct keys, which are narrow, and the rows of ``df`` are exchanged once for each grain.
    """
    out = df
    for keys, *levels in grains:
        out = join_null_safe(out, with_totals_by(df.select(*keys).distinct(), *levels, source=df), keys)
    return out


def numbered(df: DataFrame, key: str, name: str = "__nr") -> DataFrame:
    """The rows exchanged by ``key`` and numbered within it from 1, in order of all their columns, as ``name``.

    For frames with several readers: the number wants all columns and its filter, which drops no row, wants the number,
    so every reader plans the same exchange and Spark runs it once. Equal rows may swap numbers from reader to reader.
    A key's rows are sorted in one task: pass keys whose rows are bounded, as the rows of one order.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*df.columns))
    return df.repartition(key).withColumn(name, place).filter(F.col(name) > 0)


MERGE = {"sum": F.sum, "min": F.min, "max": F.max, "any": F.bool_or}


def spread_totals(df: DataFrame, keys: list[str], totals: dict[str, tuple[str, str]], parts: int = 32) -> DataFrame:
    """Add totals per key, reading ``df`` once. totals: name -> (kind, column), kind one of sum, min, max, any.

    Rows are exchanged once, a key's rows over ``parts`` parts by a hash of their columns. Each part is totalled where it
    lies, one row of each part is merged per key, and the merged totals go back on the exchanged parts. Unlike
    ``with_totals``, an expensive input is not computed a second time; a hot key meets in no task. Pass only the columns
    you need: where some are dropped later, the two readers of the exchange differ and the input is read twice.
    """
    cut = df.withColumn("__k", F.struct(*keys, F.pmod(F.xxhash64(*df.columns), F.lit(parts)).alias("__part")))
    part, key = Window.partitionBy("__k"), Window.partitionBy(*[F.col(f"__k.{k}") for k in keys])
    rows = cut.select("*", *[MERGE[kind](column).over(part).alias(f"__p_{name}") for name, (kind, column) in totals.items()])
    # ordered by all columns only to want them all: both readers of the exchange are then the same
    ends = rows.withColumn("__after", F.lead(F.lit(1)).over(part.orderBy(*df.columns))).filter("__after IS NULL")
    merged = ends.select(F.col("__k").alias("__of"), *[MERGE[kind](f"__p_{name}").over(key).alias(name) for name, (kind, _) in totals.items()])
    joined = rows.join(merged, F.col("__k") == F.col("__of"), "left")
    # a part's own total is never wanted, but it keeps the rows on the exchange that both readers share
    return joined.select(*df.columns, *[F.coalesce(name, f"__p_{name}").alias(name) for name in totals])


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key under ``order``, which must end in a unique column.

    ``row_number() = 1`` is planned with a group limit before the shuffle: one row per key and map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")


def top_rank(df: DataFrame, keys: list[str], order_column: str, ascending: bool = True) -> DataFrame:
    """All rows tied for the first rank per key (NULL ranks last)."""
    best = F.min(order_column) if ascending else F.max(order_column)
    return with_totals(df, keys, __best=best).filter(F.col(order_column).eqNullSafe(F.col("__best"))).drop("__best")


def rows_at_max(df: DataFrame, keys: list[str], column: str, lowest: bool = False) -> DataFrame:
    """Rows holding the maximum (or minimum) of ``column`` per key; ties kept, NULL dropped."""
    best = F.min(column) if lowest else F.max(column)
    return with_totals(df, keys, __best=best).filter(F.col(column) == F.col("__best")).drop("__best")


def _order_key(columns: list[str]) -> Column:
    return F.struct(*columns)


def duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Later rows of each key (row number above 1) under a unique ascending order."""
    marked = with_totals(df, keys, __first=F.min(_order_key(order)))
    return marked.filter(_order_key(order) > F.col("__first")).drop("__first")


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The complement of ``duplicates``: one row per key."""
    return latest_per_key(df, keys, [F.col(c).asc() for c in order])


def first_value(df: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """One row per key with ``columns`` of its first row under ``order``."""
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), _order_key(order)).alias("__row"))
    return picked.select(*keys, "__row.*")


def latest_snapshot(df: DataFrame, column: str) -> DataFrame:
    """Rows of the highest ``column`` value (a one-row subquery, broadcast)."""
    return rows_at_max(df, [], column)


def order_by_list(col: Column, values: list[str]) -> Column:
    """Sort key: position in ``values``; anything else last."""
    position = F.array_position(F.lit(values), col)
    return F.nullif(position, F.lit(0)).asc_nulls_last()


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Row count against distinct key count."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("distinct_keys"))
