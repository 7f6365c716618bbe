"""Feature preparation and descriptive statistics."""

from __future__ import annotations

import math
import re
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day
from ..functions.numbers import ratio
from ..operators.keyed import with_totals
from ..operators.ordered import ordered
from ..session import materialise

LEAST_SLICES, SLICES_PER_PARTITION, DRAWN = 64, 4, 4


def _unpivot(row: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """One wide row with struct columns to one row per column."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}`.{f}").alias(f) for f in fields]) for c in columns])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def _stacked(df: DataFrame, columns: list[str], value) -> DataFrame:
    """Rows (column, value) of the named columns, one below the other; ``value`` makes a column's values of one type."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns])
    return df.select(F.explode(entries).alias("e")).select("e.*")


def _names(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("column"))


def column_cardinality(df: DataFrame) -> DataFrame:
    """Exact distinct values (NULL counted as one) per column, and the row count: one scan, summed by each task first."""
    kinds = dict(df.dtypes)
    text = lambda c: (F.col(c) + 0 if kinds[c] in ("float", "double") else F.col(c)).cast("string")  # no negative zero
    counts = _stacked(df, df.columns, text).groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
    found = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("rows").alias("rows"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return _names(df, df.columns).join(F.broadcast(found), "column", "left").select("column", zero("distinct_values"), zero("rows"))


def drop_uninformative(df: DataFrame) -> DataFrame:
    """Drop columns with a single value or with all values different (NULL is a value).

    One pass finds constants by minimum and maximum; whether any value of a column occurs twice is counted exactly,
    a column with more than one NULL needs no counting.
    """
    exprs = [F.struct((F.min(c) == F.max(c)).alias("one"), F.count(c).alias("n")).alias(c) for c in df.columns]
    first = df.agg(F.count(F.lit(1)).alias("__rows"), *exprs).first()
    rows, drop = first["__rows"], []
    for c in df.columns:
        stat = first[c]
        constant = stat["n"] == 0 or (stat["one"] and stat["n"] == rows)
        if constant or (stat["n"] >= rows - 1 and df.groupBy(c).count().filter("count > 1").isEmpty()):
            drop.append(c)
    return df.drop(*drop)


def reshape(df: DataFrame, drop: list[str] = (), drop_like: str | None = None, keep: list[str] = (), rename: dict[str, str] | None = None) -> DataFrame:
    """Leave out the columns named in ``drop`` and those whose name matches ``drop_like`` (``keep`` stays), then rename."""
    left = [c for c in df.columns if c in keep or not (c in drop or (drop_like and re.search(drop_like, c)))]
    return df.select(*[F.col(f"`{c}`").alias((rename or {}).get(c, c)) for c in left])


def null_profile(df: DataFrame) -> DataFrame:
    """NULL count per column."""
    wide = df.agg(*[F.struct(F.count_if(F.col(c).isNull()).alias("nulls")).alias(c) for c in df.columns])
    return _unpivot(wide, df.columns, ["nulls"])


def coerce(df: DataFrame, numeric: list[str], dates: list[str]) -> DataFrame:
    """Text to numbers (NULL and unreadable as 0) and to dates (unreadable as NULL)."""
    casts = {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in numeric}
    return df.withColumns(casts | {c: F.col(c).try_cast("date") for c in dates})


def encode_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """True to 1, false and NULL to 0."""
    return df.withColumns({c: F.when(F.col(c), 1).otherwise(0) for c in columns})


def encode_map(col: Column, codes: dict[str, int]) -> Column:
    """Listed values to their code; NULL for others."""
    return F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[col]


def churn_labels(df: DataFrame, cancelled: str, amounts: dict[str, str]) -> DataFrame:
    """``churned`` from the cancel date, and a 0/1 flag per product amount ({amount column: flag})."""
    flags = {flag: F.when(F.col(c) > 0, 1).otherwise(0) for c, flag in amounts.items()}
    return df.withColumns({"churned": F.col(cancelled).isNotNull().cast("int")} | flags)


def tenure_days(start: Column, cancelled: Column, as_of) -> Column:
    """Days from start to cancellation (0 if before the start), else to ``as_of``."""
    return F.when(cancelled < start, 0).otherwise(F.datediff(F.coalesce(cancelled, day(as_of)), start))


def churn_share(df: DataFrame, churned: str, amount: str) -> DataFrame:
    """Percent of customers and of revenue retained and churned."""
    gone = F.col(churned) == 1
    sums = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(gone).alias("gone"), F.sum(amount).alias("m"), F.sum(F.when(gone, F.col(amount))).alias("gone_m")
    )
    percent = lambda part, whole: ratio(part * 100, whole)
    return sums.select(
        percent(F.col("n") - F.col("gone"), F.col("n")).alias("customers_stayed_pct"), percent(F.col("gone"), F.col("n")).alias("customers_churned_pct"),
        percent(F.col("m") - F.coalesce("gone_m", F.lit(0)), F.col("m")).alias("revenue_stayed_pct"),
        percent(F.coalesce("gone_m", F.lit(0)), F.col("m")).alias("revenue_churned_pct"),
    )


def _ranked_values(df: DataFrame, columns: list[str], value=F.col) -> DataFrame:
    """Distinct non-NULL values per column (column, value, rows), cut into slices of about equal size in ascending order.

    Candidates are drawn by hash, of each hash bucket the value with the least hash, so they lie as the values do,
    whatever their type and however alike they begin; every fourth of them in ascending order is a border. A value finds
    its slice in two steps, among the heads of blocks of borders and inside one block. ``value`` makes the values of all
    columns of one type.
    """
    stacked = _stacked(df, columns, value).filter(F.col("value").isNotNull())
    values = stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
    slices = max(LEAST_SLICES, SLICES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = F.xxhash64("value")
    drawn = values.groupBy("column", F.pmod(place, F.lit(DRAWN * slices)).alias("bucket")).agg(F.min_by("value", place).alias("border"))
    step = max(2, math.isqrt(slices))
    sorted_ = drawn.groupBy("column").agg(F.array_sort(F.collect_list("border")).alias("drawn"))  # one row per column
    borders = sorted_.select("column", F.filter("drawn", lambda _, i: i % DRAWN == DRAWN - 1).alias("borders"))
    borders = borders.withColumn("heads", F.filter("borders", lambda _, i: i % step == 0))
    upto = lambda array: F.size(F.filter(array, lambda c: c <= F.col("value")))
    found = values.join(F.broadcast(borders), "column").withColumn("block", F.greatest(upto("heads"), F.lit(1)))
    before = (F.col("block") - 1) * step
    return found.select("column", "value", "rows", (before + upto(F.slice("borders", before + 1, step))).alias("slice"))


def _quantiles(df: DataFrame, columns: list[str], shares: list[float], kind: str | None = None) -> DataFrame:
    """Interpolated quantiles q0, q1, .. per column that has a value, from value counts without a sort in one task."""
    values = _ranked_values(df, columns, lambda c: F.col(c).cast(kind) if kind else F.col(c))
    upto = ordered(values, ["column"], ["value"], F.col("slice"), running={"upto": "rows"})
    rows = upto.join(F.broadcast(values.groupBy("column").agg(F.sum("rows").alias("n"))), "column")
    aggs, outs = [], []
    for i, q in enumerate(shares):
        at = (F.col("n") - 1) * F.lit(q)
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.min(F.when(F.col("upto") > index, F.col("value"))).alias(f"{side}{i}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"w{i}"))
        outs.append((F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}")).alias(f"q{i}"))
    return rows.groupBy("column").agg(*aggs).select("column", *outs)


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row with the interpolated quantiles of a column, NULL without values."""
    found = _names(df, [column]).join(F.broadcast(_quantiles(df, [column], shares)), "column", "left")
    return found.drop("column")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, standard deviation, minimum, exact quartiles and maximum per column: two scans for all columns."""
    col = lambda c: F.col(c).cast("double")
    basic = {
        c: F.struct(
            F.count(c).alias("count"), F.avg(col(c)).alias("mean"), F.stddev(col(c)).alias("std"), F.min(col(c)).alias("min"), F.max(col(c)).alias("max")
        ) for c in columns
    }
    rows = _unpivot(df.agg(*[expr.alias(c) for c, expr in basic.items()]), columns, ["count", "mean", "std", "min", "max"])
    quartiles = _quantiles(df, columns, [0.25, 0.5, 0.75], "double").toDF("column", "p25", "p50", "p75")
    return rows.join(F.broadcast(quartiles), "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of every pair of columns in one pass: column_a, column_b, corr."""
    pairs = list(combinations_with_replacement(columns, 2))
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    entries = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"`{i}`").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(entries).alias("e")).select("e.*")


def histogram(df: DataFrame, column: str, by: str, bins: int = 10) -> DataFrame:
    """Row counts of equal-width bins over each class's own range; the last bin includes the maximum."""
    rows = with_totals(df.filter(F.col(column).isNotNull()), [by], lo=F.min(column), hi=F.max(column))
    x, lo, hi = F.col(column).cast("double"), F.col("lo").cast("double"), F.col("hi").cast("double")
    place = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))
    rows = rows.withColumn("bin", F.when(hi > lo, place).otherwise(bins // 2).cast("int"))
    return rows.groupBy(by, "bin").agg(F.count(F.lit(1)).alias("rows"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share of each class."""
    counts = with_totals(df.groupBy(label).agg(F.count(F.lit(1)).alias("rows")), [], total=F.sum("rows"))
    return counts.select(label, "rows", ratio(F.col("rows"), F.col("total"), 4).alias("share"))


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each column by the rank of its value among the sorted distinct values, from 0; NULL ranks last.

    All columns share one dictionary, whose values have a field for each type: it is ranked in one scan and kept, and each
    column looks its codes up in it.
    """
    kinds = dict(df.dtypes)
    types = list(dict.fromkeys(kinds[c] for c in columns))
    field = {kind: f"v{i}" for i, kind in enumerate(types)}

    def value(c):
        fields = [(F.col(c) if kind == kinds[c] else F.lit(None).cast(kind)).alias(field[kind]) for kind in types]
        return F.when(F.col(c).isNotNull(), F.struct(*fields))

    ranked = ordered(_ranked_values(df, columns, value), ["column"], ["value"], F.col("slice"), position="code")
    codes = materialise(ranked.select("column", "value", "code"))
    sizes = codes.groupBy("column").agg(F.max("code").alias("size"))
    size = sizes.agg(F.map_from_entries(F.collect_list(F.struct("column", "size"))).alias("__sizes"))  # one row
    out = df.crossJoin(F.broadcast(size))
    for c in columns:
        own = codes.filter(F.col("column") == c).select(F.col(f"value.{field[kinds[c]]}").alias(c), (F.col("code") - 1).alias("__code"))
        last = F.coalesce(F.try_element_at("__sizes", F.lit(c)), F.lit(0))
        out = out.join(own, c, "left").withColumn(c, F.coalesce("__code", last)).drop("__code")
    return out.select(*df.columns)


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0."""
    aggs = []
    for c in columns:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"__m_{c}"), F.stddev_pop(F.col(c).cast("double")).alias(f"__s_{c}")]
    rows = df.crossJoin(F.broadcast(df.agg(*aggs)))
    scaled = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns}
    return rows.withColumns(scaled).select(*df.columns)
