"""Ordered windows over keys of any size.

A window with ORDER BY puts all rows of a key into one task. Here each key is cut into slices by a
monotone function of its order column (for example the day), and the rows are exchanged once, by
(key, slice). The window runs there; what crosses a slice border - the first and last row, the sum, the
row count - is read off the last row of each slice in the same exchanged and sorted rows. Those border rows are
few (the calendar bounds their number per key) and go back to the slices by a join on the exchanged key.

Border rows carry all columns of their row, so that both readers of the exchange want the same columns and
Spark plans it once. A caller should pass only the columns it needs: if columns are dropped later, the
optimizer narrows one reader, and the input is read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.dates import time_slice


def _sliced(df: DataFrame, keys: list[str], slice_by: Column, order: list[str]) -> tuple[DataFrame, WindowSpec, WindowSpec]:
    """Rows with ``__k``, the key columns and the slice in one struct (NULL keys are equal inside it); the window inside
    a slice and the window over the slices of a key.

    Inside a slice the keys are constant. They are named in its order all the same, so that both readers of the
    exchange want them, and conditions on them (pushed below a window only if it is partitioned by them) stay above.
    """
    cut = df.withColumn("__k", F.struct(*[F.col(k) for k in keys], slice_by.alias("__s")))
    return cut, Window.partitionBy("__k").orderBy(*keys, *order), Window.partitionBy(*keys).orderBy("__k")


def _slice_ends(rows: DataFrame, df: DataFrame, keys: list[str], local: WindowSpec, *columns: str) -> DataFrame:
    """The last row of each slice, whole."""
    last = rows.withColumn("__after", F.lead(F.lit(1)).over(local)).filter("__after IS NULL")
    return last.select("__k", *keys, F.struct(*[F.col(c) for c in df.columns]).alias("__whole"), *columns)


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slice_by: Column,
    lead: dict[str, str] | None = None,
    lag: dict[str, str] | None = None,
    running: dict[str, str] | None = None,
    position: str | None = None,
) -> DataFrame:
    """Add LEAD, LAG, running SUM (default RANGE frame) and ROW_NUMBER columns.

    ``lead``, ``lag`` and ``running`` map an output name to a source column. ``slice_by`` must not
    decrease along ``order``; rows equal in ``order`` must share a slice. Order ascending, NULL first.
    """
    lead, lag, running = lead or {}, lag or {}, running or {}
    cut, local, between = _sliced(df, keys, slice_by, order)
    before = between.rowsBetween(Window.unboundedPreceding, -1)

    columns, borders = [], [F.lag("__whole").over(between).isNull().alias("__opens"), F.lead("__whole").over(between).isNull().alias("__closes")]
    if lead:
        source = F.struct(*[F.col(c).alias(o) for o, c in lead.items()])
        columns += [F.lead(source).over(local).alias("__next"), F.first(source).over(local).alias("__head")]
        borders.append(F.lead("__head").over(between).alias("__next_head"))
    if lag:
        source = F.struct(*[F.col(c).alias(o) for o, c in lag.items()])
        columns += [F.lag(source).over(local).alias("__prev"), F.first(source).over(local.rowsBetween(0, 0)).alias("__tail")]
        borders.append(F.lag("__tail").over(between).alias("__prev_tail"))
    for out, column in running.items():
        columns.append(F.sum(column).over(local).alias(f"__run_{out}"))
        borders.append(F.sum(f"__run_{out}").over(before).alias(f"__base_{out}"))
    if position:
        columns.append(F.row_number().over(local).alias("__pos"))
        borders.append(F.sum("__pos").over(before).alias("__base"))

    rows = cut.select("*", *columns)
    carried = ["__head"] * bool(lead) + ["__tail"] * bool(lag) + [f"__run_{o}" for o in running] + ["__pos"] * bool(position)
    steps = _slice_ends(rows, df, keys, local, *carried).select(F.col("__k").alias("__of"), *borders)
    joined = rows.join(steps, F.col("__k") == F.col("__of"), "left")

    opens, closes = F.col("__opens"), F.col("__closes")
    out = [F.col(c) for c in df.columns if c not in {*lead, *lag, *running, position}]
    out += [F.coalesce("__next", F.when(~closes, F.col("__next_head")))[o].alias(o) for o in lead]
    out += [F.coalesce("__prev", F.when(~opens, F.col("__prev_tail")))[o].alias(o) for o in lag]
    for name in running:
        local_sum, base = F.col(f"__run_{name}"), F.when(~opens, F.col(f"__base_{name}"))
        out.append(F.coalesce(local_sum + base, local_sum, base).alias(name))
    if position:
        out.append((F.col("__pos") + F.when(opens, 0).otherwise(F.col("__base"))).alias(position))
    return joined.select(*out)


def validity_intervals(
    df: DataFrame, keys: list[str], ts: str, tie: list[str], slice_by: Column, open_end: Column,
    start: str = "valid_from", end: str = "valid_until",
) -> DataFrame:
    """Turn point readings into half-open intervals; the last one ends at ``open_end``."""
    out = ordered(df, keys, [ts, *tie], slice_by, lead={end: ts})
    return out.withColumn(start, F.col(ts)).withColumn(end, F.coalesce(end, open_end))


def latest_before(
    facts: DataFrame, points: DataFrame, keys: list[str], fact_ts: Column, point_ts: str, tie: list[str], unit: str = "hour"
) -> DataFrame:
    """As-of join: each fact with the key's latest point at or before ``fact_ts`` (NULL if there is none).

    Facts and points are merged in time order, and the last point seen is carried forward - inside a time
    slice by a window, from earlier slices by one row per (key, slice). Linear in both inputs.
    """
    own, given = ([c for c in df.columns if c not in keys] for df in (points, facts))
    # in an array, as the optimizer would take single fields out of a struct for one reader of the exchange only
    fact, point = F.array(F.struct(*given)), F.struct(*own)
    merged = facts.select(*keys, fact.alias("__fact"), fact_ts.alias("__ts"), F.lit(1).alias("__kind")).unionByName(
        points.select(*keys, point.alias("__point"), F.col(point_ts).alias("__ts"), F.lit(0).alias("__kind"), F.struct(*tie).alias("__tie")),
        allowMissingColumns=True,
    )
    cut, local, between = _sliced(merged, keys, time_slice(F.col("__ts"), unit), ["__ts", "__kind", "__tie"])
    earlier = between.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last("__point", ignorenulls=True).over(local.rowsBetween(Window.unboundedPreceding, 0))
    rows = cut.withColumn("__seen", seen)
    steps = _slice_ends(rows, merged, keys, local, "__seen").select(
        F.col("__k").alias("__of"), F.lag("__whole").over(between).isNull().alias("__opens"),
        F.last("__seen", ignorenulls=True).over(earlier).alias("__carried"),
    )
    joined = rows.join(steps, F.col("__k") == F.col("__of"), "left").filter("__kind = 1")
    found = F.coalesce("__seen", F.when(~F.col("__opens"), F.col("__carried")))
    whole = joined.select(*keys, F.element_at("__fact", 1).alias("__f"), found.alias("__p"))
    return whole.select(*[F.col(c if c in keys else f"__f.{c}") for c in facts.columns], "__p.*")


def crossing_time(
    df: DataFrame, keys: list[str], ts: str, tie: list[str], slice_by: Column, threshold: Column, name: str
) -> DataFrame:
    """Per key, the first time its running row number exceeds ``threshold``."""
    numbered = ordered(df, keys, [ts, *tie], slice_by, position="__ordinal")
    reached = F.when(F.col("__ordinal") > threshold, F.col(ts))
    return numbered.groupBy(*keys).agg(F.min(reached).alias(name))


def event_pairs(
    df: DataFrame, keys: list[str], ts: str, kind: str, tie: list[str], slice_by: Column, first: str, second: str
) -> DataFrame:
    """Rows of type ``first`` whose next event (of either type) for the key is ``second``."""
    both = df.filter(F.col(kind).isin(first, second))
    paired = ordered(both, keys, [ts, *tie], slice_by, lead={"until_ts": ts, "__until_kind": kind})
    return paired.filter((F.col(kind) == first) & (F.col("__until_kind") == second)).drop("__until_kind")
