"""Text lists of groups of any size, as rows of bounded pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyed import join_null_safe
from .ordered import ordered

SLICE_VALUES = 100_000  # values of a group up to which it is one slice
DRAWN = 4  # candidates for each border


def _with_slices(values: DataFrame, keys: list[str], value: str, slice_values: int) -> DataFrame:
    """Adds ``__s``, which never falls as values rise: 0 for a small group, else the number of borders up to the value.

    Borders are drawn from the group itself: candidates by hash, so they lie as the values do, and every few of them in
    order is a border. Their number grows with the group, so a slice stays near ``slice_values`` values.
    """
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > slice_values)
    # at most one group for slice_values values: small enough to be broadcast by hint
    large = sizes.select(*keys, (F.ceil(F.col("__n") / slice_values) * DRAWN).alias("__buckets"))
    place = F.xxhash64(value)
    drawn = join_null_safe(values, F.broadcast(large), keys, "inner").groupBy(*keys, F.pmod(place, F.col("__buckets")).alias("__b")).agg(F.min_by(value, place).alias("__c"))
    borders = drawn.groupBy(*keys).agg(F.filter(F.array_sort(F.collect_list("__c")), lambda _, i: i % DRAWN == DRAWN - 1).alias("__borders"))
    # a value looks among few borders, then between two of them, then between two of those: it never carries them all
    fan = F.ceil(F.cbrt(F.size("__borders"))).cast("int")
    borders = borders.filter(F.size("__borders") > 0).withColumns({"__fan": fan, "__n": F.size("__borders")})
    found = values.withColumn("__s", F.lit(0))
    for level in (2, 1, 0):
        found = _one_level(found, borders, keys, value, level)
    return found.select(*keys, value, "__s")


def _one_level(found: DataFrame, borders: DataFrame, keys: list[str], value: str, level: int) -> DataFrame:
    """Narrow ``__s``, at first the place of a value among borders ``fan ** (level + 1)`` apart, to ``fan ** level`` apart.

    The last level leaves the number of borders up to the value. Borders are at most one for ``slice_values`` values
    and broadcast by hint: a join on the few keys would put a large group into one task.
    """
    step = F.pow("__fan", F.lit(level)).cast("int")
    width = step * F.col("__fan") if level < 2 else F.greatest(F.col("__n"), step)
    nodes = borders.select(*keys, "__borders", "__n", "__fan", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / width).cast("int"))).alias("__node"))
    first = F.col("__node") * width
    inside = F.slice("__borders", first + 1, width)
    heads = nodes.select(*keys, "__node", F.col("__fan").alias("__f"), F.filter(inside, lambda _, i: i % step == 0).alias("__heads")).withColumn("__s", F.col("__node")).drop("__node")
    joined = join_null_safe(found, F.broadcast(heads), [*keys, "__s"])
    upto = F.size(F.filter("__heads", lambda c: c <= F.col(value)))
    # below the first border of all: place 0, which the last level tells from the place behind it
    place = F.col("__s") * F.col("__f") + (upto if level == 0 else F.greatest(upto, F.lit(1)) - 1)
    return joined.withColumn("__s", F.when(F.col("__heads").isNull(), 0).otherwise(place).cast("int")).drop("__f", "__heads")


def text_list_pieces(
    df: DataFrame, keys: list[str], value: str, separator: str = ",", distinct: bool = True, piece_values: int = 1000, slice_values: int = SLICE_VALUES
) -> DataFrame:
    """The group's sorted text list in pieces: keys, piece (from 0), ``n_values`` and ``values``.

    Pieces hold ``piece_values`` values, the last one the rest; joined by the separator in their order they are the list
    that ``text_list`` gives in one row. No group is gathered in one array or one task. NULL values are left out, a group
    without any has no piece; NULL keys are a group.
    """
    rows = df.select(*keys, F.col(value).cast("string").alias("__v")).filter("__v IS NOT NULL")
    counted = rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__times"))
    placed = _with_slices(counted.select(*keys, "__v"), keys, "__v", slice_values)
    if not distinct:
        placed = join_null_safe(placed, counted, [*keys, "__v"])
        upto = ordered(placed, keys, ["__v"], F.col("__s"), running={"__upto": "__times"})
        copies = F.sequence(F.col("__upto") - F.col("__times") + 1, F.col("__upto"))
        ranked = upto.select(*keys, "__v", F.explode(copies).alias("__nr"))
    else:
        ranked = ordered(placed, keys, ["__v"], F.col("__s"), position="__nr")
    piece = F.floor((F.col("__nr") - 1) / piece_values).cast("int").alias("piece")
    listed = F.array_sort(F.collect_list("__v"))  # at most piece_values
    return ranked.groupBy(*keys, piece).agg(F.count(F.lit(1)).alias("n_values"), F.array_join(listed, separator).alias("values"))
