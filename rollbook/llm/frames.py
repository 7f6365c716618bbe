"""Tables, written intermediates and Arrow batches for the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, tune

SLICE_BYTES = 4 << 20  # text that a Python worker expands at a time
# Arrow batches small enough that several workers of an executor hold one each.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def prepare(spark: SparkSession) -> SparkSession:
    """The session settings that the operators of this folder rely on."""
    tune(spark)
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; further columns of the file are not read."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: computed once, and no lineage is left to recompute."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_row(docs: DataFrame) -> DataFrame:
    """All columns in one struct ``row``: names of inner columns can't clash with those of the table."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def held_out(doc_id: Column) -> Column:
    """True for the rows no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """A text array in slices of about ``limit`` bytes; a longer text is a slice of its own."""
    if not len(texts):
        return
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_numpy()
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(ends.searchsorted(before + limit, side="right")))
        yield texts.slice(first, last - first)
        first = last


def tidy() -> None:
    """Give freed memory back to the machine at the end of a task, so that waiting Python workers stay small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
