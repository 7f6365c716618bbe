"""Product codes of vectors; the nearest codebook entry is found by sliced and intersected bitmasks.

Components become whole numbers, vectors are cut into equal consecutive parts, and each part position has a codebook of
at most 64 entries. Per dimension, the entries' coordinates are sorted and every prefix of that order has a mask of its
entries. For a part, the distance to a first entry gives a radius; the entries within the radius in one dimension are a
slice of the sorted coordinates, two prefix masks apart, and the slices of all dimensions ANDed leave a box of entries
that holds the nearest one. Their distances are then compared exactly. All parts of a block are handled together in
numpy; Spark partitions the rows, sums each round's parts and counts per entry, and only codebooks go to the driver.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. Entries start from the
smallest ids (equal ids: smaller vector first); rows without an id start none, but are coded. Vectors of another length
than the smallest id's have null code and error. Parts are as equal as the length allows. Sums are exact at any size;
components saturate at 64 bits, errors at the largest long. Fewer rows than entries: fewer entries. Repeated rows are
coded each. ``label_error`` groups equal labels, nulls together. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import keep, tidy
from .topk import usable, whole_numbers

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK = 8192  # vectors handled at a time
LARGEST = (1 << 63) - 1


def bounds(dims: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """First and past-the-last component of each part."""
    cuts = [dims * i // parts for i in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


class Codebook:
    """Entries of one part position, at most 64, with their sorted coordinates and prefix masks."""

    def __init__(self, entries: list[list[int]]):
        self.entries = np.array(entries, object).reshape(len(entries), len(entries[0]) if entries else 0)
        self.top = max((abs(x) for x in self.entries.ravel()), default=0)
        dims = self.entries.shape[1]
        ranked = [sorted(range(len(entries)), key=lambda e, d=d: (self.entries[e, d], e)) for d in range(dims)]
        self.order = np.array(ranked, np.int64).reshape(dims, len(entries)).T  # entries by coordinate, per dimension
        self.sorted = np.take_along_axis(self.entries, self.order, 0)
        bits = np.left_shift(np.uint64(1), self.order.astype(np.uint64))
        self.prefix = np.concatenate([np.zeros((1, dims), np.uint64), np.bitwise_or.accumulate(bits, 0)])

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of every row, the smaller index on ties."""
        dims = rows.shape[1]
        if not dims or not len(rows):
            return np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        top = max(self.top, abs(int(rows.max())), abs(int(rows.min())))
        kind = np.int64 if dims * (2 * top + 2) ** 2 < 1 << 62 else object  # beyond 64 bits: whole numbers of any size
        rows, entries, ordered = rows.astype(kind), self.entries.astype(kind), self.sorted.astype(kind)
        widest = max(range(dims), key=lambda d: int(ordered[-1, d]) - int(ordered[0, d]))
        near = np.minimum(np.searchsorted(ordered[:, widest], rows[:, widest]), len(entries) - 1)
        guess = self.order[near, widest]
        away = ((rows - entries[guess]) ** 2).sum(1)
        radius = (np.frompyfunc(math.isqrt, 1, 1)(away) if kind is object else np.sqrt(away).astype(np.int64)) + 1
        masks = np.full(len(rows), np.uint64((1 << len(entries)) - 1))
        for d in range(dims):
            low = np.searchsorted(ordered[:, d], rows[:, d] - radius, side="left")
            high = np.searchsorted(ordered[:, d], rows[:, d] + radius, side="right")
            masks &= self.prefix[high, d] & ~self.prefix[low, d]
        best, least = guess.copy(), away.copy()
        for e in range(len(entries)):
            at = np.flatnonzero((masks >> np.uint64(e)) & np.uint64(1))
            far = ((rows[at] - entries[e]) ** 2).sum(1)
            better = (far < least[at]) | ((far == least[at]) & (e < best[at]))
            best[at[better]], least[at[better]] = e, far[better]
        return best, least


def blocks_of(column: pa.Array, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of a batch's vectors of the given length, and the vectors, block by block."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
    at = np.flatnonzero(np.diff(offsets) == dims)
    for k in range(0, len(at), BLOCK):
        part = at[k : k + BLOCK]
        yield part, flat[offsets[part][:, None] + np.arange(dims)]


def summer(books: list[list[list[int]]], dims: int):
    """Per task, part and entry: the number of parts assigned and their componentwise sums."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = [Codebook(b) for b in books]
        counts = [[0] * len(b) for b in books]
        sums = [[[0] * (z - a) for _ in b] for b, (a, z) in zip(books, bounds(dims, len(books)))]
        for batch in batches:
            for _, vectors in blocks_of(batch.column(0), dims):
                for p, (a, z) in enumerate(bounds(dims, len(books))):
                    part = vectors[:, a:z]
                    chosen, _ = coded[p].nearest(part)
                    exact = part if not part.size or max(abs(int(part.max())), abs(int(part.min()))) < 1 << 49 else part.astype(object)
                    for e in np.unique(chosen).tolist():
                        own = exact[chosen == e]
                        counts[p][e] += len(own)
                        sums[p][e] = [s + int(x) for s, x in zip(sums[p][e], own.sum(0))]
        out = [(p, e, d, str(s)) for p, book in enumerate(sums) for e, row in enumerate(book) for d, s in enumerate([counts[p][e], *row])]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), [pa.int32()] * 3 + [pa.string()])], ["part", "entry", "place", "total"])
        tidy()

    return rows


def coder(books: list[list[list[int]]], dims: int):
    """A column function of a vector: its code and error."""

    @F.arrow_udf("struct<code: string, error: bigint>")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coded = [Codebook(b) for b in books]
        for column in batches:
            codes, errors = [None] * len(column), [None] * len(column)
            for at, vectors in blocks_of(column, dims):
                chosen, far = zip(*(book.nearest(vectors[:, a:z]) for book, (a, z) in zip(coded, bounds(dims, len(books)))))
                text = np.stack(chosen, 1).astype(np.uint8).tobytes().hex()
                total = sum(f.astype(object) for f in far)
                for i, place in enumerate(at.tolist()):
                    codes[place] = text[2 * len(books) * i : 2 * len(books) * (i + 1)]
                    errors[place] = min(int(total[i]), LARGEST)
            yield pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["code", "error"])
        tidy()

    return code


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[list[list[int]]], int]:
    """Codebooks [part][entry] and the length of vectors they are for, of rows (vec_id, v) that are written already."""
    if entries > 64:
        raise ValueError("a codebook has at most 64 entries: one bit of a mask each")
    seeds = vectors.where("vec_id is not null").select("vec_id", "v").orderBy("vec_id", "v")
    first = seeds.first()
    dims = len(first["v"]) if first else 0
    start = [r["v"] for r in seeds.where(F.size("v") == dims).limit(entries).collect()] if first else []
    books = [[v[a:z] for v in start] for a, z in bounds(dims, parts)]
    for _ in range(rounds if start and dims else 0):
        found = vectors.select("v").mapInArrow(summer(books, dims), "part int, entry int, place int, total string")
        totals = found.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        sums = {(r["part"], r["entry"], r["place"]): int(r["total"]) for r in totals}
        for p, book in enumerate(books):
            for e, old in enumerate(book):
                n = sums.get((p, e, 0), 0)
                if n:
                    book[e] = [sums[p, e, d + 1] // n for d in range(len(old))]
    return books, dims


def compress(vectors: DataFrame, label: str | None = None, vec_id: str = "vec_id", vector: str = "embedding", **sizes: int) -> DataFrame:
    """vec_id, label, code, error and codebooks (as text) of every usable row."""
    rows = vectors.where(usable(F.col(vector)))
    tag: Column = F.col(label) if label else F.lit(None).cast("int")
    rows = keep(rows.select(F.col(vec_id).alias("vec_id"), tag.alias("label"), whole_numbers(F.col(vector), SCALE).alias("v")), "vectors")
    books, dims = learn(rows, **sizes)
    found = rows.select("vec_id", "label", coder(books, dims)("v").alias("c"))
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return found.select("vec_id", "label", "c.code", "c.error", F.lit(digest).alias("codebooks_sha256"))


def with_label_errors(found: DataFrame) -> DataFrame:
    """Adds the errors' sum over equal labels, nulls together."""
    coded = keep(found, "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
