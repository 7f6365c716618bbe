"""Exact top-k inner products: columnar branch-and-bound.

Vectors are packed into blocks in vertical layout (one row of a block per dimension). A block of queries meets a block
of candidates dimension block by dimension block: partial products grow, and a candidate whose partial product plus the
mass that the remaining dimensions can add at most (the product of both remainders' norms) stays below the query's
k-th best score is dropped; the survivors are compacted before the next dimensions are read. A query's k-th best is
carried along over the candidate blocks of its task.

The search of all queries against all rows is dealt out by (query block, group of candidate blocks); each gives at most
k rows per query, which a last ranking merges. All blocks are bounded; nothing is broadcast or collected but counts.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no part.
Vectors are compared with those of equal length. Scores are exact integers; beyond 64 bits they saturate. A query's own
row is left out, other rows of the same id are not; a query that occurs in several rows is answered for each. Ties go to the
smaller id. Fewer rows than k: all of them. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import keep

BLOCK_ROWS = 4096
QUERY_ROWS = 2048
QUERY_STRIP = 256  # queries whose partial products are held at once
DIM_BLOCK = 16
GROUP_BLOCKS = 4  # candidate blocks that a task meets one after another
PACKED = "block long, dims int, n int, ids binary, places binary, vertical binary"


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def packed_row(block: int, dims: int, ids: np.ndarray, places: np.ndarray, vertical: np.ndarray) -> pa.RecordBatch:
    values = [[block], [dims], [len(ids)], [ids.tobytes()], [places.tobytes()], [np.ascontiguousarray(vertical).tobytes()]]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["block", "dims", "n", "ids", "places", "vertical"])


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector, is_query) to blocks of equal dimension; the top bit of a place marks a query."""
    partition, made = TaskContext.get().partitionId(), 0
    held: dict[int, list] = {}

    def block(dims):
        nonlocal made
        ids, query, rows = (np.concatenate(x) for x in zip(*held.pop(dims)))
        number = (partition << 32) | made
        made += 1
        return packed_row(number, dims, ids, query.astype(np.int64), rows.T)

    for batch in batches:
        ids, vectors, query = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        lengths = np.diff(vectors.offsets.to_numpy())
        flat = vectors.values.to_numpy()
        first = vectors.offsets.to_numpy()[:-1]
        for dims in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == dims)
            for k in range(0, len(at), BLOCK_ROWS):
                part = at[k : k + BLOCK_ROWS]
                rows = flat[first[part][:, None] + np.arange(dims)]
                held.setdefault(dims, []).append((ids[part], query[part], rows))
                if sum(len(x[0]) for x in held[dims]) >= BLOCK_ROWS:
                    yield block(dims)
    for dims in list(held):
        yield block(dims)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (
        np.frombuffer(row["ids"], np.int64), np.frombuffer(row["places"], np.int64),
        np.frombuffer(row["vertical"], np.int64).reshape(row["dims"], row["n"]),
    )


def queries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The queries of each block; a query's place is its row in the block."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, query, vertical = unpack(row)
            at = np.flatnonzero(query)
            if len(at):
                yield packed_row(row["block"], row["dims"], ids[at], at, vertical[:, at])


def merge_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One query block per dimension of this partition; places become (block, row) pairs."""
    held: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            ids, place, vertical = unpack(row)
            held.setdefault(row["dims"], []).append((ids, np.stack([np.full(len(ids), row["block"]), place], 1), vertical.T))
    for dims, parts in held.items():
        ids, place, rows = (np.concatenate(x) for x in zip(*parts))
        yield packed_row(TaskContext.get().partitionId(), dims, ids, place, rows.T)


class Best:
    """The k best scores of each query of a block so far."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, vertical: np.ndarray, k: int):
        self.ids, self.own, self.k = ids, own, k
        self.rows = np.ascontiguousarray(vertical.T)
        self.scores = [np.empty(0, np.int64) for _ in ids]
        self.found = [np.empty(0, np.int64) for _ in ids]
        self.least = np.full(len(ids), -np.inf)

    def meet(self, block: int, ids: np.ndarray, vertical: np.ndarray) -> None:
        """Bring in one candidate block."""
        dims = len(vertical)
        top = int(np.abs(self.rows).max(initial=0)) * int(np.abs(vertical).max(initial=0)) * max(dims, 1)
        if top >= 1 << 53:
            self._plain(block, ids, vertical)
            return
        queries, columns = self.rows.astype(np.float64), vertical.astype(np.float64)
        steps = list(range(0, dims, DIM_BLOCK)) or [0]
        # what the dimensions from each step on can add: norms of the remainders
        rest_q = np.sqrt(np.stack([(queries[:, s + DIM_BLOCK :] ** 2).sum(1) for s in steps]))
        rest_c = np.sqrt(np.stack([(columns[s + DIM_BLOCK :] ** 2).sum(0) for s in steps]))
        for at in range(0, len(queries), QUERY_STRIP):
            strip = queries[at : at + QUERY_STRIP]
            partial = strip[:, : DIM_BLOCK] @ columns[: DIM_BLOCK]
            reach = partial + rest_q[0, at : at + QUERY_STRIP, None] * rest_c[0] * (1 + 1e-9) + 1e-6
            alive = reach >= self.least[at : at + QUERY_STRIP, None]
            for i in range(len(strip)):
                q = at + i
                if self.own[q, 0] == block:
                    alive[i, self.own[q, 1]] = False
                left = np.flatnonzero(alive[i])
                score = partial[i, left]
                for number, s in enumerate(steps[1:], 1):
                    if not len(left):
                        break
                    score = score + strip[i, s : s + DIM_BLOCK] @ columns[s : s + DIM_BLOCK, left]
                    good = score + rest_q[number, q] * rest_c[number, left] * (1 + 1e-9) + 1e-6 >= self.least[q]
                    left, score = left[good], score[good]
                if len(left):
                    self._take(q, ids[left], np.rint(score).astype(np.int64))

    def _plain(self, block: int, ids: np.ndarray, vertical: np.ndarray) -> None:
        """Whole numbers of any size, where products leave the exact range of doubles."""
        columns, edge = vertical.astype(object), np.iinfo(np.int64)
        for q in range(len(self.rows)):
            score = np.array([min(max(int(x), edge.min), edge.max) for x in self.rows[q].astype(object) @ columns], np.int64)
            left = np.ones(len(ids), bool)
            if self.own[q, 0] == block:
                left[self.own[q, 1]] = False
            self._take(q, ids[left], score[left])

    def _take(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        if len(score) > 4 * self.k:
            good = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            ids, score = ids[good], score[good]
        score, ids = np.r_[self.scores[q], score], np.r_[self.found[q], ids]
        order = np.lexsort((ids, ~score))[: self.k]
        self.scores[q], self.found[q] = score[order], ids[order]
        if len(order) == self.k:
            self.least[q] = float(score[order[-1]])

    def rows_out(self, block: int) -> pa.RecordBatch:
        counts = np.array([len(s) for s in self.scores])
        query = np.repeat(np.arange(len(self.ids)), counts)
        columns = [np.full(len(query), block), query, self.ids[query], np.concatenate(self.found), np.concatenate(self.scores)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["block", "row", "query_id", "vec_id", "score"])


def searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (query block, dims, group), each time the queries before the candidates."""
        best = key = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                now = (row["query_block"], row["dims"], row["part"])
                if now != key:
                    if best:
                        yield best.rows_out((key[1] << 32) | key[0])
                    key, best = now, None
                ids, places, vertical = unpack(row)
                if row["candidates"] == 0:
                    best = Best(ids, places.reshape(-1, 2), vertical, k)
                elif best:
                    best.meet(row["block"], ids, vertical)
        if best:
            yield best.rows_out((key[1] << 32) | key[0])

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows for every row that ``is_query`` marks."""
    rows = vectors.where(usable(F.col(vector)) & F.col(vec_id).isNotNull())
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), whole_numbers(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    blocks = keep(rows.mapInArrow(pack, PACKED), "blocks")
    asked = keep(blocks.mapInArrow(queries_of, PACKED), "queries")
    counts = asked.agg(F.sum("n").alias("n")).first()["n"] or 0
    wide = max(1, -(-counts // QUERY_ROWS))
    merged = keep(asked.repartition(wide).mapInArrow(merge_queries, PACKED), "query-blocks")
    groups = max(1, -(-blocks.count() // GROUP_BLOCKS))
    number = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    columns = ["query_block", "part", "candidates", "block", "dims", "n", "ids", "places", "vertical"]
    left = merged.withColumns({"query_block": F.col("block").cast("int"), "part": F.explode(number(groups)), "candidates": F.lit(0)})
    right = blocks.withColumns({"query_block": F.explode(number(wide)), "part": F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"), "candidates": F.lit(1)})
    tasks = min(wide * groups, 4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = left.select(columns).union(right.select(columns)).repartitionById(tasks, F.expr(f"pmod(query_block * {groups} + part, {tasks})").cast("int"))
    ordered = dealt.sortWithinPartitions("query_block", "dims", "part", "candidates", "block")
    found = ordered.mapInArrow(searcher(k), "block long, row long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("block", "row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
