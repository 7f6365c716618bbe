import numpy as np
import pytest
from pyspark.sql import functions as F

from rollbook.llm import topk

from ..conftest import DATA


def plain(rows, k, scale=64):
    used = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            used.append((i, [int(np.floor(scale * np.float64(x))) for x in v]))
    out = []
    for place, (i, v) in enumerate(used):
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for other, (j, w) in enumerate(used) if other != place and len(w) == len(v))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(df, k=20, **more):
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=k, scale=64, **more).collect())


def test_all_queries_against_all_rows(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    assert found(df) == plain([(r["vec_id"], r["embedding"]) for r in df.collect()], 20)


def test_small_blocks_prune_and_carry_on(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 30), ("QUERY_ROWS", 7), ("QUERY_STRIP", 3), ("DIM_BLOCK", 5), ("GROUP_BLOCKS", 2)):
        monkeypatch.setattr(topk, name, value)
    draw = np.random.default_rng(9)
    middle = draw.normal(size=(6, 17))
    rows = [(i, (middle[i % 6] + 0.1 * draw.normal(size=17)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert found(df, 6) == plain([(r["vec_id"], r["embedding"]) for r in df.collect()], 6)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (20, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (40, [0.5]), (5, [-0.51]),
        (60, []), (6, []), (7, [3e9, -2e9]), (8, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0]), (9, [0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "0 AS block", "1 AS rank", "2 AS score", "'x' AS dims")
    assert found(df, 3) == plain(rows, 3)
    assert found(df, 1) == plain(rows, 1)
    assert found(df.limit(0)) == []


def test_scores_beyond_exact_doubles(spark):
    rows = [(0, [9e6, 1.0]), (1, [9e6, 3.0]), (2, [9e6, 2.0]), (3, [9e6, -1.0]), (4, [1e12, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(df, 4)
    assert [g[2] for g in got] == [4, 1, 2, 3] and got[0][3] == min((1 << 63) - 1, 64 * 64 * 9 * 10**18 + 4096)
    assert [g[3] for g in got[1:]] == [576000000**2 + 64 * y for y in (192, 128, -64)]


@pytest.mark.parametrize("k", [1, 20])
def test_bounds_keep_what_belongs(k):
    """The pruned meeting of a block equals the whole products."""
    draw = np.random.default_rng(k)
    rows = draw.integers(-60, 60, (300, 48))
    best = topk.Best(np.arange(40), np.stack([np.zeros(40, int), np.arange(40)], 1), rows[:40].T, k)
    for block in range(3):
        best.meet(block, np.arange(100) + 100 * block, rows[100 * block : 100 * block + 100].T)
    products = rows[:40] @ rows.T
    products[np.arange(40), np.arange(40)] = -(1 << 40)
    for q in range(40):
        order = np.lexsort((np.arange(300), -products[q]))[:k]
        assert best.found[q].tolist() == order.tolist() and best.scores[q].tolist() == products[q][order].tolist()
