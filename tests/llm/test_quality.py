import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pytest

from rollbook.llm import catalog, quality

from ..conftest import DATA


@pytest.fixture(scope="module")
def model(docs, spark):
    return quality.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))


def test_held_out_accuracy(spark):
    root = DATA.replace("0.001", "0.01")
    scores = {r["doc_id"]: r for r in catalog.QUERIES["op2_quality"](spark, root).collect()}
    assert len(scores) == spark.read.parquet(f"{root}/documents.parquet").count()
    tests = [(r["quality"], scores[r["doc_id"]]["predicted"]) for r in spark.read.parquet(f"{root}/labels.parquet").collect() if scores[r["doc_id"]]["held_out"]]
    assert len(tests) > 50 and np.mean([a == b for a, b in tests]) > 0.95
    assert all((r["score"] >= 0.7) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in scores.values())


def test_features_do_not_depend_on_neighbours(docs):
    texts = pa.array([r["text"] for r in docs.limit(40).collect()] + [None, "", "  ", "x", "!!!"])
    whole = quality.features_of(texts)
    assert np.allclose(whole, np.concatenate([quality.features_of(texts.slice(i, 1)) for i in range(len(texts))]))
    row = dict(zip(quality.NAMES, quality.features_of(pa.array(["ab AB. ab 12 ab, AB"]))[0]))
    assert row["upper_share"] == 4 / 10 and row["distinct_words"] == 5 / 6 and row["top_word"] == 2 / 6 and row["stop_share"] == 1 / 6


def test_interactions_are_learned():
    draw = np.random.default_rng(1)
    x = draw.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    fitted = quality.fit(x, y)
    assert (0, 1) in fitted.pairs and ((fitted.score(x) > 0.5) == y).mean() > 0.95


def test_odd_rows_and_empty_tables(spark, odd, none, model):
    rows = quality.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.scored(none, model).count() == 0
    labels = "doc_id long, quality int, toxic int"
    blank = quality.learn(odd, spark.createDataFrame([], labels))
    assert [r["score"] for r in quality.scored(odd, blank).collect()] == [0.5] * odd.count()
    one_sided = quality.learn(odd, spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0), (3, 1, 0), (3, 1, 1)], labels))
    assert len({r["score"] for r in quality.scored(odd, one_sided).collect()}) == 1


def test_scores_are_plain_sums_of_table_entries(docs, model):
    """Each text on its own: the base, one entry per feature, one per pair, added number by number."""
    rows = docs.select("doc_id", "text").limit(80).collect()
    found = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
    for r in rows:
        x = quality.features_of(pa.array([r["text"]]))[0].tolist()
        margin = model.base
        for value, cuts, entries in zip(x, model.cuts, model.tables):
            margin += float(entries[bisect_right(cuts.tolist(), value)])
        for (f, g), entries in model.pairs.items():
            margin += float(entries[bisect_right(model.coarse[f].tolist(), x[f])][bisect_right(model.coarse[g].tolist(), x[g])])
        assert abs(found[r["doc_id"]] - 1 / (1 + math.exp(-margin))) < 1e-9
    assert model.pairs and any(t.any() for t in model.tables)
