import re

import pytest

from rollbook.llm import decontaminate as dc

from ..conftest import DATA


def plain(docs, items):
    """Short items are looked for as word sequences anywhere, longer ones by their five-word shingles."""
    words = lambda text: re.findall(r"[^\W_]+", (text or "").lower())
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = set()
    for i, t in items:
        size = min(5, len(words(t)))
        wanted = grams(words(t), size) if size else set()
        out |= {(d, i) for d, text in docs if wanted and len(wanted & grams(words(text), size)) >= 0.8 * len(wanted) - 1e-9}
    return out


def pairs(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def test_all_items_against_all_documents(spark, docs):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    found = dc.contained_items(docs, items)
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert pairs(found) == want and want
    assert {r["containment"] >= 0.8 for r in found.collect()} == {True}


def test_partly_held_short_and_odd_items(spark):
    base = " ".join(f"w{i}" for i in range(24))  # 20 shingles: 16 are needed
    broken = lambda cut: base.replace(f"w{cut} ", f"x{cut} ")
    rows = [
        (1, "Start. " + base.upper().replace(" ", ", ") + " end"), (2, "lead " + base.rsplit(" ", 4)[0] + " tail"), (3, "lead " + base.rsplit(" ", 5)[0] + " tail"),
        (4, broken(2)), (5, broken(11)), (6, ("filler text " * 4000) + base + (" more filler" * 4000)), (7, "One, two!"), (8, "one two three"), (None, base), (None, "other words"), (2, "other words"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS hash", "1 AS item", "2 AS n", "3 AS doc")
    items = spark.createDataFrame([(10, base), (10, base), (11, "one two"), (12, None), (13, "... !!"), (None, "one two three")], "item_id long, text string")
    assert pairs(dc.contained_items(docs, items)) == plain(rows, [(10, base), (11, "one two"), (None, "one two three")])
    kept = dc.without_items(docs, items)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"][:9]) for r in kept.collect()) == sorted([("3", "lead w0 w"), ("5", "w0 w1 w2 "), ("None", "other wor"), ("2", "other wor")])


@pytest.mark.parametrize("left, right", [("none", "docs"), ("docs", "none"), ("odd", "none")])
def test_empty_tables(request, left, right):
    docs, items = request.getfixturevalue(left), request.getfixturevalue(right).selectExpr("doc_id AS item_id", "text")
    assert dc.contained_items(docs, items).count() == 0
    assert dc.without_items(docs, items).count() == docs.count()


def test_short_items_inside_long_documents(spark):
    """Items of one to four words are found anywhere, also where the benchmark has items of all size classes."""
    long = [f"w{i}" for i in range(300)]
    items = [(1, "Alpha"), (2, "beta gamma"), (3, "delta, epsilon zeta"), (4, "eta theta iota kappa"), (5, "one two three four five")]
    items += [(10 + k, " ".join(long[: 2**k + 4])) for k in range(8)]
    rows = [(i, "start " * 30 + t + " end" * 40) for i, t in items] + [(100, "beta x gamma alphabet eta theta iota"), (101, "gamma beta"), (102, "beta gamma"), (103, " ".join(long)), (104, " ".join(long[:30]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pairs(dc.contained_items(docs, spark.createDataFrame(items, "item_id long, text string")))
    assert found == plain(rows, items) and {(1, 1), (2, 2), (3, 3), (4, 4), (102, 2)} <= found and (101, 2) not in found
