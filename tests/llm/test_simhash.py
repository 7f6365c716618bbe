import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rollbook.llm import simhash


def plain_print(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = raw.split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_groups(prints):
    """Smallest id reachable over links of at most four bits; by comparing all pairs."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def expected(rows):
    prints = [plain_print(t) for _, t in rows]
    groups = plain_groups(prints)
    least = {}
    for (i, _), g in zip(rows, groups):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(((i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(rows, prints, groups)), key=str)


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_same_as_all_pairs(request, name):
    df = request.getfixturevalue(name)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_links_join_what_all_pairs_join(spark):
    """Dense clusters and chains of flipped bits: the forest has the components of all links."""
    draw = np.random.default_rng(3)
    values = set(draw.integers(0, 1 << 63, 400, dtype=np.uint64).tolist())
    for seed in list(values)[:12]:
        one = seed
        for _ in range(60):
            for bit in draw.integers(0, 64, draw.integers(1, 5)):
                one ^= 1 << int(bit)
            values.add(one)
            one = seed if draw.random() < 0.5 else one
    values = sorted(values)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r["node"]: r["root"] for r in simhash.roots(simhash.links(df)).collect()}
    groups = plain_groups(values)
    for i in range(len(values)):
        for j in range(i):
            assert (got.get(signed[i], i) == got.get(signed[j], -1 - j)) == (groups[i] == groups[j])


def test_split_buckets_give_the_same_components(spark, monkeypatch):
    """Every bucket counts as large, so all members meet by parts of the third segment."""
    draw = np.random.default_rng(5)
    values = set()
    for seed in draw.integers(0, 1 << 63, 12, dtype=np.uint64).tolist():
        one = seed
        for _ in range(20):
            for bit in draw.integers(0, 64, draw.integers(1, 5)):
                one ^= 1 << int(bit)
            values.add(one)
    values = sorted(values)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    monkeypatch.setattr(simhash, "SPLIT", 0)
    got = {r["node"]: r["root"] for r in simhash.roots(simhash.links(df)).collect()}
    groups = plain_groups(values)
    for i in range(len(values)):
        for j in range(i):
            assert (got.get(signed[i], i) == got.get(signed[j], -1 - j)) == (groups[i] == groups[j])


def test_roots_of_a_long_chain(spark):
    chain = [(i + 1, i) for i in range(300)] + [(1000, 999)]
    got = {r["node"]: r["root"] for r in simhash.roots(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 999: 999, 1000: 999}


def test_one_document_of_each_group_stays(docs, odd):
    for df in (docs, odd):
        found = simhash.near_duplicates(df)
        kept = simhash.one_per_group(df)
        assert kept.columns == df.columns
        groups = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint"))).count()
        assert kept.count() == groups.count()
        assert {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in found.select("component_id").distinct().collect()}
