import hashlib

import numpy as np
import pytest

from rollbook.llm import codes

from ..conftest import DATA


def plain(rows, entries=16, rounds=6):
    """(vec_id, code, error, label_error) and the codebooks' digest, by comparing every part with every entry."""
    kept = [(i, [int(np.floor(4096.0 * np.float64(x))) for x in v], t) for i, v, t in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return [], None
    seeds = sorted((i, v) for i, v, _ in kept if i is not None)
    dims = len(seeds[0][1])
    cut = [dims * p // 8 for p in range(9)]
    books = [[v[cut[p] : cut[p + 1]] for _, v in [s for s in seeds if len(s[1]) == dims][:entries]] for p in range(8)]
    same = [v for _, v, _ in kept if len(v) == dims]

    def nearest(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for v in same:
                part = v[cut[p] : cut[p + 1]]
                groups.setdefault(nearest(part, book)[1], []).append(part)
            for e, parts in groups.items():
                book[e] = [sum(x) // len(parts) for x in zip(*parts)]
    out = []
    for i, v, t in kept:
        found = [nearest(v[cut[p] : cut[p + 1]], books[p]) for p in range(8)] if len(v) == dims else None
        out.append((i, t, "".join(f"{e:02x}" for _, e in found) if found else None, sum(d for d, _ in found) if found else None))
    per = {}
    for _, t, _, d in out:
        if d is not None:
            per[t] = per.get(t, 0) + d
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, d, per.get(t)) for i, t, c, d in out), key=str), digest


def found(df, **sizes):
    rows = codes.with_label_errors(codes.compress(df, "label", **sizes)).collect()
    digests = {r["codebooks_sha256"] for r in rows}
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in rows), key=str), digests.pop() if digests else None


def values(df):
    return [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]


def test_same_as_comparing_all_entries(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    assert found(df) == plain(values(df))


@pytest.mark.parametrize("spread", [3, 50, 10**6])
def test_boxes_hold_the_nearest_entry(spread):
    draw = np.random.default_rng(spread)
    for dims in (1, 2, 5):
        entries = draw.integers(-spread, spread, (16, dims))
        entries[3] = entries[9]  # ties
        rows = np.concatenate([draw.integers(-2 * spread, 2 * spread, (500, dims)), entries])
        far = ((rows[:, None] - entries[None]) ** 2).sum(2)
        index, least = codes.Codebook(entries.tolist()).nearest(rows)
        assert (index == far.argmin(1)).all() and (least == far.min(1)).all()


def test_odd_rows(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=17).tolist(), i % 3 or None) for i in range(60)]
    nan, inf = float("nan"), float("inf")
    rows += [(1, None, 1), (2, [None] * 17, 1), (3, [nan] * 17, 1), (4, [-inf] + [0.0] * 16, 1), (None, [0.25] * 17, 2), (5, [1.0, 2.0], 2), (6, [], None)]
    rows += [rows[7], rows[7], (100, [1e6] * 17, 5), (101, [-3e4] * 17, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    assert found(df) == plain(values(df))


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(3, [0.5] * 8, 1), (1, [0.1] * 8, None)], "vec_id long, embedding array<float>, label int")
    assert found(df) == plain(values(df))
    assert found(df.limit(0)) == ([], None)


def test_huge_components_stay_exact_and_errors_saturate(spark):
    rows = [(i, [float(i) * 1e14] * 8, i) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want, digest = plain(values(df))
    top = (1 << 63) - 1
    assert found(df) == (sorted([(i, c, min(d, top), min(e, top)) for i, c, d, e in want], key=str), digest)


def test_more_entries_than_bits_are_refused(spark):
    with pytest.raises(ValueError):
        codes.learn(None, entries=65)
