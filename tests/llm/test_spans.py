import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from rollbook.llm import catalog, spans

from ..conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window=35):
    split = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), words in zip(rows, split):
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, **more):
    return sorted(map(tuple, spans.digests(spans.without_repeats(df, **more)).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def texts_with_passages(draw, n=60, vocabulary=40):
    """Few words, shared passages at any place, changed words in copies, periodic stretches."""
    word = lambda k: [f"w{x}" for x in draw.integers(0, vocabulary, k)]
    shared = [word(int(draw.integers(20, 90))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = word(int(draw.integers(0, 60)))
        for _ in range(int(draw.integers(0, 3))):
            passage = list(shared[draw.integers(0, len(shared))])
            if draw.random() < 0.4:
                passage[draw.integers(0, len(passage))] = "changed"
            cut = int(draw.integers(0, 10))
            parts += passage[cut:] + word(int(draw.integers(0, 30)))
        if draw.random() < 0.2:
            parts += word(3) * int(draw.integers(10, 30))
        rows.append((i, " ".join(parts)))
    return rows + [(1000 + i, rows[i][1].replace(" ", "\n")) for i in range(0, 20, 3)]


def test_query_same_as_counting_all_windows(spark, docs):
    got = sorted(map(tuple, catalog.QUERIES["op13_repeated_spans"](spark, DATA).collect()), key=str)
    assert got == plain([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert any(r[2] for r in got) and any(not r[2] for r in got)


@pytest.mark.parametrize("name", ["odd", "none"])
def test_odd_rows(request, name):
    df = request.getfixturevalue(name)
    assert found(df) == plain([(r["doc_id"], r["text"]) for r in df.collect()])


@pytest.mark.parametrize("window", [2, 5, 12, 35])
def test_any_window(spark, window):
    rows = texts_with_passages(np.random.default_rng(window))
    assert found(frame(spark, rows), window=window) == plain(rows, window)


@pytest.mark.parametrize("seed", range(3))
def test_small_blocks_and_exact_join_of_anchors(spark, monkeypatch, seed):
    """Beyond the filter's bound the anchors are joined; saturated filters only let more through."""
    for name, value in (("SLICE", 500), ("OUT_ROWS", 7), ("REMEMBERED", 5), ("MIN_BITS", 15), ("MAX_BITS", 15), ("BITS_EACH", 1 << 14)):
        monkeypatch.setattr(spans, name, value)
    rows = texts_with_passages(np.random.default_rng(100 + seed), vocabulary=4)
    assert found(frame(spark, rows), window=8) == plain(rows, 8)


def test_bubbles_and_loops(spark):
    """One changed word in the middle, a text that is its own repeat, a text that ends inside another."""
    base = [f"a{i}" for i in range(200)]
    bubble = base[:100] + ["other"] + base[101:]
    rows = [(1, " ".join(base)), (2, " ".join(bubble)), (3, " ".join(base[:60])), (4, " ".join(base[150:])), (5, "x " * 100), (6, " ".join(base[40:80] * 3))]
    assert found(frame(spark, rows)) == plain(rows)
    kept = {r["doc_id"]: r for r in spans.without_repeats(frame(spark, rows)).collect()}
    assert kept[2]["kept"] == "other" and [tuple(s) for s in kept[3]["spans"]][0][0] == 0


def test_words_are_not_written_or_joined_back(spark, monkeypatch):
    """Texts are kept as scanned and once for each distinct one; no third copy of them is written."""
    kept = {}
    keep = spans.keep
    monkeypatch.setattr(spans, "keep", lambda df, label: kept.setdefault(label, df.columns) and keep(df, label))
    text = " ".join(map(str, range(60)))
    found = spans.without_repeats(spark.createDataFrame([(1, text), (2, text), (3, "a " + text), (4, "b")], "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in found.collect()}
    assert got == {1: (60, 60, ""), 2: (60, 60, ""), 3: (61, 60, "a"), 4: (1, 0, "b")}
    assert {label for label, columns in kept.items() if {"words", "kept"} & set(columns)} == {"scanned", "texts"}
