import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollbook.llm import catalog, periods

from ..conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=6, power=4):
    """Runs by trying every period."""
    shortest = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                shortest.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in shortest.items() if n >= max(least, power * q))


def plain_lyndon(text):
    best = []
    for i in range(len(text)):
        best.append(max(n for n in range(1, len(text) - i + 1) if all(text[i : i + n] < text[i + k : i + n] for k in range(1, n))))
    return best


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha(listed), sha(kept))


def test_grouping_gives_lyndon_lengths():
    draw = np.random.default_rng(1)
    for _ in range(400):
        symbols = int(draw.integers(1, 5))
        text = draw.integers(1, symbols + 1, draw.integers(1, 25)).tolist()
        assert periods.lyndon_lengths([0, *text, 0], symbols)[1:-1] == plain_lyndon(text)


@pytest.mark.parametrize("least, power", [(6, 4), (2, 2), (3, 3)])
def test_runs_same_as_trying_every_period(least, power):
    draw = np.random.default_rng(power)
    for _ in range(500):
        symbols = int(draw.integers(1, 4))
        text = draw.integers(1, symbols + 1, draw.integers(1, 50))
        if draw.random() < 0.5:
            text = np.r_[text[:10], np.tile(text[: draw.integers(1, 9)], draw.integers(2, 7)), text[:10]]
        assert periods.runs_of(text, least, power) == plain_runs(text.tolist(), least, power)


@pytest.mark.parametrize("name", ["odd", "none"])
def test_odd_rows(request, name):
    df = request.getfixturevalue(name)
    got = periods.digests(periods.find_runs(periods.planted(df))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_row(r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_query_same_as_trying_every_period(spark, docs):
    got = catalog.QUERIES["op12_periodic_runs"](spark, DATA).collect()
    assert sorted(map(tuple, got)) == sorted(plain_row(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    assert any(r["n_runs"] for r in got)


def test_repeated_phrases_across_slices_and_stretches(spark, monkeypatch):
    for name, value in (("SLICE", 300), ("GROUPED", 40)):
        monkeypatch.setattr(periods, name, value)
    draw = np.random.default_rng(5)
    rows = []
    for i in range(60):
        parts = [f"w{x}" for x in draw.integers(0, 6, 30)]
        for _ in range(3):
            phrase = [f"w{x}" for x in draw.integers(0, 8, draw.integers(1, 6))]
            parts += phrase * int(draw.integers(3, 8)) + phrase[:1] + [f"x{i}"] * int(draw.integers(0, 2))
        rows.append((i, "\t ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = periods.digests(periods.find_runs(periods.planted(df))).collect()
    assert sorted(map(tuple, got)) == sorted(plain_row(*r) for r in rows)


def test_runs_and_text_of_the_general_operator(spark):
    df = spark.createDataFrame([("a", "so x y x y x y x y x end"), ("b", "no run")], "name string, body string")
    got = {r["doc_id"]: r for r in periods.find_runs(df, "name", "body").collect()}
    assert [tuple(r) for r in got["a"]["runs"]] == [(1, 9, 2)] and got["a"]["collapsed"] == "so x y end"
    assert got["b"]["runs"] == [] and got["b"]["collapsed"] == "no run" and got["b"]["n_words"] == 2


def test_long_text_in_linear_time(spark):
    text = " ".join(["a", "b", "c"] * 100_000 + ["d"] * 100_000)
    (row,) = periods.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.col("runs")).collect()
    assert [tuple(r) for r in row["runs"]] == [(0, 300_000, 3), (300_000, 100_000, 1)]
