"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn; each visit fits a shallow tree to one feature's binned gradients and adds
its leaves to that feature's lookup table. The pairs of features with the largest gain on what is left then get tables
of their own, boosted in the same way with trees of one cut on either feature. A score is an intercept plus one table
entry per feature and pair, by bin: additions over arrays.

Features are counted over whole texts in array passes over their bytes. The model is fitted on about ``SAMPLE_ROWS``
labelled documents, drawn by a hash of the id, so that fitting costs the same whatever the corpus holds; everything else
covers all rows.

Defined results: a null text counts as empty; an empty text has a score like any other (all its shares are zero). Where
no document is labelled, or all alike, the score is the labels' smoothed mean (0.5 without labels). A document labelled
more than once counts as bad if any label says so. Repeated rows stay repeated; an empty table gives no rows; other
columns don't count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import held_out, slices, tidy

SAMPLE_ROWS = 20_000
ACCEPT = 0.7
BINS, PAIR_BINS, PAIRS = 64, 12, 6
ROUNDS, RATE, CUTS, MIN_LEAF = 150, 0.1, 3, 20
NGRAM = 3
ODD = np.uint64(0x9E3779B97F4A7C15)
SLICE = 1 << 20  # bytes whose features are counted at a time: some 150 bytes of arrays for each

SPACE, UPPER, LOWER, DIGIT, STOP, COMMA, EXCLAIM, QUOTE, OTHER, WIDE, NEWLINE = range(11)
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[128:] = WIDE
for _chars, _class in (
    (b" \t\r\v\f", SPACE), (b"\n", NEWLINE), (bytes(range(65, 91)), UPPER), (bytes(range(97, 123)), LOWER), (b"0123456789", DIGIT),
    (b".?", STOP), (b",;:", COMMA), (b"!", EXCLAIM), (b"'\"()-", QUOTE),
):
    CLASSES[list(_chars)] = _class
NAMES = (
    "log_words", "mean_word", "upper_share", "digit_share", "other_share", "exclaim_share", "stop_share", "comma_share", "quote_share",
    "wide_share", "newline_share", "distinct_words", "distinct_grams", "short_words", "long_words", "words_per_stop", "odd_ends", "top_word",
)


def per_text(owner: np.ndarray, count: int, weights=None) -> np.ndarray:
    return np.bincount(owner, weights, minlength=count).astype(np.float64)


def features_of(texts: pa.Array) -> np.ndarray:
    """One row of features per text, over all its bytes."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.empty(0, np.uint8)
    bounds = bounds - bounds[0]
    sizes = np.diff(bounds)
    kind = CLASSES[body]
    text_of = np.repeat(np.arange(n, dtype=np.int32), sizes)
    counts = np.bincount(text_of.astype(np.int64) * 11 + kind, minlength=n * 11).reshape(n, 11).astype(np.float64)
    solid = (kind != SPACE) & (kind != NEWLINE)
    begins = np.zeros(len(body), bool)
    begins[bounds[:-1][sizes > 0]] = True
    starts = np.flatnonzero(solid & (begins | ~np.r_[False, solid[:-1]]))
    closes = np.ones(len(body), bool)
    closes[:-1] = begins[1:] | ~solid[1:]
    ends = np.flatnonzero(solid & closes) + 1
    owner = text_of[starts].astype(np.int64)
    words = per_text(owner, n)
    length = ends - starts
    # a word's hash: differences of running sums of mixed bytes, times a power that takes its place out
    power = np.cumprod(np.full(len(body), ODD)) if len(body) else np.empty(0, np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum((body.astype(np.uint64) + np.uint64(1)) * power)]
    hashed = (sums[ends] - sums[starts]) * inverse_powers(len(body))[starts] if len(starts) else np.empty(0, np.uint64)
    hashed ^= hashed >> np.uint64(31)

    def distinct(values, of):
        order = np.lexsort((values, of))
        values, of = values[order], of[order]
        fresh = np.r_[True, (values[1:] != values[:-1]) | (of[1:] != of[:-1])] if len(values) else np.empty(0, bool)
        runs = np.diff(np.r_[np.flatnonzero(fresh), len(values)])
        most = np.zeros(n)
        np.maximum.at(most, of[fresh], runs)
        return per_text(of[fresh], n), most

    unlike, most = distinct(hashed, owner)
    if len(hashed) >= NGRAM:
        whole = owner[NGRAM - 1 :] == owner[: 1 - NGRAM]
        gram = np.zeros(len(whole), np.uint64)
        for k in range(NGRAM):
            gram = (gram ^ hashed[k : len(hashed) - NGRAM + 1 + k]) * ODD
        gram, gram_of = gram[whole], owner[: 1 - NGRAM][whole]
    else:
        gram, gram_of = np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = per_text(gram_of, n)
    unlike_grams, _ = distinct(gram, gram_of)
    closing = kind[ends - 1] if len(ends) else np.empty(0, np.uint8)
    some = np.maximum(words, 1)
    ink = np.maximum(counts.sum(axis=1) - counts[:, SPACE] - counts[:, NEWLINE], 1)
    letters = np.maximum(counts[:, UPPER] + counts[:, LOWER] + counts[:, WIDE], 1)
    columns = [
        np.log1p(words), per_text(owner, n, length) / some, counts[:, UPPER] / letters, counts[:, DIGIT] / ink, counts[:, OTHER] / ink,
        counts[:, EXCLAIM] / ink, counts[:, STOP] / some, counts[:, COMMA] / some, counts[:, QUOTE] / ink, counts[:, WIDE] / ink, counts[:, NEWLINE] / some,
        unlike / some, unlike_grams / np.maximum(grams, 1), per_text(owner[length <= 3], n) / some, per_text(owner[length >= 12], n) / some,
        np.log1p(words / np.maximum(counts[:, STOP], 1)), per_text(owner[closing == OTHER], n) / some, most / some,
    ]
    return np.stack(columns, axis=1)


def inverse_powers(count: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(count - 1, 0), np.uint64(pow(int(ODD), -1, 1 << 64)))])[:count] * np.uint64(pow(int(ODD), -1, 1 << 64))


def best_cut(grad: np.ndarray, hess: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins."""
    g, h = grad.cumsum(), hess.cumsum()
    left_g, left_h, right_g, right_h = g[:-1], h[:-1], g[-1] - g[:-1], h[-1] - h[:-1]
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g[-1] ** 2 / (h[-1] + 1)
    gain[(left_h < MIN_LEAF / 8) | (right_h < MIN_LEAF / 8)] = -1
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (-1.0, 0)


def shallow_tree(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """Leaf value per bin of a tree of at most CUTS cuts."""
    leaves = [(0, len(grad))]
    for _ in range(CUTS):
        options = [(*best_cut(grad[a:b], hess[a:b]), a, b) for a, b in leaves]
        gain, at, a, b = max(options)
        if gain <= 1e-9:
            break
        leaves.remove((a, b))
        leaves += [(a, a + at), (a + at, b)]
    out = np.empty(len(grad))
    for a, b in leaves:
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + 1)
    return out


def cross_tree(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts both features of a pair once."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    a, p = g[:-1, :-1], h[:-1, :-1]
    right, right_h = g[:-1, -1:], h[:-1, -1:]
    down, down_h = g[-1:, :-1], h[-1:, :-1]
    quarters = [(a, p), (right - a, right_h - p), (down - a, down_h - p), (g[-1, -1] - right - down + a, h[-1, -1] - right_h - down_h + p)]
    gain = sum(x**2 / (y + 1) for x, y in quarters) - g[-1, -1] ** 2 / (h[-1, -1] + 1)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(grad)
    values = [x[i, j] / (y[i, j] + 1) for x, y in quarters]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), out


def bins_of(column: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, column, side="right")


@dataclass
class AdditiveModel:
    """Cuts and lookup tables; ``score`` adds table entries."""

    base: float = 0.0
    cuts: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    pairs: dict = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            out += table[bins_of(x[:, f], cuts)]
        for (f, g), table in self.pairs.items():
            out += table[bins_of(x[:, f], self.coarse[f]), bins_of(x[:, g], self.coarse[g])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def cuts_of(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="higher"))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> AdditiveModel:
    """Boost the tables of all features in turn, then those of the best pairs."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(base=float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    count = x.shape[1]
    model.cuts = [cuts_of(x[:, f], BINS) for f in range(count)]
    model.coarse = [cuts_of(x[:, f], PAIR_BINS) for f in range(count)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    fine = [bins_of(x[:, f], model.cuts[f]) for f in range(count)]
    wide = [bins_of(x[:, f], model.coarse[f]) for f in range(count)]
    margin = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(count):
            grad, hess = slopes()
            size = len(model.tables[f])
            step = RATE * shallow_tree(np.bincount(fine[f], grad, size), np.bincount(fine[f], hess, size))
            model.tables[f] += step
            margin += step[fine[f]]

    def tree_of(f, g, grad, hess):
        shape = (len(model.coarse[f]) + 1, len(model.coarse[g]) + 1)
        cell = wide[f] * shape[1] + wide[g]
        size = shape[0] * shape[1]
        if min(shape) < 2:
            return 0.0, np.zeros(shape), cell
        return *cross_tree(np.bincount(cell, grad, size).reshape(shape), np.bincount(cell, hess, size).reshape(shape)), cell

    grad, hess = slopes()
    ranked = sorted(((tree_of(f, g, grad, hess)[0], f, g) for f, g in combinations(range(count), 2)), reverse=True)
    chosen = [(f, g) for gain, f, g in ranked[:pairs] if gain > 0]
    model.pairs = {(f, g): np.zeros((len(model.coarse[f]) + 1, len(model.coarse[g]) + 1)) for f, g in chosen}
    for _ in range(rounds // 2):
        for f, g in chosen:
            _, values, cell = tree_of(f, g, *slopes())
            model.pairs[f, g] += RATE * values
            margin += RATE * values.ravel()[cell]
    return model


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def feature_lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        rows = [features_of(part) for part in slices(texts, SLICE)]
        flat = np.concatenate(rows) if rows else np.empty((0, len(NAMES)))
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * len(NAMES), pa.int32()), pa.array(flat.ravel()))
    tidy()


def scorer(model: AdditiveModel):
    """A column function: the score of a text. A model is a few thousand numbers."""

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [model.score(features_of(part)) for part in slices(texts, SLICE)]
            yield pa.array(np.concatenate(rows) if rows else np.empty(0))
        tidy()

    return score


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on about ``sample_rows`` labelled documents that are not held out. labels: doc_id, quality."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = usable.count()
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, sample_rows / max(total, 1)) * (1 << 30))
    chosen = usable.where(drawn).select(F.col("doc_id").alias("__labelled"), F.col("quality").alias("__quality"))
    # about sample_rows rows of two numbers: bounded, so it is broadcast
    joined = docs.select(F.col("doc_id").alias("__doc"), "text").join(F.broadcast(chosen), F.col("__doc") == F.col("__labelled"))
    rows = joined.select("__doc", "__quality", feature_lists(F.col("text")).alias("features"))
    found = rows.groupBy("__doc").agg(F.min(F.struct("__quality", "features")).alias("r")).select("r.*").toArrow()
    x = found["features"].combine_chunks().values.to_numpy().reshape(-1, len(NAMES)) if len(found) else np.empty((0, len(NAMES)))
    return fit(x, found["__quality"].to_numpy().astype(np.float64))


def scored(docs: DataFrame, model: AdditiveModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    return docs.select(F.col(doc_id).alias("doc_id"), scorer(model)(F.col(text)).alias("score"))


def accepted(score: Column) -> Column:
    return score >= ACCEPT
