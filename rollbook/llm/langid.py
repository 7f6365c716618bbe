"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text is its letters: lower case, everything else a blank. Character n-grams of two to four (blanks only at their
ends) are hashed into buckets; the text's vector is the mean of its n-grams' embeddings, and a linear softmax reads the
language from it. Embeddings and weights are trained together by stochastic gradient descent in numpy on a bounded
sample. A part of the sample is kept from training: it sets the temperature of the scores and the score below which a
prediction is rejected.

As both layers are linear, scoring needs one small vector per bucket, averaged over whole texts in array passes.

Defined results: a text that is null or without a letter is ``und`` with score 0 and not accepted. Without any labelled
row all texts are ``und``. Rows without an id are learned from (they are never held out). Copies of a text count once in
the sample. Repeated rows stay repeated; an empty table gives no rows; other columns don't count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import held_out, slices, tidy

SLICE = 1 << 20  # bytes of text that are turned into n-grams at a time
PER_LANGUAGE = 1500  # texts of each language in the sample
LANGUAGES = 300  # languages that are learned at most
BUCKETS = 1 << 15
DIM = 16
GRAMS = (2, 3, 4)
EPOCHS, RATE = 8, 2.0
PRECISION = 0.99  # of the predictions that are accepted, on the calibration part
UNKNOWN = "und"
MIX = np.uint64(0x9E3779B97F4A7C15)


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram, text by text, and the number of n-grams of each text."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}]+", " ")
    plain = pc.if_else(pc.match_substring_regex(plain, r"\p{L}"), pc.utf8_trim(plain, " "), "")  # marks alone are no text
    sizes = pc.utf8_length(plain).to_numpy().astype(np.int64)
    body = " ".join(["", *plain.to_pylist(), ""])
    code = np.frombuffer(body.encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank = code == 32
    text_of = np.repeat(np.arange(len(sizes)), sizes + 1)  # of a letter, or of the blank before a text
    text_of = np.r_[text_of, len(sizes)]
    found, owner = [], []
    for n in GRAMS:
        count = len(code) - n + 1
        if count <= 0:
            continue
        whole = np.ones(count, bool)
        for k in range(1, n - 1):
            whole &= ~blank[k : k + count]
        if n == 2:
            whole &= ~(blank[:count] & blank[1 : 1 + count])
        hashed = np.full(count, np.uint64(n))
        for k in range(n):
            hashed = (hashed ^ code[k : k + count]) * MIX
            hashed ^= hashed >> np.uint64(32)
        at = np.flatnonzero(whole)
        found.append((hashed[at] % np.uint64(BUCKETS)).astype(np.int32))
        # the gram after a text's last letter, its closing blank, begins inside the text
        owner.append(text_of[at])
    if not found:
        return np.empty(0, np.int32), np.zeros(len(sizes), np.int64)
    bucket, owner = np.concatenate(found), np.concatenate(owner)
    order = owner.argsort(kind="stable")
    return bucket[order], np.bincount(owner, minlength=len(sizes) + 1)[: len(sizes)]


@dataclass
class LanguageModel:
    """One vector per bucket, weights per language, temperature and the least score that is accepted."""

    languages: list
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bucket, counts = subwords(texts)
        total = np.zeros((len(counts), self.vectors.shape[1]))
        some = counts > 0
        if some.any():
            starts = (counts.cumsum() - counts)[some]
            for d in range(total.shape[1]):
                total[some, d] = np.add.reduceat(self.vectors[:, d][bucket], starts, dtype=np.float64)
        return total / np.maximum(counts, 1)[:, None] @ self.weights + self.bias, some

    def predict(self, texts: pa.Array) -> tuple[list, np.ndarray]:
        logits, some = self.logits(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        share = softmax(logits / self.temperature)
        best = share.argmax(1)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, some)], np.where(some, share.max(1), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(buckets: list[np.ndarray], counts: list[np.ndarray], truth: np.ndarray, aside: np.ndarray, languages: list, seed: int = 7) -> LanguageModel:
    """Train on sparse texts (bucket numbers and their counts); rows of ``aside`` only calibrate."""
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1, 1, (BUCKETS, DIM)) / DIM
    weights, bias = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    shares = [c / c.sum() for c in counts]
    train = np.flatnonzero(~aside)
    steps = max(1, EPOCHS * len(train))
    done = 0
    for _ in range(EPOCHS):
        for i in draw.permutation(train):
            rate = RATE * (1 - done / steps)
            done += 1
            at, w = buckets[i], shares[i]
            hidden = w @ vectors[at]
            slope = softmax((hidden @ weights + bias)[None])[0]
            slope[truth[i]] -= 1
            back = weights @ slope
            weights -= rate * np.outer(hidden, slope)
            bias -= 0.1 * rate * slope
            vectors[at] -= rate * np.outer(w, back)
    if len(languages) <= DIM:  # one number per language and bucket: fewer additions when scoring
        vectors, weights = vectors @ weights, np.eye(len(languages))
    model = LanguageModel(languages, vectors.astype(np.float32), weights, bias)
    check = np.flatnonzero(aside)
    if len(check):
        logits = np.stack([(shares[i] @ vectors[buckets[i]]) @ weights + bias for i in check])
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(check)), truth[check]] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
        share = softmax(logits / model.temperature)
        score, right = share.max(1), share.argmax(1) == truth[check]
        order = np.argsort(-score)
        precise = np.flatnonzero(right[order].cumsum() / np.arange(1, len(order) + 1) >= PRECISION)
        model.least = float(score[order[precise[-1]]]) if len(precise) else 1.0
    return model


@F.arrow_udf(T.ArrayType(T.LongType()))
def counted_subwords(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """bucket << 32 | count of a text's n-grams; at most one entry per bucket."""
    for texts in batches:
        out = []
        for part in slices(texts, SLICE):
            bucket, counts = subwords(part)
            for piece in np.split(bucket, counts.cumsum()[:-1]) if len(counts) else []:
                number, times = np.unique(piece, return_counts=True)
                out.append((number.astype(np.int64) << 32) | np.minimum(times, (1 << 31) - 1))
        yield pa.array(out, pa.list_(pa.int64()))
    tidy()


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on about ``per_language`` texts of each language that are not held out. docs: doc_id, text, lang.

    At most ``LANGUAGES`` languages are learned, those with the most distinct texts, so dirty labels bring no more than a
    bounded sample to the driver.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    texts = usable.select("lang", F.xxhash64("text").alias("h")).distinct()  # copies are drawn together, so they count once
    per_lang = texts.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["count"] for r in per_lang.collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 1)), np.zeros(1))
    part = F.create_map(*[F.lit(x) for lang in languages for x in (lang, int(min(1.0, per_language / counts[lang]) * (1 << 30)))])
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    drawn = usable.where(place < part[F.col("lang")]).groupBy(F.xxhash64("text").alias("h"), "lang").agg(F.min("text").alias("text"))
    found = drawn.select("lang", "h", counted_subwords(F.col("text")).alias("s")).toArrow()
    grams, hashed, place_of = found["s"].combine_chunks(), found["h"].to_numpy(), {lang: i for i, lang in enumerate(languages)}
    bounds, flat = grams.offsets.to_numpy(), grams.values.to_numpy()
    truth = np.array([place_of[lang] for lang in found["lang"].to_pylist()], int)
    order = np.lexsort((hashed, truth))  # the same order whatever the tasks' order
    order = order[np.diff(bounds)[order] > 0]
    rows = [flat[bounds[i] : bounds[i + 1]] for i in order]
    buckets, times = [(r >> 32).astype(np.int32) for r in rows], [(r & 0xFFFFFFFF).astype(np.float32) for r in rows]
    del found, grams, flat, rows
    aside, truth = hashed[order] % 5 == 0, truth[order]
    aside &= np.bincount(truth[~aside], minlength=len(languages))[truth] > 0  # a language with no other text is trained on them
    return fit(buckets, times, truth, aside, languages)


def predictor(model: LanguageModel):
    """A column function: language and score of a text. The model has a bounded size per language."""
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            langs, scores = [], [np.empty(0)]
            for part in slices(texts, SLICE):
                lang, score = model.predict(part)
                langs += lang
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], ["lang", "score"])
        tidy()

    return predict


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and whether the score is high enough to be accepted."""
    out = docs.select(F.col(doc_id).alias("doc_id"), predictor(model)(F.col(text)).alias("p"))
    sure = (F.col("p.score") >= model.least) & (F.col("p.lang") != UNKNOWN)
    return out.select("doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), sure.alias("accepted"))
