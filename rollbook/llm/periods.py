"""Periodic runs of words, from Lyndon arrays that the first phase of Baier's suffix sorter gives.

A run is a stretch of consecutive words with a smallest period q that no neighbouring word extends. The grouping phase
takes suffixes in groups of equal context, highest group first; the nearest lower suffix to the left takes the group's
context into its own. When a group's turn comes, its context is the longest Lyndon word that starts at its members, so
the phase alone gives the Lyndon array; with the order of words turned round it gives the array of the other order.
Every run has a Lyndon root of one of the two orders (the one in which the word after the run is smaller), so roots
extended to both sides by longest common extensions are all runs. Time and memory are linear in the words grouped.

A run of at least ``power`` periods holds each of its words at least ``power`` times, so texts are cut at words that
are rarer in them; a run never crosses such a word, and what lies between is grouped.

Defined results: null, empty and blank texts have no words and no runs. Very long texts are taken whole, in memory
linear in the one text. Rows without an id have results like others, repeated rows stay repeated, ties of runs cannot
occur (start and period differ). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import slices, tidy

LEAST = 6  # words of a run
POWER = 4  # periods of a run
SLICE = 1 << 20  # bytes of text whose words are held at a time
GROUPED = 200_000  # words that are grouped together; a longer stretch without rare words is taken whole
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
RESULT = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"


class Numbers(dict):
    """Numbers words in order of appearance."""

    def __init__(self):
        self.next = count().__next__

    def __missing__(self, word: bytes) -> int:
        self[word] = number = self.next()
        return number


def lyndon_lengths(text: list[int], symbols: int) -> list[int]:
    """Length of the longest Lyndon word from each place. ``text`` begins and ends with 0, and has 0 between its
    stretches; words are 1 to ``symbols``."""
    size = len(text)
    left, right = list(range(-1, size - 1)), list(range(1, size + 1))  # places whose group has not had its turn
    group = list(text)
    members: list[list[int]] = [[] for _ in range(symbols + 1)]
    for place, symbol in enumerate(text):
        members[symbol].append(place)
    context = [1] * (symbols + 1)
    below, above = list(range(-1, symbols)), list(range(1, symbols + 2))
    below.append(symbols)  # a bound above the highest group keeps the links whole
    members.append([])
    context.append(0)
    above.append(-1)
    lengths, top = [0] * size, symbols
    while top:
        span, grown = context[top], {}
        for place in members[top]:
            if group[place] != top:  # has gone to a higher group meanwhile
                continue
            lengths[place] = span
            lower = left[place]
            if group[lower] == top:  # counted from the first of its neighbours
                continue
            times, after = 1, right[place]
            while group[after] == top:
                times += 1
                after = right[after]
            right[lower], left[after] = after, lower
            if group[lower]:
                grown.setdefault((times, group[lower]), []).append(lower)
        for (times, old), places in sorted(grown.items(), reverse=True) if len(grown) > 1 else grown.items():
            new, over = len(context), above[old]
            context.append(context[old] + times * span)
            members.append(places)
            below.append(old)
            above.append(over)
            above[old] = below[over] = new
            for place in places:
                group[place] = new
        top = below[top]
    return lengths


def common(ahead: np.ndarray, one: int, other: int) -> int:
    """Number of equal words from two places on, ``one`` before ``other``."""
    total, step = 0, 16
    while True:
        y = ahead[other + total : other + total + step]
        differ = np.flatnonzero(ahead[one + total : one + total + len(y)] != y)
        if len(differ):
            return total + int(differ[0])
        total += len(y)
        if len(y) < step:
            return total
        step *= 2


def runs_of(words: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers over 0; 0 belongs to no run."""
    symbols, ranks = np.unique(words[words > 0], return_inverse=True)
    text = np.zeros(len(words) + 2, np.int64)
    text[1:-1][words > 0] = ranks + 1
    unlike = np.where(text > 0, text, -np.arange(len(text)))  # no two borders are equal
    backward, last = unlike[::-1], len(text) - 1
    found = set()
    for order in (text, np.where(text > 0, len(symbols) + 1 - text, 0)):
        lengths = np.array(lyndon_lengths(order.tolist(), len(symbols)), np.int64)
        # a run of so many periods holds its root at least ``power`` - 1 times in a row
        roots = np.flatnonzero(lengths)
        for times in range(1, power):
            roots = roots[roots + times * lengths[roots] < len(text)]
            ahead = roots + times * lengths[roots]
            roots = roots[(unlike[ahead] == unlike[roots]) & ((times == power - 1) | (lengths[ahead] == lengths[roots]))]
        reach: dict[int, int] = {}
        for place, period in zip(roots.tolist(), lengths[roots].tolist()):
            if place + period <= reach.get(period, 0):  # a later root of a run that is known
                continue
            after = common(unlike, place, place + period)
            before = common(backward, last - (place + period - 1), last - (place - 1))
            start, end = place - before, place + period + after
            if end - start >= 2 * period:
                reach[period] = end
                if end - start >= max(least, power * period):
                    found.add((start - 1, end - start, period))
    return sorted(found)


def of_slice(texts: pa.Array, least: int, power: int) -> pa.StructArray:
    split = [(t or "").encode().split() for t in texts.to_pylist()]  # on bytes: white space of ASCII alone
    counts = np.array([len(w) for w in split], np.int64)
    number = Numbers()
    codes = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum())) + 1
    ends = counts.cumsum()
    owner = np.repeat(np.arange(len(split)), counts)
    _, same, often = np.unique(owner * (len(number) + 1) + codes, return_inverse=True, return_counts=True)
    usable = often[same] >= power if len(codes) else np.empty(0, bool)
    edge = np.ones(len(codes) + 1, bool)
    edge[1:-1] = (usable[1:] != usable[:-1]) | (owner[1:] != owner[:-1])
    edges = np.flatnonzero(edge)
    long = np.flatnonzero(usable[edges[:-1]] & (np.diff(edges) >= least)) if len(codes) else np.empty(0, np.int64)
    starts, stops = edges[long], edges[long + 1] if len(long) else edges[long]

    found: list[list[tuple[int, int, int]]] = [[] for _ in split]
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted((stops - starts + 1)[at:].cumsum(), GROUPED)) + at)
        pieces = [np.r_[codes[a:b], 0] for a, b in zip(starts[at:upto], stops[at:upto])]
        begins = np.cumsum([0] + [len(p) for p in pieces])
        for start, length, period in runs_of(np.concatenate(pieces), least, power):
            piece = int(np.searchsorted(begins, start, side="right")) - 1
            first = int(starts[at + piece]) + start - int(begins[piece])
            text = int(owner[first])
            found[text].append((first - int(ends[text] - counts[text]), length, period))
        at = upto

    kept = []
    for words, runs in zip(split, found):
        runs.sort(key=lambda run: (run[0], run[2]))
        upto, parts = 0, []
        for a, b in sorted((start + period, start + length) for start, length, period in runs):
            if b > upto:
                parts += words[upto : max(a, upto)]
                upto = b
        kept.append(b" ".join(parts + words[upto:] if runs else words).decode())
    rows = [[dict(zip(("start", "length", "period"), run)) for run in runs] for runs in found]
    return pa.StructArray.from_arrays([pa.array(counts), pa.array(rows, RUNS), pa.array(kept, pa.string())], ["n_words", "runs", "collapsed"])


def run_finder(least: int = LEAST, power: int = POWER):
    """A column function of a text: its number of words, its runs by start and period, and its words without what runs
    repeat, joined by spaces."""

    @F.arrow_udf(RESULT)
    def finder(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = of_slice(pa.array([], pa.string()), least, power).type
        for texts in batches:
            parts = [of_slice(part, least, power) for part in slices(texts, SLICE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)
        tidy()

    return finder


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """doc_id, n_words, runs and collapsed text of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), run_finder(least, power)(F.col(text)).alias("found"))
    return rows.select("doc_id", "found.n_words", "found.runs", "found.collapsed")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period, the first where several have it; null without runs."""
    longer = lambda best, run: run["length"] * best["period"] > best["length"] * run["period"]
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda best, run: F.when(best.isNull() | longer(best, run), run).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """Numbers, the strongest run and SHA-256 digests of ``find_runs``."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text, where texts whose id has a crc32 divisible by 10 repeat a stretch of themselves to their end."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.crc32(F.col(doc_id).cast("string").cast("binary")).alias("h"))
    chosen = (F.col("h") % 10 == 0) & F.col("text").isNotNull()
    rows = rows.withColumn("w", F.when(chosen, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")))
    rows = rows.withColumns({"n": F.size("w"), "g": F.expr("h div 10")})
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.expr("cast(ceil((n - a) / p) as int)")))
    whole = F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), again), F.lit(1), F.col("n"))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))
