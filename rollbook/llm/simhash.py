"""SimHash near-duplicates with pigeonring candidate filtering.

A 64-bit fingerprint is cut into a ring of five segments. If two fingerprints differ in at most four bits, some start
on the ring has, for every length l, at most ``4 * l / 5`` differences in its first l segments: none in the first, one
in the first two, two in the first three, three in the first four. Rows are brought together by that chain's first two
segments (the first equal, the second equal but for one masked bit: 64 keys of some 25 bits per fingerprint); the
longer chains prune the pairs of a bucket before the full Hamming check.

Only distinct fingerprints are compared, so exact copies cost nothing. A bucket gives a spanning forest of its links,
not all pairs. A bucket of very many fingerprints is split among tasks by the chain's third segment: at most two bits
differ in it, so of its three parts one is equal, and members meet in the bucket of each part. Which buckets are split is
guessed from a sample; results do not depend on it. Components come from rounds of hooking and contraction over written
tables.

Defined results: null, empty and blank texts have fingerprint zero; a text with fewer words than a shingle has one
shingle, the whole sequence. Rows without an id take part, but ``component_id`` is the smallest id that is not null
(null if the component has none). Repeated rows stay repeated. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decontaminate import bloom_of
from .frames import as_row, keep, tidy

BITS = 64
DISTANCE = 4
WORDS = 4
SEED = 42
SPLIT = 50_000  # members of a bucket that is split
SAMPLED = 32  # one fingerprint of so many tells which buckets are large
FILTER_BITS = (20, 30)  # Bloom filter over the fingerprints of larger groups: 128 KB to 128 MB
HASH_BLOCK = 1 << 16  # shingles hashed at a time
BIT_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned SimHash of a text's word shingles, repeats included."""
    tokens = (text or "").encode().lower().split()  # on bytes both act on ASCII alone
    if not tokens:
        return 0
    total = max(len(tokens) - words + 1, 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, total, HASH_BLOCK):
        part = tokens[at : min(at + HASH_BLOCK, total) + words - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(words)))) if len(part) >= words else [b" ".join(part)]
        hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], np.uint64).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(hashes[:, k], minlength=256) @ BIT_TABLE
    return int((1 << np.flatnonzero(2 * ones > total).astype(object)).sum() if (2 * ones > total).any() else 0)


@F.arrow_udf(T.LongType())
def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        values = np.array([fingerprint(t.as_py()) for t in texts], np.uint64)
        yield pa.array(values.view(np.int64))
    tidy()


def segments(count: int = DISTANCE + 1) -> list[tuple[int, int]]:
    """Start and width of each ring segment."""
    cuts = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def ring_keys(fp: str = "fp"):
    """Per chain start and masked bit of its second segment: the slot's number and the bits that must agree."""
    ring, keys = segments(), []
    for start in range(len(ring)):
        (at, width), (at2, width2) = ring[start], ring[(start + 1) % len(ring)]
        for bit in range(width2):
            mask = (((1 << width) - 1) << at) | ((((1 << width2) - 1) << at2) & ~(1 << (at2 + bit)))
            signed = mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask
            keys.append(F.struct(F.lit(len(keys)).alias("slot"), F.col(fp).bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def chains() -> list[list[tuple[int, int]]]:
    """For each key slot: masks over the chain's first 3, 4 and 5 segments with the differences they may hold."""
    ring, out = segments(), []
    whole = [((1 << w) - 1) << a for a, w in ring]
    for start in range(len(ring)):
        steps, mask = [], 0
        for length in range(1, len(ring) + 1):
            mask |= whole[(start + length - 1) % len(ring)]
            if length > 2:
                steps.append((mask, DISTANCE * length // len(ring)))
        out += [steps] * ring[(start + 1) % len(ring)][1]
    return out


def bucket_links(values: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside one bucket: each member found is taken out of what is left to compare."""
    left, found_a, found_b = values, [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            apart = left ^ one
            near = np.ones(len(left), bool)
            for mask, budget in steps:  # the last step is the full Hamming check
                at = np.flatnonzero(near)
                near[at] = np.bitwise_count(apart[at] & np.uint64(mask)) <= budget
            hits = left[near]
            if len(hits):
                found_a.append(hits)
                found_b.append(np.full(len(hits), one))
                queue.extend(hits)
                left = left[~near]
    none = np.empty(0, np.uint64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def links_of_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (slot, bits, part): links of each run of equal keys."""
    steps, rest = chains(), None
    names = ["a", "b"]

    def solve(slot, bits, part, fp, final):
        edge = np.flatnonzero((slot[1:] != slot[:-1]) | (bits[1:] != bits[:-1]) | (part[1:] != part[:-1])) + 1
        starts, ends = np.r_[0, edge], np.r_[edge, len(slot)]
        keep_from = len(slot) if final else starts[-1]
        out_a, out_b = [], []
        for s, e in zip(starts, ends):
            if e - s > 1 and s < keep_from:
                a, b = bucket_links(fp[s:e], steps[slot[s]])
                out_a.append(a)
                out_b.append(b)
        cut = (slot[keep_from:], bits[keep_from:], part[keep_from:], fp[keep_from:])
        a = np.concatenate(out_a).view(np.int64) if out_a else np.empty(0, np.int64)
        b = np.concatenate(out_b).view(np.int64) if out_b else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names), cut

    held: list = []  # batches that end in the same, unfinished run
    for batch in batches:
        slot, bits, part, fp = (batch.column(i).to_numpy() for i in range(4))
        now = (slot, bits, part, fp.view(np.uint64))
        if not len(slot):
            continue
        held.append(now)
        first = held[0]
        if (slot[-1], bits[-1], part[-1]) == (first[0][0], first[1][0], first[2][0]):
            continue  # one run so far: nothing to solve, and nothing to copy again
        out, rest = solve(*(np.concatenate(x) for x in zip(*held)), final=False)
        held = [rest]
        yield out
    if held:
        yield solve(*(np.concatenate(x) for x in zip(*held)), final=True)[0]


def third_parts(slot: str = "slot", fp: str = "fp"):
    """The chain's third segment in three parts, each numbered with its bits."""
    ring, out, last = segments(), None, 0
    for start in range(len(ring)):
        at, width = ring[(start + 2) % len(ring)]
        cuts = [width * i // 3 for i in range(4)]
        parts = F.array(*[
            F.lit(i + 1) * (1 << BITS // 4) + F.shiftrightunsigned(F.col(fp), at + low).bitwiseAND(F.lit((1 << (high - low)) - 1))
            for i, (low, high) in enumerate(zip(cuts, cuts[1:]))
        ])
        last += ring[(start + 1) % len(ring)][1]
        out = F.when(F.col(slot) < last, parts) if out is None else out.when(F.col(slot) < last, parts)
    return out


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that join every pair of distinct fingerprints within the distance, directly or over others."""
    keys = lambda df: df.select("fp", F.explode(ring_keys()).alias("key")).select("key.slot", "key.bits", "fp")
    keyed, whole = keys(distinct), F.lit(0).cast("long")
    counts = keys(distinct.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0)).groupBy("slot", "bits").agg(F.count("*").alias("n"))
    large = keep(counts.where(F.col("n") > SPLIT / SAMPLED).select("slot", "bits", F.lit(True).alias("large")), "large-buckets")
    if large.isEmpty():
        dealt = keyed.withColumn("part", whole)
    else:
        dealt = keyed.join(large, ["slot", "bits"], "left")
        dealt = dealt.withColumn("part", F.explode(F.when(F.col("large"), third_parts()).otherwise(F.array(whole))))
    dealt = dealt.select("slot", "bits", "part", "fp")
    parted = dealt.repartition("slot", "bits", "part").sortWithinPartitions("slot", "bits", "part", "fp")
    found = parted.mapInArrow(links_of_buckets, "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def roots(pairs: DataFrame, label: str = "links") -> DataFrame:
    """(node, root) for every node of the links: each round hooks nodes on their least neighbour and contracts."""
    edges = keep(pairs, label)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    members = keep(nodes.withColumn("root", F.col("node")), "members")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("up")), "hooks")
        up = hook.alias("h").join(hook.alias("g"), F.col("h.up") == F.col("g.node"))
        up = keep(up.select(F.col("h.node").alias("node"), F.col("g.up").alias("up")), "jumps")
        members = keep(
            members.join(up.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")),
            "members",
        )
        lower = edges.join(up.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(
            up.select(F.col("node").alias("b"), F.col("up").alias("y")), "b"
        )
        lower = lower.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        edges = keep(lower.distinct(), label)
    return members


def components(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id, size) per distinct fingerprint of rows (doc_id, fp) that are written already; size is the
    component's number of rows."""
    first = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    joined = first.join(roots(links(first)).withColumnRenamed("node", "fp"), "fp", "left")
    labelled = keep(joined.select("fp", F.coalesce("root", "fp").alias("root"), "least", "n"), "labelled")
    least = keep(labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("size")), "least")
    return keep(labelled.join(least, "root").select("fp", "root", "component_id", "size"), "components")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    prints = keep(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp")), "fingerprints")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(components(prints), "fp").select("doc_id", hexed, "component_id")


def may_hold(known):
    """A column function: whether a Bloom filter may hold a hash."""

    @F.arrow_udf(T.BooleanType())
    def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for hashes in batches:
            yield pa.array(known.value.hits(hashes.to_numpy().view(np.uint64)))

    return held


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id (any one where none has an id), with all columns.

    Documents alone in their component stay where they are: a bounded Bloom filter over the fingerprints of larger
    components lets them pass, and only what it may hold is exchanged whole.
    """
    own_id, own_text = F.col("row").getField(doc_id), F.col("row").getField(text)
    printed = keep(as_row(docs).select("row", fingerprints(own_text).alias("fp")), "printed")
    groups = components(keep(printed.select(own_id.alias("doc_id"), "fp"), "fingerprints"))
    shared = keep(groups.where("size > 1").select(F.xxhash64("fp").alias("hash")), "shared")
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * shared.count()).bit_length()))
    held = may_hold(docs.sparkSession.sparkContext.broadcast(bloom_of(shared, bits)))(F.xxhash64("fp"))
    alone = printed.where(~held).select("row.*")
    # an id may occur in several fingerprints or rows of its group: the rows that carry the least id are few per group
    first = printed.where(held).join(groups, "fp").where(own_id.eqNullSafe(F.col("component_id")))
    return alone.unionByName(first.dropDuplicates(["root"]).select("row.*"))
