"""Long repeated spans of words, by de Bruijn compaction.

Windows of 35 words are the edges of a de Bruijn graph, their 34-word ends its nodes. A node is passed through if every
occurrence in the corpus has the same word before it and the same word after it; paths of such nodes are compacted: a
document's edges between two other nodes are one piece, and two places that share a window share the whole piece. The
pieces' words are then read back at their source coordinates; a piece is repeated if another place has the same words
(SHA-256), and its words are removed.

Only edges that may repeat enter the graph. Each window has an anchor, the smallest hash of its 10-word shingles; equal
windows have equal anchors, so a window whose anchor occurs once in the corpus does not repeat. Anchors are counted by
Spark (one for some ten words), and a bounded Bloom filter of the repeated ones goes to the scan of the documents; beyond
its bound an exact join replaces it. Texts are compared once for each distinct sequence of words, with the number of
their copies, so a group of copies of any size costs as much as one.

Node hashes have 64 bits: if two nodes share one, paths are only cut more often. A repeat could be missed only where two
different neighbourhoods of one node share a 64-bit hash as well.

Defined results: null, empty and blank texts have no words. A text with fewer words than a window keeps all. Very long
texts are taken whole. Rows without an id have results like others; repeated rows are copies of each other, so all
their windows repeat. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .decontaminate import bloom_of
from .frames import keep, slices, tidy

WINDOW = 35
SLICE = 2 << 20  # bytes of text that are hashed at a time
REMEMBERED = 400_000  # word hashes a task remembers
OUT_ROWS = 1 << 16
MIN_BITS, MAX_BITS = 23, 29  # Bloom filters: 1 MB to 64 MB
BITS_EACH = 8  # with fewer bits for each repeated anchor the exact join takes over
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
SPANS = "array<struct<first: int, last: int>>"


def anchor_words(window: int) -> int:
    return max(1, 2 * window // 7)


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it has too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 7)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive word hashes."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    up, down = powers(BASE, len(hashes)), powers(UNBASE, len(hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up)])
    return mixed((sums[size:] - sums[:-size]) * down[: len(hashes) - size + 1])


def sliding(pick, values: np.ndarray, size: int) -> np.ndarray:
    """Minimum or maximum of every ``size`` consecutive values."""
    span, out = 1, values
    while 2 * span <= size:
        out = pick(out[:-span], out[span:])
        span *= 2
    places = len(values) - size + 1
    return pick(out[:places], out[size - span :][:places])


def anchors(hashes: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after another: the anchor of every window, whether the window lies in one text, and the shingles
    that are anchors."""
    size = anchor_words(window)
    shingles = rolling(hashes, size)
    if len(hashes) < window:
        return np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, np.uint64)
    least = sliding(np.minimum, shingles, window - size + 1)
    starts = np.arange(len(least))
    inside = ends[np.searchsorted(ends, starts, side="right")] - starts >= window
    reach = np.pad(np.where(inside, least, 0), window - size)
    return least, inside, shingles[sliding(np.maximum, reach, window - size + 1) == shingles]


def hashed_slices(texts: pa.Array, memory: WordHashes) -> Iterator[tuple[list[list[bytes]], np.ndarray, np.ndarray]]:
    """Words of the texts, their hashes one text after another, and the ends of the texts."""
    for part in slices(texts, SLICE):
        split = [(t or "").encode().split() for t in part.to_pylist()]  # on bytes: white space of ASCII alone
        ends = np.cumsum([len(w) for w in split])
        yield split, np.fromiter(map(memory.__getitem__, chain.from_iterable(split)), np.uint64, int(ends[-1])), ends


def anchor_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            for _, hashes, ends in hashed_slices(batch.column(0), memory):
                chosen = anchors(hashes, ends, window)[2]
                yield pa.RecordBatch.from_arrays([pa.array(chosen.view(np.int64))], ["hash"])
        tidy()

    return rows


STRETCHES = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def stretches_in(candidate: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """Per text the stretches of candidate windows (first and last window, counted in the text); null without any."""
    edges = np.flatnonzero(np.diff(candidate.astype(np.int8), prepend=0, append=0))
    firsts, lasts = edges[::2], edges[1::2] - 1
    owner = np.searchsorted(ends, firsts, side="right")
    counts = np.bincount(owner, minlength=len(ends))
    start = np.r_[0, ends[:-1]][owner]
    places = pa.StructArray.from_arrays([pa.array((x - start).astype(np.int32)) for x in (firsts, lasts)], ["first", "last"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, counts.cumsum()].astype(np.int32), mask=np.r_[counts == 0, False]), places)


def scanner(window: int, known, id_type: pa.DataType, with_hits: bool):
    """Rows (doc_id, n_words, words, key, stretches, hits): stretches are the windows whose anchors the filter knows, and
    hits those anchors, if wanted; key, stretches and hits are null where there are none."""
    names, kinds = ["doc_id", "n_words", "words", "key", "stretches", "hits"], [id_type, pa.int64(), pa.string(), pa.binary(), STRETCHES, pa.list_(pa.int64())]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, memory = known.value, WordHashes()
        for batch in batches:
            at = 0
            for split, hashes, ends in hashed_slices(batch.column(1), memory):
                least, candidate, _ = anchors(hashes, ends, window)
                candidate[candidate] = filter_.hits(least[candidate])
                stretches = stretches_in(candidate, ends)
                texts, held = [b" ".join(words) for words in split], stretches.is_valid().to_pylist()
                keys = [hashlib.sha256(t).digest()[:16] if h else None for t, h in zip(texts, held)]
                begins = np.r_[0, ends[:-1]]
                hits = [np.unique(least[a:z][candidate[a:z]]).view(np.int64) if h and with_hits else None for a, z, h in zip(begins, ends, held)]
                columns = [pa.array(c, k) for c, k in zip([np.diff(ends, prepend=0), [t.decode() for t in texts], keys], kinds[1:4])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(split)), *columns, stretches, pa.array(hits, kinds[5])], names)
                at += len(split)
        tidy()

    return rows


def refiner(window: int):
    """Rows (key, words, copies, stretches) of rows (key, words, copies, hits): the windows whose anchors are hits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            at = 0
            for split, hashes, ends in hashed_slices(batch.column(1), memory):
                least, inside, _ = anchors(hashes, ends, window)
                part = batch.slice(at, len(split))
                known = part.column(3).flatten().to_numpy().view(np.uint64)  # a hit of one text is an anchor that repeats, so it is one for all
                yield pa.RecordBatch.from_arrays([*part.columns[:3], stretches_in(inside & np.isin(least, known), ends)], ["key", "words", "copies", "stretches"])
                at += len(split)
        tidy()

    return rows


class Stretches:
    """The stretches of candidate windows of the texts of one slice, one text after another."""

    def __init__(self, split: list[list[bytes]], hashes: np.ndarray, ends: np.ndarray, listed: pa.ListArray):
        self.split, self.hashes, self.ends, self.starts = split, hashes, ends, np.r_[0, ends[:-1]]
        counts = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
        places = listed.flatten()
        self.owner = np.repeat(np.arange(len(split)), counts)
        self.firsts, self.lasts = (places.field(i).to_numpy().astype(np.int64) + self.starts[self.owner] for i in (0, 1))  # windows, both included


def stretches_of(batch: pa.RecordBatch, memory: WordHashes) -> Iterator[tuple[int, Stretches]]:
    """The first row and the stretches of each slice of a batch (key, words, stretches, ...)."""
    at = 0
    for split, hashes, ends in hashed_slices(batch.column(1), memory):
        yield at, Stretches(split, hashes, ends, batch.column(2).slice(at, len(split)))
        at += len(split)


def node_rows(window: int, known=None):
    """Rows (key, node, place, around) of the nodes of candidate edges; around is 0 at the ends of stretches. With a
    filter, only nodes that it knows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            for at, one in stretches_of(batch, memory):
                if not len(one.firsts):
                    continue
                sizes = one.lasts - one.firsts + 2
                nth = np.arange(sizes.sum()) - np.repeat(sizes.cumsum() - sizes, sizes)
                place = nth + np.repeat(one.firsts, sizes)
                inner = (nth > 0) & (nth < np.repeat(sizes, sizes) - 1)
                own = rolling(one.hashes, window - 1)[place]
                around = np.zeros(len(place), np.uint64)
                middle = place[inner]
                around[inner] = mixed(one.hashes[middle - 1] * np.uint64(BASE) + mixed(one.hashes[middle + window - 1])) | np.uint64(1)
                if known:
                    hit = known.value.hits(own)
                    place, around, own = place[hit], around[hit], own[hit]
                owner = np.repeat(one.owner, sizes)
                owner = owner[hit] if known else owner
                for k in range(0, len(place), OUT_ROWS):
                    part = slice(k, k + OUT_ROWS)
                    keys = batch.column(0).take(pa.array(at + owner[part]))
                    columns = [own[part].view(np.int64), (place - one.starts[owner])[part].astype(np.int32), around[part].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([keys, *map(pa.array, columns)], ["key", "node", "place", "around"])
        tidy()

    return rows


def piece_rows(window: int):
    """Rows (key, digest, n, places): compacted paths by the digest of their words at their coordinates, with the number
    of places in all copies of the text and the places (first word, word after the last) in the text."""
    names = ["key", "digest", "n", "places"]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            keys, copies, cuts, out = (*(batch.column(i).to_pylist() for i in (0, 3, 4)), [])
            for at, one in stretches_of(batch, memory):
                edges = np.r_[np.flatnonzero(np.diff(one.owner, prepend=-1)), len(one.owner)]
                for a, z in zip(edges[:-1], edges[1:]):
                    text = int(one.owner[a])
                    begin, words = int(one.starts[text]), one.split[text]
                    whole = b" ".join(words)
                    byte = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)].tolist()
                    cut, places = np.array(cuts[at + text] or [], np.int64), {}
                    for first, last in zip((one.firsts[a:z] - begin).tolist(), (one.lasts[a:z] - begin).tolist()):
                        inner = cut[np.searchsorted(cut, first, side="right") : np.searchsorted(cut, last, side="right")].tolist()
                        for x, y in zip([first, *inner], [*inner, last + 1]):
                            end = y + window - 1
                            places.setdefault(hashlib.sha256(whole[byte[x] : byte[end] - 1]).digest(), []).append({"first": x, "last": end})
                    out += [(keys[at + text], digest, copies[at + text] * len(found), found) for digest, found in places.items()]
                    if len(out) >= OUT_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        tidy()

    return rows


@F.arrow_udf(T.StructType().add("kept", "string").add("n_removed", "long"))
def without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Words without those of the spans (first word, word after the last)."""
    for texts, spans in batches:
        kept, removed = [], []
        for text, own in zip(texts.to_pylist(), spans.to_pylist()):
            words, parts, upto, gone = text.encode().split(), [], 0, 0
            for span in own or []:
                parts += words[upto : max(upto, span["first"])]
                gone += max(0, span["last"] - max(upto, span["first"]))
                upto = max(upto, span["last"])
            kept.append(b" ".join(parts + words[upto:]).decode())
            removed.append(gone)
        yield pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(removed, pa.int64())], ["kept", "n_removed"])
    tidy()


def filter_over(hashes: DataFrame, size: int):
    """A broadcast Bloom filter over the column ``hash``, never larger than its bound."""
    bits = min(MAX_BITS, max(MIN_BITS, (2 * BITS_EACH * size).bit_length()))
    return hashes.sparkSession.sparkContext.broadcast(bloom_of(hashes, bits))


def scan(docs: DataFrame, window: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, n_words, words of every row, with key and stretches of candidate windows where there are any; the repeated
    anchors, if they are too many for the filter."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counted = rows.select("text").mapInArrow(anchor_rows(window), "hash long").groupBy("hash").count()
    repeated = keep(counted.where("count > 1").select("hash"), "anchors")
    size = repeated.count()
    exact = size * BITS_EACH > 1 << MAX_BITS
    schema = T.StructType().add("doc_id", docs.schema[doc_id].dataType).add("n_words", "long").add("words", "string").add("key", "binary")
    schema = schema.add("stretches", T.ArrayType(T.StructType().add("first", "integer").add("last", "integer"))).add("hits", T.ArrayType(T.LongType()))
    found = rows.mapInArrow(scanner(window, filter_over(repeated, size), to_arrow_type(schema[0].dataType), exact), schema)
    return keep(found, "scanned"), repeated if exact else None


def distinct_texts(scanned: DataFrame, repeated: DataFrame | None, window: int) -> DataFrame:
    """key, words, copies and stretches of each distinct text with candidate windows. With ``repeated``, when they are too
    many for the filter, the anchors themselves decide which windows are candidates."""
    column = "hits" if repeated is not None else "stretches"
    texts = scanned.where("stretches IS NOT NULL").groupBy("key").agg(F.first("words").alias("words"), F.count("*").alias("copies"), F.first(column).alias(column))
    texts = keep(texts, "texts")
    if repeated is None:
        return texts
    known = texts.select("key", F.explode("hits").alias("hash")).join(repeated, "hash").groupBy("key").agg(F.collect_list("hash").alias("hits"))
    refined = texts.drop("hits").join(known, "key").select("key", "words", "copies", "hits")
    return keep(refined.mapInArrow(refiner(window), f"key binary, words string, copies long, stretches {SPANS}"), "refined")


def repeated_spans(texts: DataFrame, window: int) -> DataFrame:
    """key and repeated spans of distinct texts, each span a first word and the word after the last."""
    nodes = texts.select("key", "words", "stretches")
    around = nodes.mapInArrow(node_rows(window), "key binary, node long, place int, around long").select("node", "around")
    ends = around.groupBy("node").agg(F.min("around").alias("low"), F.max("around").alias("high"))
    cut_nodes = keep(ends.where("low <> high").select(F.col("node").alias("hash")), "cut-nodes")
    known = filter_over(cut_nodes, cut_nodes.count())
    placed = nodes.mapInArrow(node_rows(window, known), "key binary, node long, place int, around long")
    placed = placed.select("key", "place", F.col("node").alias("hash")).join(cut_nodes, "hash")
    cuts = keep(placed.groupBy("key").agg(F.sort_array(F.collect_list("place")).alias("cuts")), "cuts")  # places of one text
    pieces = texts.join(cuts, "key", "left").select("key", "words", "stretches", "copies", "cuts")
    pieces = keep(pieces.mapInArrow(piece_rows(window), f"key binary, digest binary, n long, places {SPANS}"), "pieces")
    again = pieces.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")
    spans = pieces.join(again, "digest").groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("spans"))  # of one text
    return keep(spans, "spans")


def without_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept text (words joined by spaces) and removed spans of every row.
    A window has two words or more."""
    if window < 2:
        raise ValueError("a window has two words or more")
    scanned, repeated = scan(docs, window, doc_id, text)
    texts = distinct_texts(scanned, repeated, window)
    spans = repeated_spans(texts, window)
    none = F.lit(None).cast(SPANS).alias("spans")
    untouched = scanned.where("stretches IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("words").alias("kept"), none)
    # copies are cleaned each on its own: the words move once, and none are joined back
    touched = scanned.where("stretches IS NOT NULL").select("doc_id", "n_words", "words", "key").join(spans, "key", "left")
    touched = touched.select("doc_id", "n_words", without("words", "spans").alias("w"), "spans")
    return untouched.unionByName(touched.select("doc_id", "n_words", "w.n_removed", "w.kept", "spans"))


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
