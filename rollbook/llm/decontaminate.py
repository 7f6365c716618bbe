"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items and documents are lower-cased, cut into runs of letters and digits and turned into five-word shingles (an item of
fewer words: one shingle, the whole sequence, and documents then give shingles of that many words too). A document is
contaminated by an item if it holds at least 80 % of the item's distinct shingles, wherever they stand and however long
the document is.

Items are partitioned by size. An item of n shingles must give ``ceil(0.8 n)`` of them, so whichever
``n - ceil(0.8 n) + 1`` are looked up, one is found. The item's MinHash sketch keeps just the shingles with so many
smallest hashes: the number follows the size, and nothing is missed. Each size class (n doubled) has a filter of its
sketches, the largest hash they hold and the least number of shingles its items need: a document is looked up in a class
only if it holds so many item shingles, and joined only with items of classes that pass. Candidate pairs are then counted
on the shingle strings themselves.

A Bloom filter over the item shingles lets the scan of the documents pass on only shingles that items hold. Its size is
bounded whatever the benchmark holds; a false hit falls out in the joins. Items are never collected nor broadcast.

Defined results: null texts and texts without words hold nothing and are no items. Rows without an id take part like
others; repeated rows of an item or a document give one pair. Empty tables give no pairs. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .frames import as_row, keep, slices, tidy

WORDS = 5
SLICE = 2 << 20  # bytes of text that are cut into shingles at a time
CONTAINMENT = 0.8
MIN_BITS, MAX_BITS = 26, 30  # Bloom filter: 8 MB, and up to 128 MB for very many item shingles
CLASS_BITS = 20  # least size of the filter of one size class
BITMAP = 32768  # bits of one bitmap of bitmap_construct_agg
SHINGLES = T.ArrayType(T.StructType().add("hash", "long").add("shingle", "string").add("classes", "long"))
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: pa.Array) -> pa.ListArray:
    """Runs of letters and digits, lower case."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+", " ")
    return pc.split_pattern(pc.utf8_trim(plain, " "), " ")


def shingle_hashes(words: pa.ListArray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, first word and number of words of every shingle."""
    bounds = words.offsets.to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    bounds = bounds - bounds[0]
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashed = own[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.uint64)
    counts = np.diff(bounds)
    empty = counts == 1
    empty[empty] = hashed[bounds[:-1][empty]] == np.uint64(xxhash.xxh64_intdigest(""))
    shingles = np.where(empty, 0, np.maximum(counts - size + 1, np.minimum(counts, 1)))
    text = np.repeat(np.arange(len(counts)), shingles)
    first = bounds[:-1][text] + np.arange(len(text)) - np.repeat(shingles.cumsum() - shingles, shingles)
    length = np.minimum(counts, size)[text]
    out = np.zeros(len(text), np.uint64)
    for k in range(size):
        inside = length > k
        out[inside] = (out[inside] ^ hashed[first[inside] + k]) * MIX
        out[inside] ^= out[inside] >> np.uint64(29)
    return out, text, first, length


class Bloom:
    """Two bits per hash, taken from its two halves."""

    def __init__(self, bits: int, buckets: dict[int, bytes]):
        self.bits = bits
        self.bytes = np.zeros((1 << bits) // 8, np.uint8)
        for bucket, bitmap in buckets.items():
            self.bytes[bucket * BITMAP // 8 :][: BITMAP // 8] = np.frombuffer(bitmap, np.uint8)[: BITMAP // 8]

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for shift in (0, 32):
            at = (hashes[found] >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)
            found[found] = (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return found


def bloom_of(hashes: DataFrame, bits: int) -> Bloom:
    """The filter over a frame's column ``hash``; bitmaps are built by the executors, at most 2^bits / 8 bytes come back."""
    places = [F.col("hash"), F.shiftrightunsigned("hash", 32)]
    at = hashes.select(F.explode(F.array(*[p.bitwiseAND(F.lit((1 << bits) - 1)) for p in places])).alias("at"))
    bucket = F.shiftrightunsigned("at", BITMAP.bit_length() - 1).cast("int").alias("bucket")
    inside = F.col("at").bitwiseAND(F.lit(BITMAP - 1))
    rows = at.groupBy(bucket).agg(F.bitmap_construct_agg(inside).alias("bitmap")).collect()
    return Bloom(bits, {r["bucket"]: bytes(r["bitmap"]) for r in rows})


def all_shingles(words: pa.ListArray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of five words, and those of the given smaller sizes in texts with more words than that."""
    found = [shingle_hashes(words)]
    for size in sizes:
        hashes, text, first, length = shingle_hashes(words, size)
        longer = pc.list_value_length(words).to_numpy(zero_copy_only=False)[text] > size
        found.append(tuple(x[longer] for x in (hashes, text, first, length)))
    return tuple(np.concatenate(x) for x in zip(*found))


def shingles_with(keep_hash=None, wanted=None, sizes: tuple[int, ...] = ()):
    """A column function: distinct (hash, shingle, classes) of a text, with further shingles of ``sizes`` words. Only those
    that ``keep_hash`` has, of texts that may hold an item: ``wanted`` has for each size class its sketches' filter, their
    ceiling and the least number of shingles that an item of the class needs. ``classes`` has a bit for each class that
    the text may hold items of."""

    @F.arrow_udf(SHINGLES)
    def shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        passes = keep_hash.value if keep_hash else None
        classes = wanted.value if wanted else []
        kind = pa.struct([("hash", pa.int64()), ("shingle", pa.string()), ("classes", pa.int64())])
        for texts in batches:
            parts = []
            for part in slices(texts, SLICE):
                words = words_of(part)
                hashes, text, first, length = all_shingles(words, sizes)
                candidate = np.zeros(len(part), np.int64)
                if passes:
                    hit = np.flatnonzero(passes.hits(hashes))
                    hashes, text, first, length = hashes[hit], text[hit], first[hit], length[hit]
                    held = np.bincount(text, minlength=len(part))  # repeats included: never fewer than distinct ones
                    for number, (sketch, ceiling, least) in classes:
                        low = np.flatnonzero((hashes <= ceiling) & (held[text] >= least))
                        candidate[text[low[sketch.hits(hashes[low])]]] |= np.int64(1 << number)
                    hit = np.flatnonzero(candidate[text])
                    hashes, text, first, length = hashes[hit], text[hit], first[hit], length[hit]
                flat = words.flatten()
                seen, out = set(), [[] for _ in range(len(part))]
                for h, t, f, n in zip(hashes.view(np.int64).tolist(), text.tolist(), first.tolist(), length.tolist()):
                    row = (t, h, " ".join(flat.slice(f, n).to_pylist()))
                    if row not in seen:
                        seen.add(row)
                        out[t].append({"hash": h, "shingle": row[2], "classes": int(candidate[t])})
                parts.append(pa.array(out, pa.list_(kind)))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(kind))
        tidy()

    return shingles


def unsigned(hash_: Column) -> Column:
    """A signed 64-bit hash in an order that sorts as unsigned."""
    return hash_.bitwiseXOR(F.lit(-(1 << 63)))


def item_shingles(items: DataFrame, containment: float) -> DataFrame:
    """item, item_id, hash, shingle, n, needed, size_class and whether the row belongs to the item's sketch."""
    rows = items.where(F.col("text").isNotNull()).distinct().withColumn("item", F.xxhash64("item_id", "text"))
    rows = rows.select("item", "item_id", F.explode(shingles_with()(F.col("text"))).alias("s"))
    item = Window.partitionBy("item", "item_id")  # one item's text bounds its rows
    ranked = rows.select("item", "item_id", "s.hash", "s.shingle").withColumns(
        {"n": F.count("*").over(item), "rank": F.row_number().over(item.orderBy(unsigned(F.col("hash")), "shingle"))}
    )
    needed = F.ceil(F.col("n") * containment - 1e-9)
    return ranked.withColumn("needed", needed).select(
        "item", "item_id", "hash", "shingle", "n", "needed",
        F.floor(F.log2("n")).alias("size_class"),
        (F.col("rank") <= F.col("n") - F.col("needed") + 1).alias("sketched"),
    )


def search(
    docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """doc_id, doc (hash of the text), item_id, n_shingles and n_found of every verified pair."""
    spark = docs.sparkSession
    known = keep(item_shingles(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), containment), "items")
    sketch = known.where("sketched")
    # at most 31 classes, as a class doubles the size
    classes = sketch.groupBy("size_class").agg(F.max(unsigned(F.col("hash"))).alias("ceiling"), F.count("*").alias("rows"), F.min("needed").alias("least")).collect()
    words_of_item = F.when(F.col("n") == 1, F.size(F.split("shingle", " ")))
    sizes = tuple(r["size"] for r in known.select(words_of_item.alias("size")).where(F.col("size") < WORDS).distinct().collect())
    size = max(1, sum(r["rows"] for r in classes))
    passes = spark.sparkContext.broadcast(bloom_of(known, min(MAX_BITS, max(MIN_BITS, size.bit_length() + 8))))

    def tests(row):
        filter_ = bloom_of(sketch.where(F.col("size_class") == row["size_class"]), min(MAX_BITS, max(CLASS_BITS, row["rows"].bit_length() + 6)))
        return int(row["size_class"]), (filter_, np.uint64(row["ceiling"] + (1 << 63)), int(row["least"]))

    wanted = spark.sparkContext.broadcast([tests(r) for r in classes])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = rows.select("doc_id", F.xxhash64("text").alias("doc"), shingles_with(passes, wanted, sizes)(F.col("text")).alias("s"))
    hits = keep(found.select("doc_id", "doc", F.explode("s").alias("s")).select("doc_id", "doc", "s.*"), "hits")

    key = ["doc_id", "doc"]
    per_doc = hits.groupBy(key).agg(F.count_distinct("shingle").alias("held"))
    of_class = F.col("classes").bitwiseAND(F.expr("shiftleft(1L, cast(size_class as int))")) != 0
    pairs = hits.join(sketch.select("item", "item_id", "needed", "hash", "shingle", "size_class"), ["hash", "shingle"]).where(of_class)
    pairs = pairs.select(*key, "item", "item_id", "needed")
    pairs = keep(pairs.distinct(), "candidates")
    same = pairs["doc"] == per_doc["doc"]
    pairs = pairs.join(per_doc, same & pairs["doc_id"].eqNullSafe(per_doc["doc_id"])).where("held >= needed").select(pairs["*"])
    wanted_rows = keep(pairs.join(known.select("item", "n", "shingle"), "item"), "wanted").alias("w")
    held = hits.select("doc_id", "doc", "shingle").distinct()
    held = keep(held, "held").alias("h")
    match = (F.col("w.doc") == F.col("h.doc")) & (F.col("w.shingle") == F.col("h.shingle")) & F.col("w.doc_id").eqNullSafe(F.col("h.doc_id"))
    counted = wanted_rows.join(held, match).groupBy("w.doc_id", "w.doc", "w.item", "w.item_id", "w.n", "w.needed").agg(F.count("*").alias("n_found"))
    return counted.where("n_found >= needed").select("doc_id", "doc", "item_id", F.col("n").alias("n_shingles"), "n_found")


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, **columns: str) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found and containment for every document that holds an item."""
    share = (F.col("n_found") / F.col("n_shingles")).alias("containment")
    best = search(docs, items, containment, **columns).groupBy("doc_id", "item_id").agg(F.max(F.struct(share, "n_shingles", "n_found")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shingles", "b.n_found", "b.containment")


def without_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    found = search(docs, items, containment, doc_id=doc_id, text=text)
    bad = keep(found.select("doc_id", "doc").distinct(), "contaminated")
    own_id, own_text = F.col("row").getField(doc_id), F.col("row").getField(text)
    same = own_id.eqNullSafe(F.col("doc_id")) & (F.xxhash64(own_text) == F.col("doc"))
    return as_row(docs).join(bad, same, "left_anti").select("row.*")
