"""Byte-level BPE by corpus-level merge replay.

A task does not encode word after word. It gathers the distinct words of a block of documents, lays their byte tokens
out in one linked array and keeps an inverted index from the rank of a token pair to the positions where it stands.
Merges are then replayed over the whole block in rank order; each touches only its two neighbours. A word's ids do not
depend on other words, so blocks need no exchange, and a block is bounded whatever the corpus holds.

Defined results: a null text counts as empty and has no ids; the digest of an empty list is that of an empty string.
Strings of special tokens are ordinary text. Repeated rows stay repeated; an empty table gives no rows; other columns
are ignored. Texts are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import slices, tidy

# Fixed value: the white space of Unicode, which the pattern means by \s.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MANY = 24  # positions of a rank that are merged as arrays
BLOCK_CHARS = 3 << 19  # characters of distinct words replayed together
SLICE = 4 << 20  # bytes of text that are encoded at a time: more need more memory, less more time
CACHE_CHARS = 4 << 20  # characters of the chunks whose ids a task keeps at hand
BLANK_RUN = r" ([\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"  # a blank before white space or the end
BLANK_BEFORE_WORD = re.compile(r"(?= \S)")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Merges:
    """The rank of every pair of tokens whose joined bytes are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.of = {
            (ranks[token[:cut]], ranks[token[cut:]]): rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        }
        # tokens that can take part in a merge of lower rank than their own: replayed one position at a time
        self.uneven = {token for pair, rank in self.of.items() for token in pair if rank < token}
        keys = np.array([(a << 32) | b for a, b in self.of], np.int64)
        order = keys.argsort()
        self.keys, self.ranks = keys[order], np.fromiter(self.of.values(), np.int64, len(self.of))[order]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of many pairs, -1 where they don't merge."""
        keys = (left << 32) | right
        at = np.minimum(self.keys.searchsorted(keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)


class PairIndex:
    """Inverted index: rank of a pair of neighbours -> positions of its left token."""

    def __init__(self):
        self.positions: dict[int, list[int]] = {}
        self.runs: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []

    def add(self, rank: int, at: int) -> None:
        if rank in self.positions:
            self.positions[rank].append(at)
        else:
            self.positions[rank] = [at]
            heapq.heappush(self.heap, rank)

    def add_all(self, ranks: np.ndarray, at: np.ndarray) -> None:
        held = np.flatnonzero(ranks >= 0)
        order = held[ranks[held].argsort(kind="stable")]
        ranks, at = ranks[order], at[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
        for rank, start, end in zip(ranks[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
            if rank not in self.runs:
                self.runs[rank] = []
                heapq.heappush(self.heap, rank)
            self.runs[rank].append(at[start:end])

    def pop(self) -> tuple[int, np.ndarray | list[int]]:
        """The lowest rank with its positions in ascending order; an array if they are many."""
        rank = heapq.heappop(self.heap)
        runs, single = self.runs.pop(rank, []), self.positions.pop(rank, [])
        if sum(map(len, runs)) + len(single) < MANY:
            return rank, sorted({*single, *(x for run in runs for x in run.tolist())})
        found = np.sort(np.concatenate([*runs, np.array(single, np.int64)]))
        return rank, found[np.diff(found, prepend=-1) > 0]


def replay(words: list[bytes], single: np.ndarray, merges: Merges) -> list[bytes]:
    """Ids of each word, packed as int32: all merges of the block in rank order, leftmost first inside a word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = lengths.cumsum()
    ids = single[np.frombuffer(b"".join(words), np.uint8)]
    size = len(ids)
    following = np.arange(1, size + 1)
    following[ends - 1] = -1
    previous = np.arange(-1, size - 1)
    previous[ends - lengths] = -1
    word_of = np.repeat(np.arange(len(words)), lengths)
    index = PairIndex()
    inner = np.flatnonzero(following >= 0)
    index.add_all(merges.look_up(ids[inner], ids[inner + 1]), inner)

    def many(rank: int, at: np.ndarray) -> bool:
        """Merge at all positions at once; not if two of them overlap."""
        nxt = following[at]
        good = merges.look_up(ids[at], np.where(nxt >= 0, ids[nxt], -1)) == rank
        at, nxt = at[good], nxt[good]
        if (nxt[:-1] == at[1:]).any():
            return False
        after = following[nxt]
        ids[at], ids[nxt], following[at], following[nxt] = rank, -1, after, -1
        inside = after >= 0
        previous[after[inside]] = at[inside]
        before = previous[at]
        before = before[before >= 0]
        left = np.concatenate([at[inside], before])
        index.add_all(merges.look_up(ids[left], ids[following[left]]), left)
        return True

    _ids, _following, _previous, _word_of, get = *map(memoryview, (ids, following, previous, word_of)), merges.of.get
    while index.heap:
        rank, positions = index.pop()
        if not isinstance(positions, list):
            if rank not in merges.uneven and many(rank, positions):
                continue
            positions = positions.tolist()
        waits = -1  # the word in which a merge gave rise to a lower rank: that one comes first there
        for at in positions:
            nxt = _following[at]
            if nxt < 0 or _ids[at] < 0 or get((_ids[at], _ids[nxt])) != rank:
                continue  # a neighbour was merged meanwhile
            if _word_of[at] == waits:
                index.add(rank, at)
                continue
            _ids[at], _ids[nxt] = rank, -1
            after = _following[at] = _following[nxt]
            _following[nxt] = -1
            before = _previous[at]
            if after >= 0:
                _previous[after] = at
                if (new := get((rank, _ids[after]))) is not None:
                    index.add(new, at)
                    waits = _word_of[at] if new < rank else waits
            if before >= 0 and (new := get((_ids[before], rank))) is not None:
                index.add(new, before)
                waits = _word_of[at] if new < rank else waits
    live = ids >= 0
    counts = np.add.reduceat(live, ends - lengths, dtype=np.int64) * 4
    packed, out, at = ids[live].astype(np.int32).tobytes(), [], 0
    for n in counts.tolist():
        out.append(packed[at : at + n])
        at += n
    return out


def chunks(text: str) -> list[str]:
    """Parts which the pattern splits one by one as it splits the whole text: cut before each blank that is followed
    by something other than white space, where every match of the pattern ends."""
    return [part for part in BLANK_BEFORE_WORD.split(text) if part]


class Encoder:
    """Encodes blocks of texts; ids of recent chunks stay at hand."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.merges = Merges(ranks)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        space = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.split = regex.compile(space)
        self.known: dict[str, bytes] = {}
        self.size = 0

    def _learn(self, fresh: list[str]) -> None:
        """Replay the distinct words of chunks not met before, block by block."""
        words_of = [self.split.findall(part) for part in fresh]
        ids: dict[str, bytes] = {}
        block, held = [], 0

        def flush():
            ids.update(zip(block, replay([w.encode() for w in block], self.single, self.merges)))

        for word in set().union(*words_of):
            block.append(word)
            held += len(word)
            if held >= BLOCK_CHARS:
                flush()
                block, held = [], 0
        if block:
            flush()
        get = ids.__getitem__
        self.known.update((part, get(words[0]) if len(words) == 1 else b"".join(map(get, words))) for part, words in zip(fresh, words_of))
        self.size += sum(map(len, fresh))

    def ids_of(self, parts: list[str]) -> list[bytes]:
        """Packed ids of distinct chunks."""
        fresh = [part for part in parts if part not in self.known]
        if self.size + sum(map(len, fresh)) > CACHE_CHARS:
            self.known, self.size, fresh = {}, 0, parts
        self._learn(fresh)
        return list(map(self.known.__getitem__, parts))

    def _plain(self, texts: pa.Array) -> pa.Array:
        """Ids of texts in which no blank stands before white space: chunks are what lies between blanks."""
        parts = pc.split_pattern(texts, " ")
        bounds = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        # the first part of a text has no blank before it: a second code for it
        firsts, place = np.unique(code[bounds[:-1]], return_inverse=True)
        code = code.astype(np.int64)
        code[bounds[:-1]] = len(names) + place
        later = np.unique(code[code < len(names)])
        packed = [b""] * (len(names) + len(firsts))  # no ids for a text that begins with a blank
        some = [k for k, c in enumerate(firsts.tolist()) if names[c]]
        wanted = [" " + names[c] for c in later.tolist()] + [names[firsts[k]] for k in some]
        for c, ids in zip([*later.tolist(), *(len(names) + k for k in some)], self.ids_of(wanted)):
            packed[c] = ids
        del names, wanted
        ids = np.frombuffer(b"".join(packed), np.int32)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        start, per_part = sizes.cumsum() - sizes, sizes[code]
        before = np.r_[0, per_part.cumsum()]
        at = np.arange(before[-1]) + np.repeat(start[code] - before[:-1], per_part)
        return pa.ListArray.from_arrays(pa.array(before[bounds], pa.int32()), pa.array(ids[at]))

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text; null counts as empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, BLANK_RUN).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._plain(texts)
        rows = [self.ids_of(chunks(t)) for t in texts.filter(pa.array(odd)).to_pylist()]
        bounds = np.r_[0, np.cumsum([sum(map(len, r)) for r in rows])] // 4
        values = pa.array(np.frombuffer(b"".join(b"".join(r) for r in rows), np.int32))
        both = pa.concat_arrays([self._plain(texts.filter(pa.array(~odd))), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)])
        place = np.empty(len(odd), np.int64)
        place[~odd] = np.arange((~odd).sum())
        place[odd] = (~odd).sum() + np.arange(odd.sum())
        return both.take(pa.array(place))


def encode_with(path: str, pattern: str, slice_bytes: int = SLICE):
    """A column function: ids (array of int) of a text by the rank file at ``path``."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(path, pattern)
        for texts in batches:
            yield pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *(encoder.encode(part) for part in slices(texts, slice_bytes))])
        del encoder
        tidy()

    return encode


def decoded(ids: pa.Array, tokens: dict[int, bytes]) -> pa.Array:
    """The bytes of each list of ids."""
    bounds, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    return pa.array([b"".join(map(tokens.__getitem__, flat[a:b].tolist())) for a, b in zip(bounds, bounds[1:])], pa.binary())


def decode_with(path: str):
    """A column function: the bytes of a list of ids."""

    @F.arrow_udf(T.BinaryType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = {rank: token for token, rank in load_ranks(path).items()}
        for ids in batches:
            yield decoded(ids, tokens)

    return decode


def round_trip_with(path: str, pattern: str, slice_bytes: int = SLICE):
    """A column function: ids of a text and the bytes they decode to, by one Python worker instead of two."""
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])

    @F.arrow_udf(kind)
    def round_trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, tokens = Encoder(path, pattern), {rank: token for token, rank in load_ranks(path).items()}
        empty = [pa.array([], pa.list_(pa.int32())), pa.array([], pa.binary())]
        for texts in batches:
            ids = [empty[0], *(encoder.encode(part) for part in slices(texts, slice_bytes))]
            back = [empty[1], *(decoded(part, tokens) for part in ids[1:])]
            yield pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(back)], ["ids", "decoded"])
        del encoder, tokens
        tidy()

    return round_trip


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", slice_bytes: int = SLICE) -> DataFrame:
    """doc_id, ids and the bytes that the ids decode to, for every row."""
    out = docs.select(F.col(doc_id).alias("doc_id"), round_trip_with(path, pattern, slice_bytes)(F.col(text)).alias("r"))
    return out.select("doc_id", "r.ids", "r.decoded")


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of an encoding."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
