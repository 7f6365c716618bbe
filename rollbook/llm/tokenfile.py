"""Token ids as binary files of shuffled planes.

Ids are cut into blocks of fixed size. A block is turned on its side: one plane for each bit, or each byte, of an id, so
that equal high bits stand together; each plane is compressed with zstandard on its own. A file is

    magic, planes of block 0, planes of block 1, ..., index, length of the index (8 bytes), magic

and its index (compressed) holds the number of ids and plane lengths of every block, then the id and length of every
document. Any block can be read without the others; a document may span blocks.

Documents are encoded where they are read and dealt by ranges of the id, whose borders are approximate quantiles, so
the files follow each other in ascending order whatever their number. A file is written under a name of its own attempt
and only then listed, so a task that runs twice leaves nothing half-written in use. Files go to the shared folder.

Encoding: the library gets each distinct run between ASCII white space once per task. That needs a tokenizer file whose
normaliser, added tokens and split pattern never look across white space (``LAYOUT``); then the ids are those of the
whole text. With any other file, whole texts are encoded.

Defined results: a null text counts as empty and has just the end id. Rows without an id come first. Rows of equal id
follow each other, by text hash. An empty table gives no file and no rows. Other columns are ignored. A very long text is written
and read block by block.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import keep, new_folder, slices, tidy

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
CACHE_BYTES = 12 << 20  # runs whose ids a task keeps at hand
LEVEL = 3
RANGE_ACCURACY = 100_000
# The normaliser and cutting pattern (of word_bpe_49k.json) that never look across white space.
LAYOUT = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)
MARKED = re.compile(r"\S*<\S*")  # added tokens that a run holds whole, and only runs with this sign
HEAD = re.compile(rb"[A-Za-z]+(?=[!-&(-/:-@\[-`{-~])")  # ASCII letters before a sign that no pattern joins to them


# --- format -----------------------------------------------------------------------------------------------------------


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of one block of unsigned 32-bit ids, lowest first; zero planes at the top are left out."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        bits = np.unpackbits(octets, axis=1, bitorder="little")
        planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    else:
        planes = np.ascontiguousarray(octets.T)
    while len(planes) and not planes[-1].any():
        planes = planes[:-1]
    return [p.tobytes() for p in planes]


def from_planes(planes: list[bytes], count: int, kind: str) -> np.ndarray:
    if kind == "bit":
        bits = np.zeros((32, count), np.uint8)
        for k, plane in enumerate(planes):
            bits[k] = np.unpackbits(np.frombuffer(plane, np.uint8), bitorder="little")[:count]
        octets = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    else:
        octets = np.zeros((count, 4), np.uint8)
        for k, plane in enumerate(planes):
            octets[:, k] = np.frombuffer(plane, np.uint8)
    return octets.reshape(-1).view("<u4")


class PlaneWriter:
    """Writes documents one after another; holds one block of ids and the index."""

    def __init__(self, sink, kind: str = "byte", block_ids: int = BLOCK_IDS):
        self.sink, self.kind, self.block_ids = sink, kind, block_ids
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.blocks: list[list[int]] = []
        self.docs: list[tuple[int | None, int]] = []
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = 0
        self.sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= self.block_ids:
            whole = np.concatenate(self.waiting)
            full = len(whole) - len(whole) % self.block_ids
            for at in range(0, full, self.block_ids):
                self._block(whole[at : at + self.block_ids])
            self.waiting, self.held = [whole[full:].copy()], len(whole) - full

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.pack.compress(p) for p in to_planes(ids, self.kind)]
        for plane in planes:
            self.sink.write(plane)
        self.blocks.append([len(ids), *map(len, planes)])

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        index = io.BytesIO()
        index.write(struct.pack("<BQQ", self.kind == "bit", len(self.blocks), len(self.docs)))
        for count, *lengths in self.blocks:
            index.write(struct.pack(f"<QB{len(lengths)}Q", count, len(lengths), *lengths))
        index.write(np.array([d is None for d, _ in self.docs], np.uint8).tobytes())
        index.write(np.diff(np.array([d or 0 for d, _ in self.docs], np.int64), prepend=np.int64(0)).tobytes())
        index.write(np.array([n for _, n in self.docs], np.int64).tobytes())
        packed = self.pack.compress(index.getvalue())
        self.sink.write(packed)
        self.sink.write(struct.pack("<Q", len(packed)) + MAGIC)


class PlaneReader:
    """Index and blocks of one file (anything with seek, tell and read)."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, os.SEEK_END) or source.tell()
        source.seek(end - 16)
        length, magic = struct.unpack("<Q8s", source.read(16))
        if magic != MAGIC:
            raise ValueError("not a plane file, or not written to its end")
        source.seek(end - 16 - length)
        unpack = zstandard.ZstdDecompressor()
        index = unpack.decompress(source.read(length))
        bit, blocks, docs = struct.unpack_from("<BQQ", index)
        self.kind, at, place = "bit" if bit else "byte", 17, len(MAGIC)
        self.blocks = []  # place in the file, number of ids, lengths of the planes
        for _ in range(blocks):
            count, planes = struct.unpack_from("<QB", index, at)
            lengths = struct.unpack_from(f"<{planes}Q", index, at + 9)
            self.blocks.append((place, count, lengths))
            at, place = at + 9 + 8 * planes, place + sum(lengths)
        self.missing = np.frombuffer(index, np.uint8, docs, at).astype(bool)
        self.doc_ids = np.frombuffer(index, np.int64, docs, at + docs).cumsum()
        self.lengths = np.frombuffer(index, np.int64, docs, at + 9 * docs)

    def block(self, number: int) -> np.ndarray:
        place, count, lengths = self.blocks[number]
        self.source.seek(place)
        unpack = zstandard.ZstdDecompressor()
        return from_planes([unpack.decompress(self.source.read(n)) for n in lengths], count, self.kind)

    def pieces(self) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the document in the file, ids) in order; a document that spans blocks comes in several pieces."""
        doc, left = 0, int(self.lengths[0]) if len(self.lengths) else 0
        empty = np.empty(0, np.uint32)
        for number in range(len(self.blocks)):
            ids = self.block(number)
            while True:
                while not left and doc < len(self.lengths):
                    yield doc, empty
                    doc += 1
                    left = int(self.lengths[doc]) if doc < len(self.lengths) else 0
                if not len(ids):
                    break
                take = min(left, len(ids))
                yield doc, ids[:take]
                ids, left = ids[take:], left - take
        while doc < len(self.lengths):
            yield doc, empty
            doc += 1


def opened(path: str):
    """File system and path of a URI."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# --- encoding ---------------------------------------------------------------------------------------------------------


def bytes_of(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of an array of strings without nulls."""
    texts = texts.cast(pa.binary())
    _, places, data = texts.buffers()
    if not len(texts) or data is None:
        return [b""] * len(texts)
    ends = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1].tolist()
    first, whole = ends[0], data.slice(ends[0], ends[-1] - ends[0]).to_pybytes()
    return [whole[a - first : z - first] for a, z in zip(ends, ends[1:])]


class RunEncoder:
    """Packed ids of texts from a tokenizers file; the library sees each distinct run once."""

    def __init__(self, path: str, end_id: int | None, width: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer, self.width = Tokenizer.from_file(path), width
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        layout = json.loads(self.tokenizer.to_str())
        suffix = layout["model"].get("end_of_word_suffix")
        # texts are cut at white space and small ASCII words go straight to the model only for a layout known to allow it
        self.cuts = (layout["normalizer"], layout["pre_tokenizer"]) == LAYOUT and all(MARKED.fullmatch(t) for t in self.special)
        # ids that end a word, if the model marks the ends of words
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool) if suffix else None
        if suffix:
            self.closing[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.end = b"" if end_id is None else end_id.to_bytes(width, "little")
        self.known: dict[bytes, bytes] = {}
        self.size = 0

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """Learn the ids of pieces that are letters alone, joined by blanks and told apart by the ids that end a word.
        Returns those of groups in which some piece is more than one word to the library."""
        kind, width, left = f"<u{self.width}", self.width, []
        for at in range(0, len(words), 1024):
            part = words[at : at + 1024]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, np.uint32)
            ends = ((np.flatnonzero(self.closing[ids]) + 1) * width).tolist()
            if len(ends) != len(part):
                left += part
                continue
            packed, start = ids.astype(kind).tobytes(), 0
            for piece, end in zip(part, ends):
                self.known[piece] = packed[start:end]
                start = end
        return left

    def _encode(self, pieces: list[bytes]) -> None:
        """Learn the ids of pieces. They are joined by an added token, at which the library cuts before all else."""
        encode, kind, width = self.tokenizer.encode, f"<u{self.width}", self.width
        if self.closing is not None:
            # small ASCII letters pass the normaliser and the cutting pattern as they are: one word for the model
            tokenize, known, code, rest = self.tokenizer.model.tokenize, self.known, "H" if width == 2 else "I", []
            for piece in pieces:
                if piece.isalpha() and piece.islower():  # of bytes: ASCII alone
                    known[piece] = array(code, [token.id for token in tokenize(piece.decode())]).tobytes()
                else:
                    rest.append(piece)
            pieces = rest
        if self.closing is not None:
            words = [p for p in pieces if p.isalpha() or (not p.isascii() and p.decode().isalpha())]
            pieces = self._encode_words(words) + [p for p in pieces if p not in self.known]
            pieces = list(dict.fromkeys(pieces))
        apart = pieces
        if self.special:
            joint, mark = next(iter(self.special.items()))
            plain, apart = [p for p in pieces if b"<" not in p], [p for p in pieces if b"<" in p]
            joint = joint.encode()
            for at in range(0, len(plain), 1024):
                part = plain[at : at + 1024]
                ids = np.array(encode(joint.join(part).decode(), add_special_tokens=False).ids, kind)
                cuts = (np.flatnonzero(ids == mark) * width).tolist()
                packed, start = ids.tobytes(), 0
                for piece, end in zip(part, [*cuts, len(packed)]):
                    self.known[piece] = packed[start:end]
                    start = end + width
        for at in range(0, len(apart), 4096):
            part = apart[at : at + 4096]
            found = self.tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False)
            self.known.update((p, np.array(e.ids, kind).tobytes()) for p, e in zip(part, found))

    def _learn(self, fresh: set[bytes]) -> None:
        """Ids of runs not met before; a word and the signs behind it are looked up apart."""
        cut = {run: m.end() for run in fresh if not run.isalpha() and (m := HEAD.match(run))}
        pieces = {run for run in fresh if run not in cut}
        for run, at in cut.items():
            pieces.add(run[:at])
            pieces.add(run[at:])
        known = self.known
        self._encode([piece for piece in pieces if piece not in known])
        for run, at in cut.items():
            known[run] = known[run[:at]] + known[run[at:]]
        self.size += sum(map(len, fresh))

    def encode(self, texts: pa.Array) -> pa.Array:
        """Packed ids of each text, with the end id."""
        texts = pc.fill_null(texts, "")
        if not self.cuts:
            found = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return pa.array([np.array(e.ids, f"<u{self.width}").tobytes() + self.end for e in found], pa.binary())
        words = pc.ascii_split_whitespace(texts)
        bounds = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        # the normaliser composes before it lowers, so only runs of ASCII alone are lowered here; an added token is met
        # in its own letters only
        met = coded.dictionary
        small = pc.and_not(pc.string_is_ascii(met), pc.match_substring(met, "<"))
        lowered = pc.if_else(small, pc.ascii_lower(met), met).dictionary_encode()
        runs = bytes_of(lowered.dictionary)
        fresh = {run for run in runs if run and run not in self.known}
        if self.size + sum(map(len, fresh)) > CACHE_BYTES:
            self.known, self.size, fresh = {}, 0, {run for run in runs if run}
        self._learn(fresh)
        get = self.known.get
        packed = [get(run, b"") for run in runs]  # no ids between two blanks
        kind = f"<u{self.width}"
        ids = np.frombuffer(b"".join(packed), kind)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.width
        firsts, word = sizes.cumsum() - sizes, lowered.indices.to_numpy()[coded.indices.to_numpy()]
        per_word = sizes[word]
        before = np.r_[0, per_word.cumsum()]
        per_text = np.diff(before[bounds - bounds[0]])
        at = np.arange(before[-1]) + np.repeat(firsts[word] - before[:-1], per_word)
        tail = len(self.end) // self.width
        ends = (per_text + tail).cumsum()
        out = np.zeros(int(ends[-1]) if len(ends) else 0, kind)
        own = np.ones(len(out), bool)
        if tail:
            own[ends - 1] = False
            out[ends - 1] = np.frombuffer(self.end, kind)
        out[own] = ids[at]
        places = np.r_[0, ends] * self.width
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(out)])


def encoder(path: str, end_id: int | None, width: int):
    """A column function: ids of a text, packed in ``width`` bytes each."""

    @F.arrow_udf(T.BinaryType())
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        runs = RunEncoder(path, end_id, width)
        for texts in batches:
            parts = [runs.encode(part) for part in slices(texts)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.binary())
        tidy()

    return encode


def part_of(borders: np.ndarray):
    """A column function: how many borders lie below an id (at most as many as partitions); 0 for null."""

    @F.arrow_udf(T.IntegerType())
    def part(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            values = pc.fill_null(ids, np.iinfo(np.int64).min).to_numpy()
            yield pa.array(np.searchsorted(borders, values).astype(np.int32))

    return part


# --- Spark ------------------------------------------------------------------------------------------------------------


def write_ids(docs: DataFrame, path: str, end_id: int | None = None, kind: str = "byte", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all texts and write them in ascending order of the id. Returns the list of files: part, file, n_docs, n_ids."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = Tokenizer.from_file(path).get_vocab_size()
    width = 2 if max(vocabulary, (end_id or 0) + 1) <= 1 << 16 else 4
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark, "token-ids")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], RANGE_ACCURACY)).first()[0] or []
    part = part_of(np.array(sorted(set(cuts)), np.int64))(F.col("doc_id")).alias("part")
    encoded = rows.select("doc_id", part, F.xxhash64("text").alias("tie"), encoder(path, end_id, width)(F.col("text")).alias("ids"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        number = writer = sink = name = None

        def done():
            writer.close()
            sink.close()
            listed = {"part": [number], "file": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.ids]}
            return pa.RecordBatch.from_pydict(listed, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in (0, 1))
            for d, p, packed in zip(*columns, batch.column(3)):
                if p != number:
                    if writer:
                        yield done()
                    number, name = p, f"{folder}/part-{p:06d}-{uuid.uuid4().hex}.ids"
                    store, place = opened(name)
                    store.create_dir(os.path.dirname(place), recursive=True)
                    sink = store.open_output_stream(place)
                    writer = PlaneWriter(sink, kind)
                writer.add(d, np.frombuffer(packed.as_buffer(), f"<u{width}").astype("<u4"))
        if writer:
            yield done()

    dealt = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "tie")
    return keep(dealt.mapInArrow(write, "part int, file string, n_docs long, n_ids long"), "id-files")


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files listed."""
    listed = files.orderBy("part").collect()  # one row per file, at most as many as partitions
    starts, at = [], 0
    for r in listed:
        starts.append((r["file"], at))
        at += r["n_ids"]
    spark = files.sparkSession
    named = spark.createDataFrame(starts, "file string, first long").repartition(max(len(starts), 1))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for name, first in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                store, place = opened(name)
                with store.open_input_file(place) as source:
                    reader = PlaneReader(source)
                    sums = np.zeros(len(reader.lengths), np.int64)
                    for doc, ids in reader.pieces():
                        sums[doc] = zlib.crc32(ids.astype("<u4").tobytes(), int(sums[doc]))
                start = first + np.r_[0, reader.lengths.cumsum()[:-1]] if len(sums) else sums
                whole = [pa.array(reader.doc_ids, mask=reader.missing), pa.array(start), pa.array(reader.lengths), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(whole, names)

    return named.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
