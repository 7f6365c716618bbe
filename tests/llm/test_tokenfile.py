import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rollbook.llm import tokenfile

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  lead trail  ", "a\x1cb \x1c\x1d x", "don't we'll 's O'Neil's", "日本語 テキスト　全角", "x\x85y", " \u0301a e\u0301 É", "foo<|endoftext|>bar <|EndOfText|>", "ΑΣ ΣΑΣ. ὈΔΥΣΣΕΎΣ!", "<|", "a<b", "İstanbul ﬁx Å ㎏"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_as_the_library(library, monkeypatch):
    draw = random.Random(4)
    letters = " \n\t'slreabcdxyzABCÉé.,!?0123-\x1c 😀<|>_\u0301ΣσΑ"
    texts = ODD + ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    monkeypatch.setattr(tokenfile, "CACHE_BYTES", 20_000)
    runs = tokenfile.RunEncoder(PATH, 2, 2)
    for at in range(0, len(texts), 200):
        part = texts[at : at + 200]
        for text, packed in zip(part, runs.encode(pa.array(part)).to_pylist()):
            assert np.frombuffer(packed, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids + [2]


def test_composition_comes_before_lowering(library):
    """Capital letters whose composed form with a mark exists for the small letter only, and texts of many blocks."""
    marked = [base + mark for base in "HTWYJhtwyjAEO" for mark in "\u0331\u0308\u030a\u030c\u0301\u0327\u0345"]
    texts = marked + [f"THE {m}x A{m} {m}, {m.lower()}" for m in marked]
    draw = random.Random(11)
    blocks = [(0x20, 0x7F), (0xA0, 0x24F), (0x300, 0x36F), (0x370, 0x52F), (0x5D0, 0x6FF), (0x900, 0xDFF), (0x1100, 0x11FF), (0x1E00, 0x206F),
              (0x2100, 0x218F), (0x3000, 0x30FF), (0x4E00, 0x4E80), (0xAC00, 0xAD00), (0xFB00, 0xFB4F), (0xFF00, 0xFFEF), (0x10400, 0x1044F), (0x1F600, 0x1F64F)]
    for _ in range(3000):
        chosen = draw.sample(blocks, 3) + [(0x41, 0x5B), (0x61, 0x7B), (0x20, 0x21)]
        texts.append("".join(chr(draw.randrange(*draw.choice(chosen))) for _ in range(draw.randint(1, 30))))
    runs = tokenfile.RunEncoder(PATH, 2, 2)
    for text, packed in zip(texts, runs.encode(pa.array(texts)).to_pylist()):
        assert np.frombuffer(packed, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids + [2], text.encode()


def test_other_layouts_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    runs, other = tokenfile.RunEncoder(path, None, 2), Tokenizer.from_file(path)
    texts = ["Two  words", " lead", "a\nb<|endoftext|>", "", "H\u0331 é"]
    for text, packed in zip(texts, runs.encode(pa.array(texts)).to_pylist()):
        assert np.frombuffer(packed, "<u2").tolist() == other.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_files_give_back_what_was_written(kind):
    draw = np.random.default_rng(1)
    docs = [(None, 5), (-3, 0), (7, 2500), (7, 1), (8, 0), (1 << 40, 999), (1 << 41, 0)]
    ids = [draw.integers(0, 1 << 31, n).astype("<u4") for _, n in docs]
    sink = io.BytesIO()
    writer = tokenfile.PlaneWriter(sink, kind, block_ids=1000)
    for (doc_id, _), values in zip(docs, ids):
        writer.add(doc_id, values)
    writer.close()
    reader = tokenfile.PlaneReader(sink)
    found = [[] for _ in docs]
    for doc, part in reader.pieces():
        found[doc].append(part)
    assert all(np.array_equal(np.concatenate(f), v) for f, v in zip(found, ids))
    assert [None if m else int(d) for d, m in zip(reader.doc_ids, reader.missing)] == [d for d, _ in docs]
    whole = np.concatenate(ids)
    assert np.array_equal(reader.block(2), whole[2000:3000])
    with pytest.raises(ValueError):
        tokenfile.PlaneReader(io.BytesIO(sink.getvalue()[:-3]))


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_round_trip_in_ascending_order(request, library, name):
    df = request.getfixturevalue(name)
    files = tokenfile.write_ids(df, PATH, end_id=2)
    got = sorted((tuple(r) for r in tokenfile.read_ids(files).collect()), key=lambda r: r[1])
    assert len(got) == df.count()
    assert [g[0] for g in got] == sorted((g[0] for g in got), key=lambda d: (d is not None, d or 0))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and (not got or got[0][1] == 0)
    want = []
    for r in df.collect():
        ids = np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((r["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(((g[0], g[2], g[3]) for g in got), key=str) == sorted(want, key=str)


def test_bytes_of_slices():
    texts = pa.array(["", "a", "éß", "", "long " * 9])
    for some in (texts, texts[1:4], texts[2:2], texts[3:4], texts.cast(pa.large_string()), texts[:1]):
        assert tokenfile.bytes_of(some) == [t.encode() for t in some.to_pylist()]


def test_letters_of_either_case_are_one_run(monkeypatch):
    """Small and capital letters of one word are learned and looked up once, in one slice and over many."""
    runs, asked = tokenfile.RunEncoder(PATH, None, 2), []
    learn = runs._learn
    monkeypatch.setattr(runs, "_learn", lambda fresh: (asked.append(sorted(fresh)), learn(fresh)))
    words = ["Word", "WORD", "É", "word", "<S>", "a1"]
    seen = []
    monkeypatch.setattr(tokenfile, "bytes_of", lambda met: seen.append(met.to_pylist()) or [t.encode() for t in met.to_pylist()])
    got = runs.encode(pa.array([" ".join(words)]))
    assert seen == [["word", "É", "<S>", "a1"]] and asked == [sorted(t.encode() for t in seen[0])]
    want = runs.tokenizer.encode(" ".join(words), add_special_tokens=False).ids
    assert got[0].as_py() == np.array(want, "<u2").tobytes()
