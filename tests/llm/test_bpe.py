import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from rollbook.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "a  b", "a \n b", "\n\n  a", "a\x1cb \x1c\x1d x", "a" * 1250, "don't we'll 's 't", "日本語 テキスト　全角", "x\xa0 y  z", "1234 56 ١٢", "abcabc" * 900, " " * 3000 + "x"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_ids_as_the_library(library):
    draw = random.Random(5)
    letters = " \n\t'slreabcdefghijklmnopqrstuvwxyzABCÉé.,!?0123-—\x1c\xa0 😀"
    texts = ODD + ["".join(draw.choice(letters) for _ in range(draw.randint(0, 80))) for _ in range(1500)]
    encoder = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    for part in (texts, [t for t in texts if "  " not in t], ["", None, " ", "a"], []):
        assert encoder.encode(pa.array(part, pa.string())).to_pylist() == [library.encode_ordinary(t or "") for t in part]


def test_merges_that_give_rise_to_lower_ranks():
    """Ranks out of the usual order: the leftmost lowest pair of a word comes first, as in a plain loop."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"ab": 301, b"abc": 299, b"cab": 298, b"abab": 297, b"aa": 302, b"aaa": 296}

    def plain(word):
        parts = [bytes([b]) for b in word]
        while True:
            options = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]
            if not options:
                return [ranks[p] for p in parts]
            _, i = min(options)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    draw = random.Random(2)
    words = [bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 40))) for _ in range(800)]
    single = np.arange(256)
    for word, packed in zip(words, bpe.replay(words, single, bpe.Merges(ranks))):
        assert np.frombuffer(packed, np.int32).tolist() == plain(word)


def test_cache_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_CHARS", 2000)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 300)
    encoder = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    for k in range(20):
        texts = [f"text {k} number {i * k} goes here" for i in range(50)]
        assert encoder.encode(pa.array(texts)).to_pylist() == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_digests_of_whole_texts(request, library, name):
    df = request.getfixturevalue(name)
    got = bpe.digests(bpe.encode(df, PATH, public_tokenizers.PATTERN)).collect()
    want = []
    for r in df.collect():
        ids = library.encode_ordinary(r["text"] or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((r["doc_id"], len(ids), digest, hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
