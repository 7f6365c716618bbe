import gzip
import hashlib
import io
import os

import pytest

from rollbook.llm import warc
from rollbook.llm.frames import new_folder

from ..conftest import DATA


def expected(rows):
    payloads = [(i, (html or "").encode()) for i, _, html in rows]
    first = {}
    for i, p in payloads:
        if i is not None and len(p) >= 100:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, p in payloads:
        revisit = p in first and i != first[p]
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first[p] if revisit else None))
    return sorted(out, key=str)


ODD = [
    (1, "http://a", "x" * 99), (2, "http://b", "x" * 99), (3, "http://c", "y" * 100), (4, None, "y" * 100), (None, "u", "y" * 100), (5, "line\r\nbreak", None), (6, "", ""),
    (7, "http://d", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40), (8, "http://e", "é日😀" * 200_000), (8, "http://e", "é日😀" * 200_000), (9, "http://f", "z" * 500), (None, "v", "q" * 300), (None, "v", "q" * 300),
]


def test_pages_written_and_read_back(spark):
    df = spark.read.parquet(f"{DATA}/pages.parquet")
    got = sorted((tuple(r) for r in warc.archive(df).collect()), key=str)
    assert got == expected([tuple(r) for r in df.select("page_id", "url", "html").collect()])


def test_odd_pages_and_an_empty_table(spark):
    df = spark.createDataFrame(ODD, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS first", "2 AS payload", "3 AS record_type")
    assert sorted((tuple(r) for r in warc.archive(df).collect()), key=str) == expected(ODD)
    assert warc.archive(df.limit(0)).count() == 0


def archive_of(spark):
    path = new_folder(spark, "test-archive")
    df = spark.createDataFrame([(i, f"http://h{i % 3}.org/{i}", f"<p>page {i}</p>" * (50 + i)) for i in range(60)], "page_id long, url string, html string")
    warc.write_pages(df.coalesce(1), path)
    return path


def test_any_reader_of_gzip_members_reads_the_files(spark):
    path = archive_of(spark).removeprefix("file:")
    name = next(f for f in os.listdir(path) if f.endswith(".warc.gz"))
    whole = gzip.open(os.path.join(path, name)).read()
    assert whole.count(b"WARC/1.1\r\n") == 60 and b"WARC-Target-URI: http://h1.org/1\r\n" in whole


def test_ranges_pushed_predicates_and_left_out_payloads(spark):
    path = archive_of(spark)
    warc.register(spark)
    ranges = spark.read.format("warc").option("split_bytes", 700).load(path)
    assert ranges.rdd.getNumPartitions() > 5
    assert sorted(r["target_uri"] for r in ranges.collect()) == sorted(f"http://h{i % 3}.org/{i}" for i in range(60))
    some = warc.read(
        spark, path, "target_uri string, record_type string, payload_bytes bigint"
    ).where("target_uri LIKE 'http://h1.org/%' AND record_type = 'response'")
    assert {r["target_uri"]: r["payload_bytes"] for r in some.collect()} == {f"http://h1.org/{i}": len(f"<p>page {i}</p>" * (50 + i)) for i in range(60) if i % 3 == 1}
    assert warc.read(spark, path).where("record_type IN ('revisit', 'metadata')").count() == 0


class Counting(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.got = 0

    def read(self, n=-1):
        out = super().read(n)
        self.got += len(out)
        return out


@pytest.mark.parametrize("stated", [True, False])
def test_unwanted_payloads_are_not_inflated(stated):
    rows = [{"record_type": "response" if i % 10 else "revisit", "record_id": f"<{i}>", "target_uri": "u", "payload_digest": "d", "refers_to": None, "payload": os.urandom(400_000)} for i in range(20)]
    pieces = [warc.member(warc.record(r)) if stated else gzip.compress(warc.record(r)) for r in rows]
    source = Counting(b"".join(pieces))
    size = len(source.getvalue())
    found = list(warc.records(source, 0, size, size, True, [("in", "record_type", {"revisit"})], True))
    assert [f["record_id"] for f in found] == ["<0>", "<10>"] and (source.got < size / 4) == stated
    plain = b"".join(warc.record(r) for r in rows)
    read = list(warc.records(io.BytesIO(plain), 0, len(plain), len(plain), False, [], True))
    assert [f["payload"] for f in read] == [r["payload"] if r["record_type"] == "response" else b"" for r in rows]
    assert {f["payload_bytes"] for f in read} == {400_000}


@pytest.mark.parametrize("compressed", [True, False])
def test_long_http_headers_are_read_to_their_end(compressed):
    """Without the payload column the length of a payload is the same, wherever the header's blank line falls."""
    def piece(http, body):
        block = http + b"\r\n\r\n" + body
        head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block)
        return head + block + b"\r\n\r\n"

    pieces, want = [], []
    for size in (100, 20_000, *range(8_000, 8_200)):
        start = b"HTTP/1.1 200 OK\r\nSet-Cookie: " + b"c" * size
        pieces += [piece(start, b"b" * 30_000), piece(start + b"\r\nContent-Length: 777", b"b" * 5)]
        want += [30_000, 777]
    data = b"".join(map(gzip.compress, pieces) if compressed else pieces)
    for payload in (False, True):
        found = list(warc.records(io.BytesIO(data), 0, len(data), len(data), compressed, [], payload))
        assert [f["payload_bytes"] for f in found] == want


@pytest.mark.parametrize("name", ["", *("n" * k for k in range(1, 30))])
def test_ranges_begin_at_members_with_any_header(name):
    """Foreign members with a file name leave any number of bytes of the first read: none may be missed."""
    pieces = []
    for i in range(3):
        record = warc.record({"record_type": "response", "record_id": f"<{i}>", "target_uri": "u", "payload_digest": "d", "refers_to": None, "payload": b"x" * (i + 1)})
        sink = io.BytesIO()
        with gzip.GzipFile(name, "wb", fileobj=sink) as member:
            member.write(record)
        pieces.append(sink.getvalue())
    data = b"".join(pieces)
    found = list(warc.records(io.BytesIO(data), 1, len(data), len(data), True, [], True))
    assert [f["record_id"] for f in found] == ["<1>", "<2>"]
