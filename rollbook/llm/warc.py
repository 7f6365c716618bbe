"""WARC archives as a PySpark Python data source, and web pages written to and read from them.

Writing: every record is a gzip member of its own that states its compressed and whole length in the header's extra
field (the ``sl`` field of the WARC guidelines). A task writes one file under a name of its own attempt; the list of
files is written when the job commits, so files of failed attempts are never read.

Reading: files are planned in byte ranges; a range starts at the first member that begins in it. A record's header is
inflated and parsed first. Predicates on record type and header columns are pushed down and decided on the header alone;
a record that fails is skipped by its stated length without inflating its payload, and payloads are only inflated if the
schema asks for them. Files that are not compressed are read by Content-Length, in one range each.

Records of equal payloads: of payloads from ``MIN_REVISIT`` bytes on, the rows with the smallest id are responses and
all others revisit it. Defined results: a null payload is empty; smaller payloads are all responses; repeated rows of
the smallest id are all responses; rows without an id revisit a copy that has one, else they are responses. An empty
table gives an archive without files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .frames import keep, new_folder

MIN_REVISIT = 100
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
LEVEL = 4
MAGIC = b"\x1f\x8b\x08"
# Fixed names of header fields, and the columns they are read into.
FIELDS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "record_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To", "content_type": "Content-Type",
}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = ", ".join(f"{c} string" for c in FIELDS) + ", payload_bytes bigint, payload binary"
WRITTEN = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload binary"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time; a fixed one keeps archives reproducible


def opened(path: str):
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def clean(value: str) -> str:
    """A header value holds no line breaks."""
    return re.sub(r"[\r\n]+", " ", value)


def record(row: dict) -> bytes:
    """One record: WARC header, HTTP header and, unless it is a revisit, the payload."""
    payload = row["payload"] or b""
    head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""]
    revisit = row["record_type"] == "revisit"
    block = b"\r\n".join(head) + (b"" if revisit else payload)
    lines = {FIELDS[c]: row[c] for c in ("record_type", "record_id", "target_uri", "payload_digest", "refers_to")}
    lines |= {"WARC-Date": DATE, "WARC-Profile": IDENTICAL if revisit else None, "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    header = "".join(f"{k}: {clean(v)}\r\n" for k, v in lines.items() if v is not None)
    return b"WARC/1.1\r\n" + header.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that states its own and its whole length."""
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 10 + 14 + len(body) + 8
    if max(size, len(data)) >= 1 << 32:  # the field has 32 bits: such a record is read to its end
        return MAGIC + b"\0\0\0\0\0\0\xff" + body + tail
    return MAGIC + b"\4\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) + body + tail


class Inflater:
    """Inflates one member step by step from a file."""

    def __init__(self, source, at: int):
        self.source, self.start = source, at
        source.seek(at)
        first = source.read(24)
        self.size = None
        if len(first) == 24 and first[3] & 4 and first[12:14] == b"sl":
            self.size = struct.unpack_from("<I", first, 16)[0]
        self.machine, self.raw, self.read = zlib.decompressobj(31), first, len(first)

    def more(self, most: int) -> bytes:
        while not self.machine.eof:
            if not self.raw:
                self.raw = self.source.read(1 << 16)
                self.read += len(self.raw)
                if not self.raw:
                    raise EOFError("a record ends before its time")
            out = self.machine.decompress(self.raw, most)
            self.raw = self.machine.unconsumed_tail
            if out:
                return out
        return b""

    def until(self, mark: bytes) -> tuple[bytes, bytes]:
        """What comes before a mark, and what was inflated after it."""
        held = b""
        while mark not in held:
            part = self.more(1 << 13)
            if not part:
                return held, b""
            held += part
        before, _, after = held.partition(mark)
        return before, after

    def end(self) -> int:
        """Where the next member begins; without a stated length the rest is inflated and thrown away."""
        if self.size is not None:
            return self.start + self.size
        while self.more(1 << 16):
            pass
        return self.start + self.read - len(self.machine.unused_data)


class Plain:
    """One record of a file that is not compressed."""

    def __init__(self, source, at: int):
        self.source, self.start, self.length = source, at, None
        source.seek(at)

    def more(self, most: int) -> bytes:
        return self.source.read(most)

    def until(self, mark: bytes) -> tuple[bytes, bytes]:
        return Inflater.until(self, mark)

    def end(self) -> int:
        return self.start + self.length


def parsed(header: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    lines = header.decode("utf-8", "replace").replace("\r\n ", " ").split("\r\n")
    return {name.strip().lower(): value.strip() for name, colon, value in (line.partition(":") for line in lines[1:]) if colon}


def wanted(fields: dict, tests: list) -> bool:
    for kind, column, value in tests:
        held = fields.get(FIELDS[column].lower())
        if held is None or kind == "in" and held not in value or kind == "starts" and not held.startswith(value):
            return False
    return True


def records(source, start: int, end: int, size: int, compressed: bool, tests: list, payload: bool) -> Iterator[dict]:
    """Records that begin in a byte range of a file and pass the tests."""
    at = first_member(source, start, end, size) if compressed and start else start
    while at is not None and at < end:
        one = Inflater(source, at) if compressed else Plain(source, at)
        header, rest = one.until(b"\r\n\r\n")
        fields = parsed(header)
        length = int(fields.get("content-length", 0))
        if not compressed:
            one.length = len(header) + 4 + length + 4
        if wanted(fields, tests):
            row = {c: fields.get(name.lower()) for c, name in FIELDS.items()}
            http = fields.get("content-type", "").startswith("application/http")
            parts, held, last = [rest], len(rest), rest
            while held < length and (payload or http and b"\r\n\r\n" not in last):  # without payload up to the header's end
                part = one.more(min(length - held, 1 << 20 if payload else 1 << 13))
                if not part:
                    break
                parts.append(part)
                held += len(part)
                last = b"" if payload else last[-3:] + part
            block = b"".join(parts)[:length]
            head, mark, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
            stated = parsed(head).get("content-length") if http else None
            row["payload_bytes"] = int(stated) if stated is not None else length - len(head) - len(mark)
            row["payload"] = body if payload else None
            yield row
        at = one.end()
        if at >= size:
            return


def first_member(source, start: int, end: int, size: int) -> int | None:
    """The first place from ``start`` on where a member with a record begins."""
    at = start
    while at < end:
        source.seek(at)
        window = source.read(min(1 << 16, size - at))
        hit = window.find(MAGIC)
        while hit >= 0 and at + hit < end:
            try:
                one, head = Inflater(source, at + hit), b""
                while len(head) < 5 and (part := one.more(5 - len(head))):  # a long member header leaves few bytes of the first read
                    head += part
                if head == b"WARC/":
                    return at + hit
            except (zlib.error, EOFError):
                pass
            hit = window.find(MAGIC, hit + 1)
        at += max(1, len(window) - 2)
    return None


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int, size: int):
        self.file, self.start, self.end, self.size = file, start, end, size


class WarcReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        self.columns, self.tests = schema.names, []

    def pushFilters(self, filters):
        for one in filters:
            column = one.attribute[0] if getattr(one, "attribute", None) and len(one.attribute) == 1 else None
            if column in FIELDS and isinstance(one, EqualTo):
                self.tests.append(("in", column, {one.value}))
            elif column in FIELDS and isinstance(one, In):
                self.tests.append(("in", column, set(one.value)))
            elif column in FIELDS and isinstance(one, StringStartsWith):
                self.tests.append(("starts", column, one.value))
            elif column in FIELDS and isinstance(one, IsNotNull):
                self.tests.append(("held", column, None))
            else:
                yield one

    def partitions(self):
        store, place = opened(self.path)
        found = store.get_file_info(fs.FileSelector(place, allow_not_found=True))
        listed = [f for f in found if f.is_file]
        manifests = [f.path for f in listed if os.path.basename(f.path).startswith("_files-")]
        if manifests:
            names = {n for m in manifests for n in json.loads(store.open_input_stream(m).read())}
            listed = [f for f in listed if os.path.basename(f.path) in names]
        else:
            listed = [f for f in listed if f.path.endswith((".warc", ".warc.gz"))]
        ranges = []
        for f in sorted(listed, key=lambda f: f.path):
            step = self.split if f.path.endswith(".gz") else max(f.size, 1)
            ranges += [Range(f"{self.path.rstrip('/')}/{os.path.basename(f.path)}", at, min(at + step, f.size), f.size) for at in range(0, f.size, step)]
        return ranges or [Range("", 0, 0, 0)]

    def read(self, part: Range):
        if not part.file:
            return
        store, place = opened(part.file)
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in self.columns])
        rows, held = [], 0
        with store.open_input_file(place) as source:
            for row in records(source, part.start, part.end, part.size, place.endswith(".gz"), self.tests, "payload" in self.columns):
                rows.append({c: row[c] for c in self.columns})
                held += 256 + len(row["payload"] or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")

    def write(self, iterator):
        store, place = opened(self.path)
        name, sink = f"part-{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            for row in batch.to_pylist():
                if sink is None:
                    store.create_dir(place, recursive=True)
                    sink = store.open_output_stream(f"{place}/{name}", compression=None)
                sink.write(member(record(row)))
        if sink is None:
            return Written([])
        sink.close()
        return Written([name])

    def commit(self, messages):
        store, place = opened(self.path)
        store.create_dir(place, recursive=True)
        with store.open_output_stream(f"{place}/_files-{uuid.uuid4().hex}") as sink:
            sink.write(json.dumps([n for m in messages if m for n in m.files]).encode())


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """Records of an archive; without ``payload`` among the columns no payload is inflated."""
    register(spark)
    return spark.read.format("warc").schema(columns).load(path)


URN = "urn:rollbook:page:"


def write_pages(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """A record per page; copies of a payload become revisits."""
    register(pages.sparkSession)
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("target_uri"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    large = F.octet_length("payload") >= MIN_REVISIT
    first = keep(rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first")), "first-copies")
    both = rows.join(first, "digest", "left")
    revisit = large & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    out = both.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        "payload",
    )
    out.write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record of an archive of pages.

    Responses are digested from the payload read; of revisits only headers are parsed.
    """
    number = lambda c: F.regexp_extract(c, f"<{URN}([^>]*)>", 1).try_cast("long")
    responses = read(spark, path, "record_id string, record_type string, payload binary").where("record_type = 'response'")
    revisits = read(spark, path, "record_id string, record_type string, payload_digest string, refers_to string, payload_bytes bigint").where("record_type = 'revisit'")
    return responses.select(
        number(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        "record_type", F.lit(None).cast("long").alias("refers_to"),
    ).union(
        revisits.select(
            number(F.col("record_id")).alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"),
            "record_type", number(F.col("refers_to")).alias("refers_to"),
        )
    )


def archive(pages: DataFrame, **columns: str) -> DataFrame:
    """Write pages to a new archive in the shared folder and read it back."""
    path = new_folder(pages.sparkSession, "archive")
    write_pages(pages, path, **columns)
    return read_pages(pages.sparkSession, path)
