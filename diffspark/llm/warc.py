"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each holding a run of whole WARC records, then a skippable frame with
the record index (record id -> frame, offset within the frame, length) and, last, a skippable frame with the seek table
(compressed and plain size of every frame) and a fixed footer. One record is read by unpacking one frame.
Bundles are stored as binary cells of a Parquet table, so that any store Spark can write to will do.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the seekable format: skippable frame, magic number of the footer.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
INDEX = 0x184D2A50
DATE = "1970-01-01T00:00:00Z"  # no capture time in the rows; a fixed one keeps reruns equal
CRLF = b"\r\n"


def record_id(page_id: int | None, digest: str, turn: int = 0) -> str:
    """A record's identifier, the same in every run: of a page and its payload; turn counts rows that repeat both."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{turn}')}>"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, url: str, rid: str, digest: str, payload: bytes, extra: dict[str, str]) -> bytes:
    """A WARC/1.1 record. The HTTP block states the payload's full length; a revisit carries that head alone."""
    url = "".join(c for c in url if c >= " ")
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if kind == "revisit" else head + payload
    fields = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": DATE, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest}"}
    fields |= extra | {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items())]
    return "\r\n".join(lines).encode() + CRLF + CRLF + block + CRLF + CRLF


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP head and payload of a record."""
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(CRLF + CRLF)
    return fields, http, payload


def bundle(records: list[tuple[str, bytes]], frame_bytes: int, level: int = 3) -> bytes:
    """(record id, record) pairs as one bundle."""
    pack = zstandard.ZstdCompressor(level=level).compress
    frames: list[bytes] = []
    sizes: list[tuple[int, int]] = []
    index: list[tuple[str, int, int, int]] = []
    held: list[bytes] = []
    size = 0

    def close():
        nonlocal held, size
        frames.append(pack(b"".join(held)))
        sizes.append((len(frames[-1]), size))
        held, size = [], 0

    for rid, data in records:
        index.append((rid, len(frames), size, len(data)))
        held.append(data)
        size += len(data)
        if size >= frame_bytes:
            close()
    if held:
        close()
    body = pack(json.dumps(index).encode())
    frames.append(struct.pack("<II", INDEX, len(body)) + body)
    sizes.append((len(frames[-1]), 0))
    table = b"".join(struct.pack("<II", *x) for x in sizes)
    return b"".join(frames) + struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(sizes), 0, FOOTER)


class Bundle:
    """Random access to a bundle's records."""

    def __init__(self, data: bytes):
        count, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
        if magic != FOOTER or flags:
            raise ValueError("no seek table")
        self.data = data
        entries = struct.iter_unpack("<II", data[len(data) - 9 - 8 * count : len(data) - 9])
        self.frames, at = [], 0
        for packed, plain in entries:
            self.frames.append((at, packed, plain))
            at += packed
        at, packed, _ = self.frames.pop()  # the index is the last entry
        index = zstandard.ZstdDecompressor().decompress(data[at + 8 : at + packed])
        self.index = {rid: (frame, offset, length) for rid, frame, offset, length in json.loads(index)}

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.data[at : at + packed], max_output_size=plain)

    def get(self, rid: str) -> bytes:
        """One record, from its frame alone."""
        k, offset, length = self.index[rid]
        return self.frame(k)[offset : offset + length]

    def __iter__(self) -> Iterator[tuple[str, bytes]]:
        last, frame = -1, b""
        for rid, (k, offset, length) in self.index.items():
            if k != last:
                last, frame = k, self.frame(k)
            yield rid, frame[offset : offset + length]


def _digest(payload: Column) -> Column:
    """SHA-1 as hexadecimal text, for grouping; the bare base32 form is made where records are written."""
    return F.sha1(payload)


def write_warc(
    pages: DataFrame, out: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, frame_bytes: int = 256 << 10, bundle_bytes: int = 8 << 20
) -> None:
    """Writes one record per row, payload the html in UTF-8 (null: empty), into bundles of about bundle_bytes.

    Of equal payloads of at least `least` bytes the row with the smallest id is a response and the others revisit it;
    smaller payloads are all responses. Rows that repeat the smallest id are all responses; a null id revisits the
    smallest id, and is a response where no id is known. The smallest ids come from a partially aggregated table of
    digests; the pages join it by digest (Spark splits the partitions of a hot digest).
    """
    source = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html")
    ).withColumn("digest", _digest(F.encode("html", "UTF-8")))
    first = source.groupBy("digest").agg(F.min("page_id").alias("first"))
    large = F.octet_length("html") >= least
    refers = F.when(large & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = source.join(first, "digest").select("page_id", "url", "html", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        turns: dict[tuple, int] = {}  # of the bundle at hand

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_records": [len(held)], "file": [bundle(held, frame_bytes)]}, schema=BUNDLES)

        for batch in batches:
            for k in range(batch.num_rows):
                pid, target, text, ref = (batch.column(c)[k].as_py() for c in range(4))
                payload = text.encode()
                digest = payload_digest(payload)
                turn = turns[pid, digest] = turns.get((pid, digest), -1) + 1
                rid = record_id(pid, digest, turn)
                extra = {"X-Page-ID": "" if pid is None else str(pid)}
                if ref is not None:
                    extra |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(ref, digest), "X-Refers-To-Page-ID": str(ref)}
                data = record("response" if ref is None else "revisit", target, rid, digest, payload, extra)
                held.append((rid, data))
                size += len(data)
                if size >= bundle_bytes:
                    yield close()
                    held, size, seq, turns = [], 0, seq + 1, {}
        if held:
            yield close()

    rows.mapInArrow(run, "part int, seq int, n_records int, file binary").write.option("parquet.block.size", 16 << 20).parquet(out)


BUNDLES = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_records", pa.int32()), ("file", pa.binary())])


def read_warc(spark, out: str) -> DataFrame:
    """Per record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id, part,
    seq, frame, frame_offset. Sizes and digests are of the full payload: a response's are taken from its payload and
    checked against the record, a revisit states them."""
    files = spark.read.schema("part int, seq int, n_records int, file binary").parquet(out)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "part", "seq", "frame", "frame_offset"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                part, seq = batch.column("part")[n].as_py(), batch.column("seq")[n].as_py()
                archive, rows = Bundle(batch.column("file")[n].as_py()), []
                for rid, data in archive:
                    fields, http, payload = parse(data)
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (len(payload) != length or payload_digest(payload) != digest):
                        raise ValueError(f"record {rid} is damaged")
                    number = [int(x) if x else None for x in (fields["X-Page-ID"], fields.get("X-Refers-To-Page-ID"))]
                    frame, offset, _ = archive.index[rid]
                    rows.append((number[0], fields["WARC-Target-URI"], length, digest, fields["WARC-Type"], number[1], rid, part, seq, frame, offset))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, part int, seq int, frame int, frame_offset int"
    return files.mapInArrow(run, schema)
