"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames; a bundle is a run of frames and ends in a seek table, itself a skippable
frame, so that plain Zstandard readers pass over it. The map from a record's identifier to its place names the bundle,
the frame's offset and size in it, and the record's offset within the unpacked frame: one frame is read to get one
record. Bundles are written by Spark's own text writer, whose line separator is the seek table's closing mark; so they
reach any file system that Spark reaches, under its commit protocol.

Of pages with equal payloads (of ``least`` bytes or more) the one with the smallest id carries the payload, the others
are revisit records that refer to it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, shared_path, small_batches

#: Fixed values of the seekable format and of WARC.
SKIPPABLE = 0x184D2A5E
SEEKABLE = b"\xb1\xea\x92\x8f"
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def record_id(page: int | None, url: str | None = None, digest: str = "") -> str:
    """From the page's id alone, so that revisits can name it; of pages without id from url and payload."""
    name = f"page/{page}" if page is not None else f"nameless/{digest}/{url or ''}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _line(text: str | None) -> str:
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def make_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page, url, digest)), ("WARC-Target-URI", _line(url)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page", "" if page is None else str(page)), ("X-Payload-Length", str(len(payload)))]
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        head += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", REVISIT), ("X-Refers-To-Page", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header, block) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0].encode() != VERSION:
            raise ValueError(f"no record at {at}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        body = end + 4
        after = body + int(head["Content-Length"])
        if data[after : after + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} has no end")
        yield at, after + 4 - at, head, data[body:after]
        at = after + 4


class BundleWriter:
    """Frames of about ``frame`` unpacked bytes; a record never crosses frames."""

    def __init__(self, frame: int = 256 << 10, level: int = 3):
        import zstandard

        self.packer, self.frame = zstandard.ZstdCompressor(level=level, write_content_size=True), frame
        self.clear()

    def clear(self) -> None:
        self.frames, self.sizes, self.open, self.held, self.size = [], [], [], 0, 0

    def add(self, record: bytes) -> None:
        self.open.append(record)
        self.held += len(record)
        if self.held >= self.frame:
            self.cut()

    def cut(self) -> None:
        if self.open:
            data = b"".join(self.open)
            packed = self.packer.compress(data)
            self.frames.append(packed)
            self.sizes.append((len(packed), len(data)))
            self.size += len(packed)
            self.open, self.held = [], 0

    def finish(self) -> bytes:
        """The bundle, seek table included."""
        self.cut()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IB", len(self.sizes), 0) + SEEKABLE
        out = b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table
        self.clear()
        return out


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, packed size, unpacked size) of each frame."""
    if bundle[-4:] != SEEKABLE:
        raise ValueError("no seek table")
    n, flags = struct.unpack("<IB", bundle[-9:-4])
    width = 12 if flags & 0x80 else 8
    start = len(bundle) - 9 - n * width
    out, at = [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", bundle, start + k * width)
        out.append((at, packed, plain))
        at += packed
    return out


def read_record(bundle: bytes, frame_offset: int, frame_size: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record, by unpacking its frame alone."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(bundle[frame_offset : frame_offset + frame_size])
    _, _, head, block = next(parse_records(data[offset:]))
    return head, block


def payload_of(head: dict[str, str], block: bytes) -> bytes | None:
    return block[block.index(b"\r\n\r\n") + 4 :] if head["WARC-Type"] == "response" else None


def write_bundles(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, bundle: int = 8 << 20) -> None:
    """Write a record for each row under ``path``. Null html is an empty payload, null url an empty target. Rows that
    repeat the smallest id of their payload are all responses, and so are rows without id."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    copies = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page").alias("first"), F.max("page").alias("last")).where("first <> last").select("digest", "first")
    told = rows.join(copies, "digest", "left").select("page", "url", "payload", "digest", F.expr("case when first <> page then first end").alias("refers_to"))

    def run(batches):
        writer = BundleWriter()
        for batch in batches:
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                writer.add(make_record(page, url, payload, digest, refers))
                if writer.size + writer.held >= bundle:
                    yield pa.RecordBatch.from_arrays([pa.array([writer.finish()[: -len(SEEKABLE)]], pa.binary())], ["bundle"])
        if writer.frames or writer.open:
            yield pa.RecordBatch.from_arrays([pa.array([writer.finish()[: -len(SEEKABLE)]], pa.binary())], ["bundle"])

    small_batches(pages.sparkSession, 64)
    packed = told.mapInArrow(run, "bundle binary").select(F.col("bundle").cast("string").alias("value"))
    packed.write.option("encoding", "ISO-8859-1").option("lineSep", SEEKABLE.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record under ``path``: record_id, page (null where it had none), url, record_type, payload_bytes,
    payload_digest, refers_to and its place: bundle, frame_offset, frame_size, record_offset, record_length. Responses are digested anew and compared
    with their header."""
    import zstandard  # noqa: F401

    shape = "record_id string, page long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, bundle string, frame_offset long, frame_size long, record_offset long, record_length long"

    def run(batches):
        import zstandard

        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content, out = content.as_py(), []
                for start, size, length in seek_table(content):
                    data = plain.decompress(content[start : start + size])
                    if len(data) != length:
                        raise ValueError(f"{name}: frame at {start} has another size")
                    for offset, long, head, block in parse_records(data):
                        payload, digest, n = payload_of(head, block), head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                        if payload is not None and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != n):
                            raise ValueError(f"{name}: {head['WARC-Record-ID']} isn't what it was")
                        refers = head.get("X-Refers-To-Page")
                        out.append((head["WARC-Record-ID"], int(head["X-Page"]) if head["X-Page"] else None, head["WARC-Target-URI"], head["WARC-Type"], n, digest, int(refers) if refers else None, name, start, size, offset, long))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4), strict=True)], [x.split()[0] for x in shape.split(", ")])

    small_batches(spark, 2)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, shape)


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write bundles into the shared folder and read them back; the table of places is written beside them."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_bundles(pages, path, **options)
    places = settle(read_bundles(spark, path), "places")
    small_batches(spark)
    return places

