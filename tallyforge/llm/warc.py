"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about ``frame_bytes``.  Behind each data
frame stands a skippable frame with the map of its records (identifier, offset inside the
frame, length), and at the end of the file the seek table of the Zstandard seekable
format: sizes and checksums of all frames.  Any Zstandard tool unpacks such a bundle to a plain
WARC file; with the seek table and a record map one frame is enough to get one record.

Bundles are written by Spark (one row is one file), so they land on any file system Spark
can write to and a lost task leaves nothing behind.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import map_arrow, read_raw, slices, write_raw
from tallyforge.session import known_size

REVISIT_FROM = 100  # payload bytes
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 16 << 20

# Fixed values of the formats.
FRAME_MAGIC = 0xFD2FB528
MAP_MAGIC = 0x184D2A50
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
LAST_BYTE = "\x8f"  # the seek table ends with it
WARC_VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the tables carry no time; a fixed one keeps bundles reproducible

RECORDS = ("page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, "
           "record_id string, bundle string, frame int, frame_start long, frame_offset long, record_bytes long")


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _clean(url: str) -> str:
    """Blanks and control characters percent-encoded, so that a URL stays one header value."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def build_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; ``refers_to`` is the page of the response it revisits, or None."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [WARC_VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(plain: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers (lower-case names) and block of each record in unpacked bytes."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at offset {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, size = end + 4, int(headers["content-length"])
        yield at, start + size + 4 - at, headers, plain[start:start + size]
        at = start + size + 4


class BundleWriter:
    """Collects records into frames and frames into one bundle."""

    def __init__(self, frame_bytes: int, level: int = 3):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.parts, self.frames, self.size = [], [], 0
        self.records, self.ids, self.held = [], [], 0

    def add(self, identifier: str, record: bytes) -> None:
        self.ids.append([identifier, self.held, len(record)])
        self.records.append(record)
        self.held += len(record)
        if self.held >= self.frame_bytes:
            self.end_frame()

    def _put(self, packed: bytes, plain: bytes) -> None:
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.parts.append(packed)
        self.size += len(packed)

    def end_frame(self) -> None:
        if self.records:
            plain = b"".join(self.records)
            self._put(self.packer.compress(plain), plain)
            ids = json.dumps(self.ids, separators=(",", ":")).encode()
            self._put(struct.pack("<II", MAP_MAGIC, len(ids)) + ids, b"")
            self.records, self.ids, self.held = [], [], 0

    def finish(self) -> bytes:
        self.end_frame()
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        return b"".join(self.parts) + struct.pack("<II", SEEK_TABLE_MAGIC, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int, int]]:
    """(start, packed size, plain size, checksum) of each frame, from the footer alone."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & CHECKSUM_FLAG else 8
    table = bundle[len(bundle) - 9 - count * width:len(bundle) - 9]
    frames, start = [], 0
    for i in range(count):
        packed, plain, *check = struct.unpack_from("<II" + "I" * (width == 12), table, i * width)
        frames.append((start, packed, plain, check[0] if check else 0))
        start += packed
    return frames


def unpack_frame(bundle: bytes, start: int, packed: int, plain: int, check: int) -> bytes:
    out = zstandard.ZstdDecompressor().decompress(bundle[start:start + packed], max_output_size=plain)
    if len(out) != plain or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check:
        raise ValueError(f"damaged frame at {start}")
    return out


def record_map(bundle: bytes) -> dict[str, list[tuple[int, int, int]]]:
    """Record identifier to its places: (frame start, offset inside the frame, length).  Unpacks nothing.

    Repeated rows share an identifier and have several places.
    """
    found: dict[str, list[tuple[int, int, int]]] = {}
    data_start = None
    for start, packed, plain, _ in seek_table(bundle):
        if struct.unpack_from("<I", bundle, start)[0] == MAP_MAGIC:
            for identifier, offset, length in json.loads(bundle[start + 8:start + packed]):
                found.setdefault(identifier, []).append((data_start, offset, length))
        else:
            data_start = start
    return found


def fetch(bundle: bytes, place: tuple[int, int, int]) -> bytes:
    """One record, by unpacking only its frame."""
    start, offset, length = place
    frame = next(f for f in seek_table(bundle) if f[0] == start)
    return unpack_frame(bundle, *frame)[offset:offset + length]


def plan_records(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Pages with their payload's digest and, for repeats, the page they refer to.

    A null html is an empty payload.  Of pages with equal payloads of at least
    ``revisit_from`` bytes the one with the smallest id is the response; rows that repeat
    this id as well are responses too.  A null id is never the smallest; if a group has
    no other id, all its rows are responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("page_id").alias("number"), "url", "html",
                       F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"))
    groups = (own.filter(F.col("size") >= revisit_from).groupBy("digest")
              .agg(F.min("number").cast("string").alias("first"), F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") > 1).select("digest", "first"))
    # Only digests that repeat; a hot one has many rows on the pages' side alone, which Spark can split.
    joined = own.join(known_size(groups, "payload-groups"), "digest", "left")
    refers = F.when((F.col("size") >= revisit_from) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_bundles(pages: DataFrame, revisit_from: int = REVISIT_FROM, frame_bytes: int = FRAME_BYTES,
                  bundle_bytes: int = BUNDLE_BYTES) -> str:
    """Write one record per row of ``pages`` (page_id, url, html) and give the folder of the bundles.

    An empty table writes no bundle.  A payload longer than a frame gets a frame of its
    own.  Null ids and urls leave their header out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(frame_bytes)
        for batch in slices(batches, "html"):
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                writer.add(record_id(row["page_id"], row["digest"]),
                           build_record(row["page_id"], row["url"], payload, row["digest"], row["refers_to"]))
                if writer.size >= bundle_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([writer.finish()[:-1]], pa.binary())], ["content"])
                    writer = BundleWriter(frame_bytes)
        if writer.size or writer.held:
            yield pa.RecordBatch.from_arrays([pa.array([writer.finish()[:-1]], pa.binary())], ["content"])

    return write_raw(map_arrow(plan_records(pages, revisit_from), run, "content binary"), "warc", LAST_BYTE)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64() if t == "long" else pa.int32())
                        for n, t in (x.split() for x in RECORDS.split(", "))])
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            bundle, name = content.as_py(), path.as_py()
            for number, (start, packed, plain, check) in enumerate(seek_table(bundle)):
                if struct.unpack_from("<I", bundle, start)[0] != FRAME_MAGIC:
                    continue
                rows = []
                for offset, length, headers, block in parse_records(unpack_frame(bundle, start, packed, plain, check)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if headers["warc-type"] == "response":
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    else:
                        size = int(http.rpartition(b"Content-Length:")[2])
                        digest = headers["warc-payload-digest"].partition(":")[2]
                    rows.append((headers.get("x-page-id"), size, digest, headers["warc-type"], headers.get("x-refers-to-page-id"),
                                 headers.get("warc-target-uri"), headers["warc-record-id"], name, number, start, offset, length))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                                 schema=schema)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of all bundles in ``folder``, with its place.

    Size and digest of a response are those of the payload that is read; a revisit has
    no payload and gives those of its headers.
    """
    return map_arrow(read_raw(spark, folder), _read, RECORDS)
