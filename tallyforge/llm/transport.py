"""Media columns as MPEG transport streams.

``mux`` puts bytes losslessly into a stream of 188-byte packets: program tables, then
access units as PES packets with timestamps, some of them random-access points.  ``parse``
reads any such stream: program association and map tables, continuity counters,
reassembled elementary packets, their timestamps and random-access points.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import map_arrow, slices
from tallyforge.session import scratch_path

PAD = 64
UNIT_BYTES = 16 << 10
RAP_EVERY = 8  # units
UNIT_TICKS = 3600  # of the 90 kHz clock

# Fixed values of the format.
PACKET = 188
SYNC = 0x47
PAT_PID = 0
PRIVATE_DATA = 0x06  # stream type
PRIVATE_STREAM_1 = 0xBD  # stream id
CRC_POLYNOMIAL = 0x04C11DB7
CLOCK_WRAP = 1 << 33

PROGRAM, PMT_PID, DATA_PID = 1, 0x1000, 0x100


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1 ^ (CRC_POLYNOMIAL if value >> 31 else 0)) & 0xFFFFFFFF
        table.append(value)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    value = 0xFFFFFFFF
    for byte in data:
        value = (value << 8 & 0xFFFFFFFF) ^ _CRC[value >> 24 ^ byte]
    return value


# ---- writing ----

def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


_PAT = _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
_PMT = _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_DATA, 0xE000 | DATA_PID, 0xF000))


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    head = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10 | counter & 15)
    return (head + b"\0" + section).ljust(PACKET, b"\xff")


def _stamp(ticks: int) -> bytes:
    t = ticks % CLOCK_WRAP
    return struct.pack(">BHH", 0x21 | t >> 29 & 0x0E, t >> 14 & 0xFFFE | 1, t << 1 & 0xFFFE | 1)


def mux(payload: bytes, unit_bytes: int = UNIT_BYTES, rap_every: int = RAP_EVERY) -> bytes:
    """A transport stream of one program with one data stream that carries ``payload``."""
    out, counter, tables = [], 0, 0
    for n, start in enumerate(range(0, len(payload), unit_bytes)):
        data = payload[start:start + unit_bytes]
        pes = (struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM_1, len(data) + 8, 0x80, 0x80, 5) + _stamp(n * UNIT_TICKS) + data)
        first_field = b""
        if n % rap_every == 0:
            out += [_table_packet(PAT_PID, _PAT, tables), _table_packet(PMT_PID, _PMT, tables)]
            tables += 1
            clock = n * UNIT_TICKS % CLOCK_WRAP
            first_field = struct.pack(">BIH", 0x50, clock >> 1, (clock & 1) << 15 | 0x7E00)  # random access, clock
        room = PACKET - 4 - (len(first_field) + 1 if first_field else 0)
        count = 1 + max(0, -(-(len(pes) - room) // (PACKET - 4)))
        rows = np.empty((count, PACKET), dtype=np.uint8)
        rows[:, 0], rows[:, 1], rows[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
        rows[0, 1] |= 0x40
        rows[:, 3] = 0x10 | (counter + np.arange(count)) & 15
        counter += count
        raw = np.frombuffer(pes, dtype=np.uint8)
        if count > 2:
            rows[1:-1, 4:] = raw[room:room + (count - 2) * (PACKET - 4)].reshape(-1, PACKET - 4)
        parts = [(0, raw[:room], first_field)]
        if count > 1:
            parts.append((count - 1, raw[room + (count - 2) * (PACKET - 4):], b""))
        for i, piece, adaptation in parts:
            gap = PACKET - 4 - len(piece)
            if gap:
                rows[i, 3] |= 0x20
                rows[i, 4] = gap - 1
                filled = (adaptation or (b"\0" if gap > 1 else b"")).ljust(gap - 1, b"\xff")
                rows[i, 5:4 + gap] = np.frombuffer(filled, dtype=np.uint8)
            rows[i, 4 + gap:] = piece
        out.append(rows.tobytes())
    return b"".join(out)


# ---- reading ----

@dataclass
class Unit:
    """One reassembled elementary packet."""
    packet: int  # number of its first transport packet
    pts: int | None
    dts: int | None
    random_access: bool
    data: bytes


@dataclass
class Stream:
    pid: int
    kind: int
    program: int
    continuity_errors: int = 0
    duplicates: int = 0
    units: list[Unit] = field(default_factory=list)


@dataclass
class Transport:
    packets: int = 0
    lost_bytes: int = 0  # outside packets in step
    damaged: int = 0  # packets flagged by the sender, scrambled or without sense
    programs: dict[int, int] = field(default_factory=dict)  # number to pid of its map
    streams: dict[int, Stream] = field(default_factory=dict)


def _in_step(data: bytes) -> tuple[np.ndarray, int]:
    """Packets as rows; out-of-step bytes are skipped up to the next place where packets follow each other."""
    rows, at, lost = [], 0, 0
    while at + PACKET <= len(data):
        block = np.frombuffer(data, dtype=np.uint8, count=(len(data) - at) // PACKET * PACKET, offset=at).reshape(-1, PACKET)
        good = int(np.argmin(np.append(block[:, 0] == SYNC, False)))
        if good:
            rows.append(block[:good])
            at += good * PACKET
            continue
        step = data.find(b"\x47", at + 1)
        while step >= 0 and step + PACKET < len(data) and data[step + PACKET] != SYNC:
            step = data.find(b"\x47", step + 1)
        lost += (len(data) if step < 0 else step) - at
        at = len(data) if step < 0 else step
    lost += len(data) - at
    return (np.concatenate(rows) if rows else np.zeros((0, PACKET), dtype=np.uint8)), lost


def _kept(rows: np.ndarray, starts: np.ndarray, has: np.ndarray, jump: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Rows with new payload, continuity errors and duplicates, by the counters of one pid's packets."""
    with_data = np.flatnonzero(has)
    if not len(with_data):
        return with_data, 0, 0
    counters = (rows[with_data, 3] & 15).astype(int)
    delta = np.diff(counters) & 15
    same = np.concatenate(([False], (delta == 0) & ~jump[with_data[1:]]))
    for k in np.flatnonzero(same):  # a packet may be sent twice, then it is equal but for its clock
        (a, i), (b, j) = ((rows[with_data[n]], starts[with_data[n]]) for n in (k - 1, k))
        same[k] = i == j and bool((a[i:] == b[j:]).all())
    fresh = with_data[~same]
    delta = np.diff((rows[fresh, 3] & 15).astype(int)) & 15
    return fresh, int(((delta != 1) & ~jump[fresh[1:]]).sum()), int(same.sum())


def _sections(rows: np.ndarray, starts: np.ndarray) -> Iterator[bytes]:
    """Complete table sections with a right checksum from the packets of one pid."""
    held = b""
    for row, start in zip(rows, starts, strict=True):
        data = row[start:].tobytes()
        if row[1] & 0x40 and data:
            tail, data = data[1:1 + data[0]], data[1 + data[0]:]
            if held:
                yield from _whole(held + tail)
            held = data
        elif held:
            held += data
    yield from _whole(held)


def _whole(data: bytes) -> Iterator[bytes]:
    while len(data) > 3 and data[0] != 0xFF:
        size = 3 + ((data[1] & 15) << 8 | data[2])
        if size > len(data):
            return
        if size >= 12 and section_crc(data[:size]) == 0:
            yield data[:size]
        data = data[size:]


def _ticks(data: bytes) -> int:
    return (data[0] >> 1 & 7) << 30 | (data[1] << 7 | data[2] >> 1) << 15 | data[3] << 7 | data[4] >> 1


def _unit(packet: int, data: bytes, random_access: bool) -> Unit | None:
    """An elementary packet; one that is cut short, or isn't one, is None."""
    if len(data) < 9 or data[:3] != b"\0\0\1":
        return None
    size, flags, skip = data[4] << 8 | data[5], data[7] >> 6, 9 + data[8]
    if size and len(data) < 6 + size or len(data) < skip:
        return None
    pts = _ticks(data[9:14]) if flags & 2 and data[8] >= 5 else None
    dts = _ticks(data[14:19]) if flags == 3 and data[8] >= 10 else pts
    return Unit(packet, pts, dts, random_access, data[skip:6 + size if size else len(data)])


def parse(data: bytes) -> Transport:
    """Programs, streams and units of a transport stream; damaged parts are counted and left out."""
    rows, lost = _in_step(data)
    out = Transport(packets=len(rows), lost_bytes=lost)
    if not len(rows):
        return out
    pids = (rows[:, 1].astype(int) & 31) << 8 | rows[:, 2]
    control = rows[:, 3] >> 4 & 3
    length = np.where(control & 2, rows[:, 4].astype(int), -1)
    starts = 5 + length
    bad = (rows[:, 1] & 0x80 > 0) | (rows[:, 3] & 0xC0 > 0) | (control == 0) | (starts > PACKET)
    out.damaged = int(bad.sum())
    has = (control & 1 > 0) & ~bad & (starts < PACKET)
    flags = np.where((length > 0) & ~bad, rows[:, 5], 0)

    def sections(pid: int) -> Iterator[bytes]:
        own = np.flatnonzero((pids == pid) & has)
        kept = own[_kept(rows[own], starts[own], np.ones(len(own), bool), flags[own] & 0x80 > 0)[0]]
        return _sections(rows[kept], starts[kept])

    for s in sections(PAT_PID):
        for i in range(8, len(s) - 4, 4) if s[0] == 0 else ():
            number, pid = struct.unpack_from(">HH", s, i)
            if number:
                out.programs[number] = pid & 0x1FFF
    for number, pid in out.programs.items():
        for s in sections(pid):
            if s[0] != 2 or struct.unpack_from(">H", s, 3)[0] != number:
                continue
            at = 12 + (struct.unpack_from(">H", s, 10)[0] & 0xFFF)
            while at + 5 <= len(s) - 4:
                kind, own, info = struct.unpack_from(">BHH", s, at)
                out.streams.setdefault(own & 0x1FFF, Stream(own & 0x1FFF, kind, number))
                at += 5 + (info & 0xFFF)
    for pid, stream in out.streams.items():
        own = np.flatnonzero((pids == pid) & ~bad)
        if not len(own):
            continue
        fresh, stream.continuity_errors, stream.duplicates = _kept(rows[own], starts[own], has[own], flags[own] & 0x80 > 0)
        kept = own[fresh]
        begins = np.flatnonzero(rows[kept, 1] & 0x40)
        if not len(begins):
            continue
        kept = kept[begins[0]:]
        begins -= begins[0]
        body = rows[kept][np.arange(PACKET)[None, :] >= starts[kept][:, None]].tobytes()
        ends = np.cumsum(PACKET - starts[kept])
        edges = np.append(np.concatenate(([0], ends))[begins], len(body))
        for b, lo, hi in zip(begins, edges, edges[1:], strict=False):
            unit = _unit(int(kept[b]), body[lo:hi], bool(flags[kept[b]] & 0x40))
            if unit is not None:
                stream.units.append(unit)
    return out


# ---- columns ----

def pad(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw.ljust(max(PAD, -(-len(raw) // PAD) * PAD), b"\0")


def write_media(docs: DataFrame) -> str:
    """The media table: ``doc_id``, ``n_bytes`` and the stream ``media`` of each row; gives its folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()),
                 pa.array([mux(pad(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    path = scratch_path(docs.sparkSession, "media")
    media = map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, media binary")
    media.write.option("compression", "zstd").parquet(path)
    return path


_FOUND = ("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
          "feature string, units array<struct<pts:long,packet:long,bytes:long>>, random_access array<struct<pts:long,packet:long>>")


def read_media(media: DataFrame) -> DataFrame:
    """What the stored streams hold: payload of the first data stream, its units' timestamps and random-access points.

    A null stream is an empty one.  ``payload_bytes`` are the bytes of all units; those of
    streams from elsewhere may be none.
    """
    kind = media.schema["doc_id"].dataType.simpleString()
    units = pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64()), ("bytes", pa.int64())]))
    points = pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), units, points]

    def one(n_bytes: int, stored: bytes) -> tuple:
        found = parse(stored)
        stream = next(iter(found.streams.values()), Stream(0, 0, 0))
        payload = b"".join([u.data for u in stream.units])
        stamps = [u.pts for u in stream.units if u.pts is not None]
        points_ = [{"pts": u.pts, "packet": u.packet} for u in stream.units if u.random_access]
        feature = (f"packets={found.packets};programs={len(found.programs)};streams={len(found.streams)};lost={found.lost_bytes};"
                   f"damaged={found.damaged};continuity_errors={stream.continuity_errors};units={len(stream.units)};"
                   f"random_access={len(points_)};first_pts={min(stamps, default=None)};last_pts={max(stamps, default=None)}")
        return (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(stored),
                hashlib.sha256(stored).hexdigest(), feature,
                [{"pts": u.pts, "packet": u.packet, "bytes": len(u.data)} for u in stream.units], points_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id"] + [x.split()[0] for x in _FOUND.split(", ")]
        for batch in slices(batches, "media"):
            rows = [one(n.as_py(), m.as_py() or b"") for n, m in zip(batch.column("n_bytes"), batch.column("media"), strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return map_arrow(media.select("doc_id", "n_bytes", F.col("media")), run, f"doc_id {kind}, {_FOUND}")
