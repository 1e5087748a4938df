import hashlib
import random
import zlib

from tallyforge.llm import transport


def payload_of(parsed, pid=transport.DATA_PID):
    return b"".join(u.data for u in parsed.streams[pid].units)


def test_streams_carry_any_payload():
    rng = random.Random(1)
    for size in [64, 128, 176 - 14, 190, 192, 320, 512, 16384, 16448, 200_000] + [rng.randrange(1, 4000) for _ in range(300)]:
        data = rng.randbytes(size)
        stream = transport.mux(data)
        assert len(stream) % 188 == 0 and set(stream[::188]) == {0x47}
        found = transport.parse(stream)
        own = found.streams[transport.DATA_PID]
        assert payload_of(found) == data
        assert (found.programs, own.continuity_errors, own.duplicates, found.lost_bytes, found.damaged) == ({1: 0x1000}, 0, 0, 0, 0)
        assert [u.pts for u in own.units] == [i * 3600 for i in range(len(own.units))]
        assert [u.random_access for u in own.units] == [i % 8 == 0 for i in range(len(own.units))]


def test_small_units_and_clock_wrap():
    data = bytes(range(256)) * 40
    found = transport.parse(transport.mux(data, unit_bytes=100, rap_every=3))
    assert payload_of(found) == data
    assert transport._ticks(transport._stamp((1 << 33) - 1)) == (1 << 33) - 1


def test_losses_repeats_and_noise():
    data = bytes(range(256)) * 400
    stream = transport.mux(data)
    packets = [stream[i:i + 188] for i in range(0, len(stream), 188)]
    repeated = transport.parse(b"".join(packets[:10] + [packets[9]] + packets[10:]))
    assert payload_of(repeated) == data and repeated.streams[256].duplicates == 1 and repeated.streams[256].continuity_errors == 0
    lost = transport.parse(b"".join(packets[:10] + packets[11:]))
    assert lost.streams[256].continuity_errors == 1
    assert len(lost.streams[256].units) == len(repeated.streams[256].units) - 1  # the unit cut short is left out
    noisy = transport.parse(b"noise" + b"".join(packets[:20]) + b"\x00" * 50 + b"".join(packets[20:]) + b"end")
    assert payload_of(noisy) == data and noisy.lost_bytes == 58
    flagged = bytearray(stream)
    flagged[188 * 12 + 1] |= 0x80
    assert transport.parse(bytes(flagged)).damaged == 1
    assert transport.parse(b"") == transport.Transport()
    assert transport.parse(b"\x47" * 1000).streams == {}


def test_table_over_several_packets():
    entries = b"".join((n).to_bytes(2, "big") + (0xE000 | 0x200 + n).to_bytes(2, "big") for n in range(1, 120))
    section = b"\0" + transport._section(0, 1, entries)
    packets = []
    for i in range(0, len(section), 184):
        head = bytes([0x47, 0x40 if i == 0 else 0, 0, 0x10 | i // 184])
        packets.append((head + section[i:i + 184]).ljust(188, b"\xff"))
    assert len(transport.parse(b"".join(packets)).programs) == 119


def test_columns(spark):
    texts = [None, "", "a", "é" * 32, "x" * 300_000, "same", "same", "nul\0\0"]
    docs = spark.createDataFrame([(i if i else None, t, 1, "m") for i, t in enumerate(texts)],
                                 "doc_id long, text string, n_bytes int, media string")
    found = transport.read_media(spark.read.parquet(transport.write_media(docs))).collect()
    assert len(found) == len(texts)
    for r in found:
        raw = (texts[r.doc_id or 0] or "").encode()
        padded = transport.pad(raw)
        assert r.n_bytes == len(raw) and r.payload_bytes == len(padded) and len(padded) % 64 == 0 and len(padded) > 0
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        assert r.media_sha256 == hashlib.sha256(transport.mux(padded)).hexdigest()
        assert "continuity_errors=0" in r.feature and r.random_access[0].pts == 0
    same = [tuple(r)[1:] for r in found if r.doc_id in (5, 6)]
    assert same[0] == same[1]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert transport.read_media(spark.read.parquet(transport.write_media(empty))).collect() == []
