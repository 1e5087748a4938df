import hashlib
import io
import random

import pytest
import zstandard

from tallyforge.llm import warc
from tallyforge.llm.common import read_raw


def expected(rows):
    out, least = [], {}
    for page_id, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 100 and page_id is not None:
            least[payload] = min(page_id, least.get(payload, page_id))
    for page_id, _, html in rows:
        payload = (html or "").encode()
        first = least.get(payload)
        refers = first if first is not None and len(payload) >= 100 and page_id != first else None
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def pages():
    rng = random.Random(2)
    rows = [(1, "http://a/x y\r\nEvil: 1", "é" * 50), (7, None, "é" * 50), (3, "http://a/é", "é" * 50), (4, "u", "short"),
            (5, "u", "short"), (6, "u", None), (None, "u", "é" * 50), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 30),
            (9, "u", "z" * 3_000_000), (10, "u", ""), (11, "u", "dup" * 60), (11, "u", "dup" * 60), (12, "u", "dup" * 60),
            (None, "u", "nobody" * 40), (None, "u", "nobody" * 40)]
    return rows + [(100 + i, f"http://h/{i}", "".join(rng.choices("abc<>é", k=rng.randint(0, 400)))) for i in range(80)]


def test_round_trip(spark):
    rows = pages()
    docs = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, digest string, frame int")
    folder = warc.write_bundles(docs, frame_bytes=2000, bundle_bytes=4000)
    found = warc.read_records(spark, folder).collect()
    got = sorted(((int(r.page_id) if r.page_id else None, r.payload_bytes, r.payload_digest, r.record_type,
                   int(r.refers_to) if r.refers_to else None) for r in found), key=str)
    assert got == expected(rows)
    assert len({r.bundle for r in found}) > 1
    bundles = {r.path: r.content for r in read_raw(spark, folder).collect()}
    for r in found:  # each record from its own frame, by map and by place
        bundle = bundles[r.bundle]
        record = warc.fetch(bundle, (r.frame_start, r.frame_offset, r.record_bytes))
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        assert (r.frame_start, r.frame_offset, r.record_bytes) in warc.record_map(bundle)[r.record_id]
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(next(iter(bundles.values()))), read_across_frames=True).read()
    assert list(warc.parse_records(plain))  # any tool gets a plain WARC file


def test_damage_is_noticed(spark):
    writer = warc.BundleWriter(10)
    writer.add("a", warc.build_record(1, "u", b"x" * 200, "d", None))
    bundle = bytearray(writer.finish())
    frame = warc.seek_table(bytes(bundle))[0]
    with pytest.raises(ValueError):
        warc.unpack_frame(bytes(bundle), *frame[:3], frame[3] ^ 1)


def test_empty_table(spark):
    folder = warc.write_bundles(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_records(spark, folder).collect() == []
