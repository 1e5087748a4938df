import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm import common, tokens
from tallyforge.llm.queries import tokenizer_definition

DEFINITION = tokenizer_definition()
REFERENCE = Tokenizer.from_str(DEFINITION)


def reference_ids(text):
    return REFERENCE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAé ßẞΣσ'stve9½\t\n\r\x0b\x1c\x85\xa0́　中<|endoftext|>.!😀İ"), max_size=30), max_size=4))
def test_words_encode_like_whole_texts(texts):
    own = tokens.encoder(DEFINITION)
    assert own.by_word
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == [reference_ids(t) for t in texts]


def test_memory_may_be_full(monkeypatch):
    monkeypatch.setattr(tokens, "_WORDS_KEPT", 3)
    monkeypatch.setattr(tokens, "_PIECES_KEPT", 3)
    own = tokens.Encoder(DEFINITION)
    for text in ("one two three four five", "one two nine ten", "five four é中 three"):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == reference_ids(text)


@pytest.mark.parametrize("block_ids,percentile", [(8, 0.5), (64, 0.9), (1024, 1.0)])
def test_blocks_round_trip(block_ids, percentile):
    rng = random.Random(5)
    for n in (0, 1, 7, block_ids, 3 * block_ids + 5):
        for spread in (1, 2, 300, 50_000, 1 << 16, 1 << 32):
            ids = np.array([rng.randrange(spread) if rng.random() < 0.95 else rng.randrange(1 << 32) for _ in range(n)], np.uint32)
            docs = [(None, ids[:n // 2].tobytes()), (-3, ids[n // 2:].tobytes())]
            f = tokens.TokenFile(tokens.build_file(1, 2, docs, block_ids, percentile) + b"\n")
            assert f.n_ids == n and (f.ids(0, n) == ids).all()
            if n > 3:
                assert (f.ids(2, n - 1) == ids[2:n - 1]).all()
    with pytest.raises(ValueError):
        tokens.TokenFile(tokens.build_file(1, 2, docs) [:-40] + b"x" * 40 + b"\n")


def test_files_hold_every_document(spark):
    rng = random.Random(4)
    texts = [None, "", "It's ONE word <|endoftext|> é", "token " * 3000] + [
        " ".join("".join(rng.choices("abcdé'!9", k=rng.randint(1, 8))) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = [(i * 3 - 20, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, "no id"), (4, "twice"), (4, "twice")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, start int, part string")
    folder = tokens.write_tokens(docs, DEFINITION, file_ids=500)
    found = tokens.read_documents(spark, folder).orderBy("start").collect()
    ids = [r.doc_id for r in found]
    assert ids == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    assert len({(r.part, r.seq) for r in found}) > 2
    place = 0
    want = {}
    for doc, text in rows:
        want.setdefault(doc, []).append(zlib.crc32(np.array(reference_ids(text) + [2], "<u4").tobytes()))
    got = {}
    for r in found:
        assert r.start == place
        place += r.n_tokens
        got.setdefault(r.doc_id, []).append(r.ids_crc32)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_empty_table(spark):
    folder = tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), DEFINITION)
    assert tokens.read_documents(spark, folder).collect() == []


def test_workers_drop_what_other_operators_kept(spark):
    """A worker keeps its encoder between tasks of this operator, not in front of another's."""
    def encode(batches):
        for batch in batches:
            tokens.encoder(DEFINITION)
            yield batch.select(["n"])

    def look(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(tokens._ENCODERS)] * batch.num_rows, pa.int64())], ["n"])

    encode.__module__ = tokens.__name__
    rows = spark.range(8, numPartitions=4).withColumnRenamed("id", "n")
    assert common.map_arrow(rows, encode, "n long").count() == 8
    assert {r.n for r in common.map_arrow(rows, look, "n long").collect()} == {0}
    common.kept("other")["x"] = 1
    common.make_room("other")
    assert common.kept("other") == {"x": 1}
    common.make_room("another")
    assert common.kept("other") == {}


def test_encoder_keeps_no_more_than_there_is_room_for(monkeypatch):
    """What a worker keeps is small, and ids don't depend on what was kept."""
    assert tokens._WORDS_KEPT <= 120_000 and tokens._PIECES_KEPT <= 120_000
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdeé'7?") for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(20)] + ["", "  ", "a  b\n c<|endoftext|>"]
    monkeypatch.setattr(tokens, "_WORDS_KEPT", 50)
    monkeypatch.setattr(tokens, "_PIECES_KEPT", 40)
    own = tokens.Encoder(DEFINITION)
    assert own.by_word
    for _ in range(2):
        assert own.encode(texts[:9]) == own._encode(texts[:9]) and own.encode(texts) == own._encode(texts)
    assert len(own.words) < 9 * 60 + 1  # nothing of the second batch


def test_words_that_share_pieces_share_memory():
    """Words with signs around them are no entries of their own."""
    own = tokens.Encoder(DEFINITION)
    texts = [f"{a}token{b}" for a in "(<'\"" for b in ".,;:!?)>"]
    assert own.encode(texts) == own._encode(texts)
    assert len(own.words) < len(texts)


def test_files_are_built_and_read_in_bounded_memory():
    """Ids are packed and unpacked a run at a time, beside the documents and the file there is little."""
    rng = np.random.default_rng(5)
    docs = [(i, rng.integers(0, 49_000, 1000).astype("<u4").tobytes()) for i in range(2500)]
    tracemalloc.start()
    try:
        content = tokens.build_file(0, 0, docs)
        built = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert built < 2 * len(content) + (8 << 20)
    f = tokens.TokenFile(content + b"\n")
    assert f.ids(0, f.n_ids).tobytes() == b"".join(ids for _, ids in docs)
    rows = pa.RecordBatch.from_arrays([pa.array([content + b"\n"], pa.binary())], ["content"])
    tracemalloc.start()
    try:
        read = list(tokens._read(iter([rows])))
        grown = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert grown < len(content) + (16 << 20)
    assert read[0].column("ids_crc32").to_pylist() == [zlib.crc32(ids) for _, ids in docs]
