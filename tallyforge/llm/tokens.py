"""Token ids as binary files of patched frame-of-reference blocks.

A file holds whole documents.  Their ids are cut into blocks; from each block the
minimum is subtracted, the differences are packed at the width that a chosen percentile
of them needs, and the few that don't fit keep their low bits there and their high bits
in the block's exception list.  Behind the blocks stand the index of block starts, the
index of documents and a footer:

    magic, partition, sequence, block length
    blocks:      minimum u32, width u8, 0 u8, exceptions u16; packed bits; positions u16; high bits u32
    block index: start of each block u64
    documents:   id i64, has an id u8, ids in the document u64 (three columns)
    footer:      offsets of the indexes, counts, checksum of all before, magic

Files are written by Spark, one row each, in ascending order of document: by partition, then sequence.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import kept, map_arrow, read_raw, slices, write_raw
from tallyforge.session import materialize

END_ID = 2
BLOCK_IDS = 1024
PERCENTILE = 0.9
FILE_IDS = 1 << 22
RUN_BLOCKS, RUN_IDS = 128, 1 << 17  # what a worker packs and unpacks at once

MAGIC = b"PFORTOK1"
HEAD = struct.Struct("<8sIII")
BLOCK = struct.Struct("<IBBH")
FOOTER = struct.Struct("<QQQQQI8s")
LAST_BYTE = "\n"

DOCUMENTS = "part int, seq int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


# ---- encoding ----

# The shape for which words between blanks encode independently of each other.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# Texts of these characters only can be cut here as the tokenizer would cut them: letters stand first as they begin no other piece.
_CUT = re.compile("[a-zß-öø-ÿ]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^ \n\t\ra-z0-9ß-öø-ÿ]+")
_SIMPLE_TEXT = re.compile("[ \n\t\r\x21-\x7eÀ-ÖØ-öø-ÿ]*")
# How byte-level tokenizers write bytes: printable ones of Latin-1 as themselves, the others as characters from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}
_WORDS_KEPT, _PIECES_KEPT = 120_000, 120_000  # of both together: pieces are nearly all


class _Known(dict):
    """Ids by piece; an unknown one is encoded when asked for, and kept while there is room: frequent ones, which come early, stay."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(self) < _WORDS_KEPT + _PIECES_KEPT:
            self[piece] = ids
        return ids


class Encoder:
    """Ids of texts; for tokenizers that drop blanks, word pieces are remembered (and words that aren't cut here)."""

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        # Asked of the tokenizer: the definition parsed once more would hold its whole vocabulary a second time.
        normalizer, cutter = ({} if part is None else json.loads(part.__getstate__()) for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        cut = cutter.get("pretokenizers") or [{}]
        self.by_word = (normalizer.get("normalizers") == _NORMALIZERS
                        and cut[0].get("pattern") == {"Regex": _PIECES} and cut[0].get("behavior") == "Removed"
                        and cut[0].get("invert") is True)
        self.words = _Known(self._encode_piece)

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _encode_piece(self, piece: str) -> bytes:
        """Ids of what ``_cut`` gives: pieces, which the tokenizer would not cut any further, straight from its model."""
        if "<|" in piece or not _SIMPLE_TEXT.fullmatch(piece):
            return self._encode([piece])[0]
        ids = [t.id for t in self.tokenizer.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_CHARACTERS))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _cut(self, text: str) -> list[str]:
        """Pieces that encode by themselves: those of simple words, other words as a whole (no piece has their characters)."""
        if "<|" not in text and _SIMPLE_TEXT.fullmatch(text):
            return _CUT.findall(text.lower())
        parts: list[str] = []
        for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
            if "<|" not in w and _SIMPLE_TEXT.fullmatch(w):
                parts += _CUT.findall(w.lower())
            else:
                parts.append(w)
        return parts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return self._encode(texts)
        collecting = gc.isenabled()
        gc.disable()  # many small lists in front of a large memory, and no cycles
        try:
            ids = self.words.__getitem__
            return [b"".join(map(ids, self._cut(text))) for text in texts]
        finally:
            if collecting:
                gc.enable()


_ENCODERS: dict[int, Encoder] = kept(__name__)


def encoder(definition: str) -> Encoder:
    """One encoder per worker process and tokenizer; it keeps its memory between tasks."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


# ---- blocks ----

def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width (row length a multiple of 8) as rows of bytes, first value in the lowest bits."""
    if not width:
        return np.zeros((len(values), 0), dtype=np.uint8)
    v = values.astype(np.uint64).reshape(-1, 2, 4)
    four = v[..., 0] | v[..., 1] << np.uint64(width) | v[..., 2] << np.uint64(2 * width) | v[..., 3] << np.uint64(3 * width)
    low, high, wide = four[:, 0], four[:, 1], 4 * width
    if wide < 64:
        low, high = low | high << np.uint64(wide), high >> np.uint64(64 - wide)
    out = np.stack([low, high], axis=1).astype("<u8").view(np.uint8)
    return np.ascontiguousarray(out[:, :width]).reshape(len(values), -1)


def _unpack(packed: np.ndarray, width: int, count: int) -> np.ndarray:
    """The inverse of ``_pack`` for rows of ``count`` values."""
    if not width:
        return np.zeros((len(packed), count), dtype=np.uint32)
    eight = packed.reshape(-1, width)
    full = np.zeros((len(eight), 16), dtype=np.uint8)
    full[:, :width] = eight
    low, high = full.view("<u8").T
    wide = 4 * width
    if wide < 64:
        mask = np.uint64((1 << wide) - 1)
        low, high = low & mask, (low >> np.uint64(wide) | high << np.uint64(64 - wide)) & mask
    four = np.stack([low, high], axis=1)
    each = np.stack([four >> np.uint64(i * width) for i in range(4)], axis=2) & np.uint64((1 << width) - 1)
    return each.astype(np.uint32).reshape(len(packed), count)


def encode_blocks(ids: np.ndarray, block_ids: int = BLOCK_IDS, percentile: float = PERCENTILE) -> list[bytes]:
    """Patched frame-of-reference blocks of a run of ids (unsigned 32-bit)."""
    blocks = -(-len(ids) // block_ids)
    rows = np.zeros((blocks, block_ids), dtype=np.int64)
    rows.reshape(-1)[:len(ids)] = ids
    if len(ids) % block_ids:
        rows[-1, len(ids) % block_ids:] = ids[-1]  # padding that changes neither minimum nor width much; never read
    least = rows.min(axis=1)
    rows -= least[:, None]
    at = max(0, int(np.ceil(percentile * block_ids)) - 1)
    widths = np.minimum(16, np.frexp(np.partition(rows, at, axis=1)[:, at].astype(float))[1])
    out: list[bytes] = [b""] * blocks
    for width in np.unique(widths):
        chosen = np.flatnonzero(widths == width)
        packed = _pack(rows[chosen] & ((1 << int(width)) - 1), int(width))
        high = rows[chosen] >> int(width)
        for k, i in enumerate(chosen):
            odd = np.flatnonzero(high[k])
            out[i] = (BLOCK.pack(int(least[i]), int(width), 0, len(odd)) + packed[k].tobytes()
                      + odd.astype("<u2").tobytes() + high[k, odd].astype("<u4").tobytes())
    return out


def decode_blocks(data: bytes, starts: np.ndarray, block_ids: int) -> np.ndarray:
    """Ids of the blocks that start at ``starts``; blocks of one width are unpacked together."""
    heads = [BLOCK.unpack_from(data, s) for s in starts]
    out = np.zeros((len(heads), block_ids), dtype=np.uint32)
    widths = np.array([h[1] for h in heads])
    raw = np.frombuffer(data, dtype=np.uint8)
    for width in np.unique(widths):
        chosen = np.flatnonzero(widths == width)
        size = block_ids * int(width) // 8
        packed = np.stack([raw[starts[i] + BLOCK.size:starts[i] + BLOCK.size + size] for i in chosen])
        out[chosen] = _unpack(packed, int(width), block_ids)
    for i, (least, width, _, odd) in enumerate(heads):
        if odd:
            at = starts[i] + BLOCK.size + block_ids * width // 8
            places = np.frombuffer(data, "<u2", odd, at)
            out[i, places] |= np.frombuffer(data, "<u4", odd, at + 2 * odd) << np.uint32(width)
        out[i] += np.uint32(least)
    return out.reshape(-1)


# ---- files ----

def build_file(part: int, seq: int, docs: list[tuple[int | None, bytes]], block_ids: int = BLOCK_IDS,
               percentile: float = PERCENTILE) -> bytes:
    """A whole file but for its last byte, from (document, ids as bytes)."""
    pieces, starts, at, n_ids = [HEAD.pack(MAGIC, part, seq, block_ids)], [], HEAD.size, 0
    for ids in _runs(docs, block_ids * RUN_BLOCKS):  # bounded memory for any length
        for block in encode_blocks(ids, block_ids, percentile):
            pieces.append(block)
            starts.append(at)
            at += len(block)
        n_ids += len(ids)
    index_at = at
    pieces.append(np.array(starts, dtype="<u8").tobytes())
    docs_at = at + 8 * len(starts)
    pieces.append(np.array([d[0] or 0 for d in docs], dtype="<i8").tobytes())
    pieces.append(np.array([d[0] is not None for d in docs], dtype=np.uint8).tobytes())
    pieces.append(np.array([len(d[1]) // 4 for d in docs], dtype="<u8").tobytes())
    check = 0
    for piece in pieces:
        check = zlib.crc32(piece, check)
    pieces.append(FOOTER.pack(index_at, docs_at, len(starts), len(docs), n_ids, check, MAGIC))
    return b"".join(pieces)


def _runs(docs: list[tuple[int | None, bytes]], size: int) -> Iterator[np.ndarray]:
    """The ids of all documents, one behind another, ``size`` at a time."""
    held: list[bytes] = []
    n = 0
    for _, ids in docs:
        at = 0
        while at < len(ids):
            held.append(ids[at:at + 4 * (size - n)])
            at += len(held[-1])
            n += len(held[-1]) // 4
            if n == size:
                yield np.frombuffer(b"".join(held), dtype="<u4")
                held, n = [], 0
    if held:
        yield np.frombuffer(b"".join(held), dtype="<u4")


class TokenFile:
    """Reads a file; ``ids`` of any range unpacks only the blocks it touches."""

    def __init__(self, content: bytes):
        end = len(content) - 1 - FOOTER.size
        index_at, docs_at, blocks, docs, self.n_ids, check, magic = FOOTER.unpack_from(content, end)
        first, self.part, self.seq, self.block_ids = HEAD.unpack_from(content, 0)
        if magic != MAGIC or first != MAGIC or zlib.crc32(content[:end]) != check:
            raise ValueError("damaged token file")
        self.content = content
        self.starts = np.frombuffer(content, "<u8", blocks, index_at).astype(np.int64)
        self.doc_ids = np.frombuffer(content, "<i8", docs, docs_at)
        self.has_id = np.frombuffer(content, np.uint8, docs, docs_at + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(content, "<u8", docs, docs_at + 9 * docs).astype(np.int64)
        self.doc_starts = np.cumsum(self.lengths) - self.lengths

    def ids(self, start: int, stop: int) -> np.ndarray:
        first = start // self.block_ids
        found = decode_blocks(self.content, self.starts[first:-(-stop // self.block_ids)], self.block_ids)
        return found[start - first * self.block_ids:stop - first * self.block_ids]


def write_tokens(docs: DataFrame, definition: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS,
                 percentile: float = PERCENTILE, file_ids: int = FILE_IDS) -> str:
    """Encode all texts with a tokenizer (its JSON definition) and write the files; gives their folder.

    Documents go in ascending order of ``doc_id`` (null first, equal ids by the text's hash),
    each with ``end_id`` behind it.  A null or empty text is the end id alone.  A document is
    never cut; a file ends with the document that takes it over ``file_ids``.  An empty table writes no file.
    """
    if not 0 < block_ids <= 65536 or block_ids % 8:
        raise ValueError("block_ids must be a multiple of 8, at most 65536")
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # a vocabulary, whatever the corpus
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq = encoder(shared.value), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def file() -> pa.RecordBatch:
            content = build_file(part, seq, held, block_ids, percentile)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

        for batch in slices(batches, "text", 2 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), own.encode(texts), strict=True):
                held.append((doc, ids + end))
                size += len(ids) // 4 + 1
                if size >= file_ids:
                    yield file()
                    size, seq = 0, seq + 1
        if held:
            yield file()

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("h"))
               .repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text"))
    return write_raw(map_arrow(ordered, run, "content binary"), "tokens", LAST_BYTE)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            f = TokenFile(content.as_py())
            ids, first = np.zeros(0, dtype=np.uint32), 0
            crcs = []
            for start, length in zip(f.doc_starts.tolist(), f.lengths.tolist(), strict=True):
                if start + length > first + len(ids):  # unpack on, RUN_IDS at a time
                    first, ids = start, f.ids(start, min(f.n_ids, max(start + length, start + RUN_IDS)))
                crcs.append(zlib.crc32(ids[start - first:start - first + length].astype("<u4").tobytes()))
            n = len(crcs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, f.part, np.int32)), pa.array(np.full(n, f.seq, np.int32)),
                 pa.array(f.doc_ids, mask=~f.has_id), pa.array(f.doc_starts), pa.array(f.lengths), pa.array(crcs, pa.int64())],
                [x.split()[0] for x in DOCUMENTS.split(", ")])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``, ``part``, ``seq`` from the files."""
    found = materialize(map_arrow(read_raw(spark, folder), _read, DOCUMENTS), "token-documents")
    # One row per file; the running total over files is the only global step.
    totals = found.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", "seq", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return found.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")
