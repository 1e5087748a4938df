"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers cut the same bytes (a space and the text), so token ends alone tell which tokens
overlap.  In a batch everything is Arrow arrays:

* lists of ids are flattened; parent indices tell each token's document,
* cumulative sums of token lengths, started anew at each document, are token ends,
* an outer hash join on (document, end) lines both sides up.  Its rows, in order, are the
  stretches between neighbouring ends of either side: each lies in one token of A and one of B, and
  each overlapping pair shares one stretch.  So the rows are the links; the ids that a
  row lacks are those of the next row that has one.  Rows with both sides close a group.
* ``Table.group_by`` counts, over many documents at a time, in how many an id pair is linked.

Spark merges these partial counts.  Frequent pairs, at most ``FREQUENT`` of them, go to the workers; what a
document has of all others is joined with their counts.  So no key is hot in that join, and it
moves only the rare part.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import kept, map_arrow, slices
from tallyforge.session import known_size, materialize

FREQUENT = 1 << 20  # 13 bytes each
SLICE_BYTES = 2 << 20
PARTIAL_ROWS = 1 << 21

# How byte-level vocabularies write bytes: printable ones of Latin-1 as themselves, the others as characters from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}
# The cut into words that byte-level tokenizers make by themselves (``use_regex``).
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = "▁"


class ByteLevel:
    """A byte-level BPE tokenizer from its JSON definition.

    Ids in the order of the merges are ranks: then tiktoken encodes alike and several times as fast.
    """

    def __init__(self, definition: str):
        shape = json.loads(definition)
        special = {t["content"] for t in shape.get("added_tokens") or []}
        vocab = shape["model"]["vocab"]
        self.pieces = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in shape.get("added_tokens") or [])]))
        for piece, i in vocab.items():
            if piece not in special:
                self.pieces[i] = bytes(_BYTES[c] for c in piece)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in shape["model"]["merges"]]
        cut = shape.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not shape.get("normalizer")
        if plain and [vocab.get(a + b) for a, b in merges] == list(range(256, 256 + len(merges))):
            import tiktoken

            ranks = {p: i for i, p in enumerate(self.pieces[:256 + len(merges)])}
            self._fast = tiktoken.Encoding("own", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self._fast, self._slow = None, Tokenizer.from_str(definition)
            self._slow.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list:
        """Ids of a space and each text."""
        if self._fast:
            return [self._fast.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int32) for t in texts]
        return [x.ids for x in self._slow.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece tokenizer, which adds the space by itself, from its model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.pieces = [bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(names)]

    def encode(self, texts: list[str]) -> list:
        return self._model.encode(texts, num_threads=1)


def _lists(ids: list) -> pa.ListArray:
    sizes = np.fromiter(map(len, ids), np.int32, len(ids))
    flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in ids]) if len(ids) else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat, pa.int32()))


class Side:
    """One tokenizer with what alignment needs of its vocabulary."""

    def __init__(self, tokenizer: ByteLevel | Pieces):
        self.tokenizer = tokenizer
        self.bytes = pa.array(tokenizer.pieces, pa.binary())
        self.sizes = pc.binary_length(self.bytes).cast(pa.int64())
        self.names = pa.array([str(i) for i in range(len(tokenizer.pieces))], pa.string())

    def joined(self, ids: pa.ListArray) -> pa.Array:
        """The bytes that each list of ids stands for."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.bytes.take(ids.values)), b"")

    def ends(self, ids: pa.ListArray, name: str) -> pa.Table:
        """One row per token: ``end`` (document's number, then the byte where the token ends) and its id."""
        flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids)
        upto = pc.cumulative_sum(self.sizes.take(flat))
        before = pa.concat_arrays([pa.array([0], pa.int64()), upto]).take(ids.offsets.slice(0, len(ids)).cast(pa.int64()))
        ends = pc.subtract(upto, before.take(parent))
        return pa.table({"end": pc.add(pc.shift_left(parent.cast(pa.int64()), 32), ends), name: flat})

    def grouped(self, ids: np.ndarray, group: np.ndarray, groups: int) -> pa.Array:
        """The ids of each group as text, comma between them."""
        offsets = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=groups))))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.names.take(pa.array(ids))), ",")


@dataclass
class Aligner:
    a: Side
    b: Side

    @staticmethod
    def of(definition: str, model: bytes) -> Aligner:
        return Aligner(Side(ByteLevel(definition)), Side(Pieces(model)))

    @property
    def pairs(self) -> int:
        """Id pairs that may occur; pair (a, b) is the number ``a * len(b) + b``."""
        return len(self.a.bytes) * len(self.b.bytes)

    def align(self, texts: pa.Array) -> pa.Table:
        """One row per text: counts, the digest of its groups, its id pairs (ascending) and how often each is linked."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        written = texts.to_pylist()
        a, b = _lists(self.a.tokenizer.encode(written)), _lists(self.b.tokenizer.encode(written))
        wanted = pc.binary_join_element_wise(" ", texts, "").cast(pa.binary())
        same = pc.and_(pc.equal(self.a.joined(a), wanted), pc.equal(self.b.joined(b), wanted))
        good = pc.indices_nonzero(pc.and_(same, pc.greater(pc.binary_length(texts), 0)))
        a, b = a.take(good), b.take(good)
        rows = self.a.ends(a, "a").join(self.b.ends(b, "b"), "end", join_type="full outer", use_threads=False)
        rows = rows.take(pc.sort_indices(rows["end"])).combine_chunks()
        both = pc.and_(pc.is_valid(rows["a"]), pc.is_valid(rows["b"]))
        doc = pc.shift_right(rows["end"], 32).to_numpy()
        link = pc.add(pc.multiply(pc.fill_null_backward(rows["a"]).cast(pa.int64()), len(self.b.bytes)), pc.fill_null_backward(rows["b"]).cast(pa.int64()))
        closes = both.to_numpy().astype(np.int64)
        group = np.cumsum(closes) - closes
        n, groups = len(good), int(closes.sum())
        n_groups = np.bincount(doc[closes == 1], minlength=n)
        words = pc.binary_join_element_wise(*(
            side.grouped(pc.list_flatten(ids).to_numpy(), group[pc.is_valid(rows[name]).to_numpy()], groups)
            for side, ids, name in ((self.a, a, "a"), (self.b, b, "b"))), "|")
        per_doc = pa.array(np.concatenate(([0], np.cumsum(n_groups))), pa.int32())
        written = pc.binary_join(pa.ListArray.from_arrays(per_doc, words), ";")
        digests = [hashlib.sha256(x.as_buffer()).hexdigest() for x in written]
        # Links of one document and pair follow each other in this order.
        runs = pc.run_end_encode(pa.array(np.sort(doc * self.pairs + link.to_numpy())), pa.int32())
        keys, ends = runs.values.to_numpy(), runs.run_ends.to_numpy()
        owner = keys // self.pairs
        per_doc = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))), pa.int32())
        kind = self.key_type()
        found = pa.table({
            "n_a": pc.list_value_length(a).cast(pa.int64()), "n_b": pc.list_value_length(b).cast(pa.int64()),
            "n_groups": pa.array(n_groups, pa.int64()), "n_links": pa.array(np.bincount(doc, minlength=n), pa.int64()),
            "groups_sha256": pa.array(digests, pa.string()),
            "pairs": pa.ListArray.from_arrays(per_doc, pa.array(keys - owner * self.pairs).cast(kind)),
            "times": pa.ListArray.from_arrays(per_doc, pa.array(np.diff(ends, prepend=0), pa.int32()))})
        place = np.full(len(texts), n)  # the row behind the last is that of a text without tokens
        place[good.to_numpy()] = np.arange(n)
        nothing = pa.table({c: pa.array([[] if pa.types.is_list(t) else "" if c == "groups_sha256" else 0], t)
                            for c, t in zip(found.column_names, found.schema.types, strict=True)})
        return pa.concat_tables([found, nothing]).combine_chunks().take(pa.array(place))

    def key_type(self) -> pa.DataType:
        return pa.int32() if self.pairs < 1 << 31 else pa.int64()


_ALIGNERS: dict[tuple[int, int], Aligner] = kept(__name__)


def aligner(definition: str, model: bytes) -> Aligner:
    """One per worker process and pair of tokenizers."""
    key = hash(definition), hash(model)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner.of(definition, model)
    return _ALIGNERS[key]


def aligned(docs: DataFrame, definition: str, model: bytes) -> DataFrame:
    """The alignment of every row of ``docs``, written: ``row``, ``doc_id`` and the columns of ``Aligner.align``."""
    shared = docs.sparkSession.sparkContext.broadcast((definition, model))  # two vocabularies, whatever the corpus
    kind = "int" if Aligner.of(definition, model).key_type() == pa.int32() else "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*shared.value)
        for batch in slices(batches, "text", SLICE_BYTES):
            if batch.num_rows:
                found = own.align(batch.column("text"))
                yield from pa.table({"row": batch.column("row"), "doc_id": batch.column("doc_id")} | {
                    c: found[c] for c in found.column_names}).combine_chunks().to_batches()

    # Written, so a row keeps its number.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    schema = f"row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<{kind}>, times array<int>"
    return materialize(map_arrow(rows, run, schema), "aligned")


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by id pair, over as many documents as fit in ``PARTIAL_ROWS`` pairs."""
    held: list[pa.Table] = []
    size = 0

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("docs", "sum")]).rename_columns(["pair", "docs"])

    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            pairs = pc.list_flatten(batch.column("pairs").slice(start, 256)).cast(pa.int64())
            part = pa.table({"pair": pairs}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "docs"])
            held.append(part)
            size += len(part)
            if size > 2 * PARTIAL_ROWS:
                held = [merged()]
                size = len(held[0])
                if size > PARTIAL_ROWS:
                    yield from held[0].to_batches()
                    held, size = [], 0
    if held:
        yield from merged().to_batches()


def pair_counts(found: DataFrame, b_size: int) -> DataFrame:
    """``pair``, ``docs`` (documents that hold it linked) and ``best`` (no pair of its A id has more), written."""
    partial = map_arrow(found.select("pairs"), _partial_counts, "pair bigint, docs bigint")
    counts = materialize(partial.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.floor(F.col("pair") / b_size)), "pair-counts")
    most = known_size(counts.groupBy("a").agg(F.max("docs").alias("most")), "pair-most")
    return materialize(counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "pair-counts")


def frequent_pairs(counts: DataFrame, limit: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The pairs in ``least`` documents or more (ascending), their counts, whether best; and ``least``, chosen so that they are at most ``limit``."""
    step = F.floor(F.log2("docs") * 16).cast("int")
    sizes = sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("docs").alias("least")).collect(), reverse=True)
    least, held = None, 0
    for s in sizes:  # a row per sixteenth of a power of two
        held += s.n
        if held > limit:
            break
        least = s.least
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), 1 << 62
    table = counts.filter(F.col("docs") >= least).toArrow()
    order = np.argsort(table["pair"].to_numpy())
    return table["pair"].to_numpy()[order], table["docs"].to_numpy()[order], table["best"].to_numpy()[order], least


def _scored(shared) -> object:
    """Sums over a document's frequent pairs, and its other pairs as lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs, best = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                lists = batch.column("pairs")
                flat, times = pc.list_flatten(lists).to_numpy(), pc.list_flatten(batch.column("times")).to_numpy().astype(np.int64)
                parent = pc.list_parent_indices(lists).to_numpy()
                at = np.minimum(np.searchsorted(pairs, flat), max(0, len(pairs) - 1))
                known = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
                n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                np.add.at(n_best, parent[known], times[known] * best[at[known]])
                np.add.at(total, parent[known], times[known] * docs[at[known]])
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(parent[~known], minlength=batch.num_rows)))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(n_best), pa.array(total), pa.ListArray.from_arrays(offsets, pa.array(flat[~known], pa.int64())),
                     pa.ListArray.from_arrays(offsets, pa.array(times[~known]))], ["row", "n_best", "count_sum", "pairs", "times"])

    return run


def with_pair_counts(docs: DataFrame, definition: str, model: bytes, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row per row of ``docs``.

    A text that is null, empty, or isn't what both token sequences stand for, has no tokens: its
    counts are 0 and its digest is empty.  Repeated rows and ids count as documents of their own; other
    columns aren't read.  An empty table gives no rows.  A batch holds the tokens of about
    ``SLICE_BYTES`` of texts, or one text that is longer.
    """
    found = aligned(docs, definition, model)
    counts = pair_counts(found, len(Pieces(model).pieces))
    *table, least = frequent_pairs(counts, frequent)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(table))  # at most ``frequent`` pairs
    first = materialize(map_arrow(found.select("row", "pairs", "times"), _scored(shared), "row bigint, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"), "frequent-scores")
    rare = first.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("row", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
    rare = rare.join(counts.filter(F.col("docs") < least), "pair")
    rest = rare.select("row", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("docs")).alias("count_sum"))
    sums = rest.union(first.select("row", "n_best", "count_sum")).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
