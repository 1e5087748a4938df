"""Near-duplicates by 64-bit SimHash, searched with tables of distances to reference fingerprints.

Hamming distance obeys the triangle inequality, so two fingerprints within ``radius``
differ by at most ``radius`` in their distance to any reference (pivot).  The table of
distances to many pivots therefore discards pairs without looking at them: whatever
differs by more than ``radius`` in one coordinate is no link.

*Which pairs meet.*  The pivots 0 and all single-bit fingerprints of one block of bits
tell by their distances what stands in that block (d(x, bit) - d(x, 0) is -1 or +1).
The 64 bits are cut into ``blocks`` blocks; ``radius`` differing bits leave at least
``blocks - radius`` blocks untouched, so linked fingerprints agree in all those
coordinates for at least one choice of ``blocks - radius`` blocks.  Each choice is a
table, its coordinates are the bucket key: every link meets in a bucket.
*Within a bucket* a second set of pivots, spread over the whole space, discards by the
maximum coordinate difference; the survivors are verified by exact distance.

*Similar texts.*  64 bits and a small radius find close copies only: texts that share 80 % of
their five-word shingles differ by 9 bits on average and by up to 20.  ``one_of_each`` therefore
takes fingerprints for candidates only, and links texts whose sets of five-word shingles are
similar by 0.8 or more, counted from the texts.  The candidates it would miss come from an exact
join: sets that similar share a shingle among the first fifth of each, in any fixed order of all
shingles (``_similar_pairs``).  Parities of a set's hashes rule pairs out, as many as the set has
shingles or more: those of two sets differ in at most as many places as the sets in shingles.  They
do so within a bucket already, so that long texts that share a passage aren't written as pairs, and
sets that share many buckets are a pair in one of them.

Only distinct fingerprints are searched (copies share one), buckets of many rows are cut
into pieces that meet pairwise in tasks of bounded size, and a task returns a forest of
links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import map_arrow, slices
from tallyforge.llm.components import component_roots
from tallyforge.session import known_size, materialize

SHINGLE_WORDS = 4
RADIUS = 4
BLOCKS = 6
SEED = 42
SIMILAR_WORDS = 5
_PARITY = [f"p{i}" for i in range(8)]
_BUCKET_BITS = 1 << 15  # most parities of a set that go to its buckets, 4 kB
_KEYS = [f"k{i}" for i in range(8)]  # the smallest of a set's buckets, by which two sets agree where they meet
_MARK_BITS = 1 << 25  # 4 MB
COMMON_SHARE = 64  # one of so many texts tells which shingles are common
COMMON_MOST = 1 << 16
HOT_COUNT = 32  # texts of that part with a shingle, from which on its texts are never gathered in one task
# Fingerprints of one bucket that meet in one task; larger buckets are cut.
PIECE_ROWS = 4096
# References inside a bucket: fixed pseudo-random fingerprints.
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}") for i in range(24)], dtype=np.uint64)


def _shingles(text: str | None, words: int) -> list[bytes]:
    """Runs of ``words`` words, joined by one space; a shorter text is one run, one without words none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(parts))
    n = len(parts) - width + 1
    return [joined[s:e] for s, e in zip(starts[:n].tolist(), ends[width - 1:].tolist(), strict=True)]


def _majority(hashes: bytes, size: int) -> np.ndarray:
    """Packed bits that are set in over half of the hashes of ``size`` bytes each."""
    raw = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, size)
    counts = np.zeros(8 * size, dtype=np.int64)
    for at in range(0, len(raw), 1 << 14):  # bounded memory for any text
        counts += np.unpackbits(raw[at:at + (1 << 14)], axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(counts * 2 > len(raw))


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text: bit i is 1 if set in over half of the shingles' XXH64 values.

    Blanks are the six ASCII ones, A-Z are lower-cased, repeated shingles count each
    time.  A text of fewer words is one shingle; one without words (or null) gives zero.
    """
    found = _shingles(text, words)
    digest = xxhash.xxh64_digest
    return int.from_bytes(_majority(b"".join([digest(s, SEED) for s in found]), 8).tobytes(), "big") if found else 0


def with_fingerprint(docs: DataFrame, words: int = SHINGLE_WORDS, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without ``text``, plus ``fp`` (the fingerprint as a signed long)."""
    kept = [c for c in docs.columns if c != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text] + ["fp bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = np.array([fingerprint(t, words) for t in batch.column(text).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found)], [*kept, "fp"])

    return map_arrow(docs, run, schema)


def _block_masks(blocks: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]


def _table_masks(radius: int, blocks: int) -> list[int]:
    """For every choice of blocks that may stay untouched, the bits its pivots tell."""
    if blocks <= radius:
        raise ValueError("more blocks than differing bits are needed")
    return [sum(chosen) for chosen in combinations(_block_masks(blocks), blocks - radius)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links_of(fps: np.ndarray, side: np.ndarray, cross: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest that links what is linked among the fingerprints of one bucket (or two pieces).

    A search from fingerprint to fingerprint: each one reached is compared with those not
    yet reached, first by its row of the pivot table (largest coordinate difference at
    most ``radius``), then by exact distance.  With ``cross`` only the two sides meet.
    """
    table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    left, parents, children = np.arange(len(fps)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            rest = left[side[left] != side[x]] if cross else left
            for p in range(0, len(PIVOTS), 8):  # eight coordinates at a time; most pairs go at once
                rest = rest[np.abs(table[rest, p:p + 8] - table[x, p:p + 8]).max(axis=1, initial=0) <= radius]
                if not len(rest):
                    break
            hits = rest[np.bitwise_count(fps[rest] ^ fps[x]) <= radius]
            if len(hits):
                parents += [x] * len(hits)
                children += hits.tolist()
                queue += hits.tolist()
                left = left[~np.isin(left, hits, assume_unique=True)]
    return fps[np.array(parents, dtype=np.int64)], fps[np.array(children, dtype=np.int64)]


def _search(radius: int):
    """Groups arrive sorted by (bucket, pieces); each is searched when it is complete."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero((np.diff(rows[:, :4], axis=0) != 0).any(axis=1)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(rows)]))
            a, b = [], []
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
                x, y = links_of(np.ascontiguousarray(rows[s:e, 5]).view(np.uint64), rows[s:e, 4], rows[s, 2] != rows[s, 3], radius)
                a.append(x)
                b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(6)])
            held.append(rows)
            if (rows[0, :4] == rows[-1, :4]).all() and (held[0][0, :4] == rows[0, :4]).all():
                continue  # one group so far
            rows = np.ascontiguousarray(np.concatenate(held))
            last = len(rows) - np.argmax((rows[::-1, :4] != rows[-1, :4]).any(axis=1))
            yield from done(rows[:last])
            held = [rows[last:]]
        if held:
            yield from done(np.ascontiguousarray(np.concatenate(held)))

    return run


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Links ``a``, ``b`` that join exactly the fingerprints (``fp``, distinct) within ``radius``, directly or by way of others.

    More ``blocks`` make longer keys and more tables (``blocks`` choose ``radius``): 6 suits
    up to some 10^8 distinct fingerprints, 8 or 10 far more.  The result is the same.
    """
    masks = _table_masks(radius, blocks)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("tab", "mask"))
    keyed = keyed.select("fp", "tab", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    return map_arrow(_dealt(keyed, ["fp"], piece_rows), _search(radius), "a bigint, b bigint").distinct()


def _dealt(keyed: DataFrame, values: list[str], piece_rows: int, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows (``tab, key`` and values) sorted by bucket; of large buckets, by the pairs of pieces that meet.

    Columns ``tab, key, lo, hi, piece`` and the values: a group is what shares the first four; its rows stand in ``order``.
    """
    large = known_size(keyed.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > piece_rows)
                       .select("tab", "key", F.ceil(F.col("n") / piece_rows).cast("int").alias("pieces")), "large-buckets")
    cut = (keyed.join(large, ["tab", "key"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
           .withColumn("piece", F.pmod(F.xxhash64(*values), F.col("pieces")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
           .select("tab", "key", F.least("piece", "other").alias("lo"), F.greatest("piece", "other").alias("hi"), "piece", *values))
    return cut.repartition("tab", "key", "lo", "hi").sortWithinPartitions("tab", "key", "lo", "hi", *order)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", words: int = SHINGLE_WORDS, radius: int = RADIUS,
                    blocks: int = BLOCKS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per row of ``docs``: its id, ``fp`` and ``component_id``, the smallest id reachable over links.

    Null and blank texts have fingerprint zero and link like any other.  Repeated rows
    and repeated ids are kept; a null id counts as no id (it is never the smallest) but
    its row gets the component's id, null if there is no other.  An empty table gives an
    empty result; other columns of ``docs`` are not read.
    """
    marked = materialize(with_fingerprint(docs.select(F.col(id_column).alias("id"), F.col("text")), words), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-classes")
    roots = component_roots(fingerprint_links(classes.select("fp"), radius, blocks, piece_rows))
    # One row for each linked class; classes without a link are their own component.
    linked = classes.join(roots, classes["fp"] == roots["a"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    components = materialize(linked.join(least, "root").select("fp", "component_id"), "components")
    return marked.join(components, "fp").select(F.col("id").alias(id_column), "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the text's distinct five-word shingles; equal hashes count as equal shingles."""
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(s) for s in set(_shingles(text, SIMILAR_WORDS))], dtype=np.uint64))


def _parity(hashes: np.ndarray) -> np.ndarray:
    """512 parities of the set's hashes: those of two sets differ in at most as many bits as the sets in shingles."""
    odd = np.bincount((hashes & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _long_parity(hashes: np.ndarray) -> bytes:
    """Parities as in ``_parity``, a power of two of them and at least two per shingle: large sets need more to be told apart."""
    size = max(512, 1 << int(2 * len(hashes)).bit_length())
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _bucket_parity(parity: bytes, size: int) -> bytes | None:
    """Of a set of ``size`` shingles as many parities or more, at most ``_BUCKET_BITS``; none where the 512 of ``_parity`` are as many."""
    words = min(1 << max(size - 1, 0).bit_length(), _BUCKET_BITS) // 64
    return _folded(np.frombuffer(parity, dtype=np.uint64), words).tobytes() if words > len(_PARITY) else None


def _folded(parity: np.ndarray, size: int) -> np.ndarray:
    """Fewer parities from more."""
    return np.bitwise_xor.reduce(parity.reshape(-1, size), axis=0)


def _prefix(hashes: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The set's first shingles, rare ones before ``common`` ones: sets of similarity 0.8 have one of them in common."""
    n = len(hashes)
    rank = np.zeros(n, dtype=np.int64)
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, ranks[at], 0)
    return hashes[np.lexsort((hashes, rank))][:n - -(-4 * n // 5) + 1]


def common_shingles(docs: DataFrame, share: int = COMMON_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that are common in one of ``share`` texts, and their counts there.

    They decide only the order in which shingles are looked at, never the result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    part = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    found = (map_arrow(part, run, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
             .orderBy(F.desc("n"), "h").limit(COMMON_MOST).collect())
    found = sorted((r.h & (1 << 64) - 1, r.n) for r in found)
    return np.array([h for h, _ in found], dtype=np.uint64), np.array([n for _, n in found], dtype=np.int64)


def _with_sets(docs: DataFrame, words: int, common: np.ndarray, ranks: np.ndarray) -> DataFrame:
    """The rows without ``text``, plus ``fp``, ``node`` (which equal shingle sets share), the set's size ``n``, parities and ``prefix``.

    Of rows of one node in a task the first has the prefix, ``hot`` (those of its shingles that very many texts have), ``parity`` and ``within``.
    """
    kept = [c for c in docs.columns if c != "text"]
    added = ["fp", "node", "n", *_PARITY]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
                       + [f"{c} bigint" for c in added] + ["prefix array<bigint>", "hot array<bigint>", "parity binary", "within binary"])
    crowded = common[ranks >= HOT_COUNT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            numbers, prefixes, hot, parities, within = np.zeros((len(texts), len(added)), dtype=np.int64), [], [], [], []
            for row, text in zip(numbers, texts, strict=True):
                found = shingle_set(text)
                node = _signed(xxhash.xxh3_64_intdigest(found.tobytes())) if len(found) else 0
                row[:3] = _signed(fingerprint(text, words)), node, len(found)
                row[3:] = _parity(found)
                if node in seen or not len(found):
                    for column in (prefixes, hot, parities, within):
                        column.append(None)
                    continue
                seen.add(node)
                first = _prefix(found, common, ranks)
                many = np.isin(first, crowded)
                prefixes.append(first[~many].view(np.int64))
                hot.append(first[many].view(np.int64))
                parities.append(_long_parity(found))
                within.append(_bucket_parity(parities[-1], len(found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(c) for c in numbers.T.copy()]
                + [pa.array(c, pa.list_(pa.int64())) for c in (prefixes, hot)] + [pa.array(c, pa.binary()) for c in (parities, within)],
                [*kept, *added, "prefix", "hot", "parity", "within"])

    return map_arrow(docs, run, schema)


def _groups(batches: Iterator[pa.RecordBatch], columns: int, keys: int = 1, extra: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole groups of sorted rows (equal in the first ``keys`` columns) and where each begins; the last one waits for its rest.

    ``extra``, if given, holds the next column's values of the rows last given out.
    """
    held: list[np.ndarray] = []
    waiting: list = []

    def cut(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rows, np.concatenate(([0], np.flatnonzero((np.diff(rows[:, :keys], axis=0) != 0).any(axis=1)) + 1, [len(rows)]))

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(columns)])
        held.append(rows)
        if extra is not None:
            waiting += batch.column(columns).to_pylist()
        if (rows[0, :keys] == rows[-1, :keys]).all() and (held[0][0, :keys] == rows[0, :keys]).all():
            continue
        rows = np.concatenate(held)
        last = len(rows) - np.argmax((rows[::-1, :keys] != rows[-1, :keys]).any(axis=1))
        if extra is not None:
            extra[:], waiting = waiting[:last], waiting[last:]
        yield cut(rows[:last])
        held = [rows[last:]]
    if held:
        if extra is not None:
            extra[:] = waiting
        yield cut(np.concatenate(held))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From shingles and nodes, sorted, the sets of nodes that share a shingle: ``key`` and ``node``, each set once in a batch."""
    for rows, edges in _groups(batches, 2):
        found: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(np.diff(edges) > 1):
            nodes = np.unique(rows[edges[i]:edges[i + 1], 1])
            if len(nodes) > 1:
                found[_signed(xxhash.xxh3_64_intdigest(nodes.tobytes()))] = nodes
        if found:
            keys = np.repeat(np.array(list(found), dtype=np.int64), [len(v) for v in found.values()])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate(list(found.values())))], ["key", "node"])


def _by_width(within: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Parities of a bucket's nodes: how many words each has (0: none), its place among those of as many, and these by width."""
    width = np.array([len(w) // 8 if w else 0 for w in within], dtype=np.int64)
    place, parities = np.zeros(len(width), dtype=np.int64), {}
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        place[at] = np.arange(len(at))
        parities[w] = np.frombuffer(b"".join([within[i] for i in at]), dtype=np.uint64).reshape(-1, w)
    return width, place, parities


def _able_pairs(rows: np.ndarray, within: list[bytes | None] | None) -> Iterator[np.ndarray]:
    """Pairs of nodes of one bucket (``key, lo, hi, piece, node, n, root``, parities) that sizes and parities don't rule out.

    Only nodes of different roots meet.  Without ``within``, a forest: pairs that join what all of them would.
    ``within`` are further parities of nodes of more than 512 shingles; then rows have ``_KEYS`` too, and a pair with
    some of these in common is given in the smallest such bucket alone.
    """
    size, root, piece, words = rows[:, 5], rows[:, 6], rows[:, 3], np.ascontiguousarray(rows[:, 7:7 + len(_PARITY)]).view(np.uint64)
    cross, forest = rows[0, 1] != rows[0, 2], within is None
    keys = rows[:, 7 + len(_PARITY):]
    width, place, parities = (np.zeros(len(rows), dtype=np.int64), None, {}) if forest else _by_width(within)

    def able(x: int, rest: np.ndarray) -> np.ndarray:
        rest = rest[(root[rest] != root[x]) & (5 * np.minimum(size[rest], size[x]) >= 4 * np.maximum(size[rest], size[x]))]
        rest = rest[piece[rest] != piece[x]] if cross else rest
        rest = rest[9 * np.bitwise_count(words[rest] ^ words[x]).sum(axis=1, dtype=np.int64) <= size[rest] + size[x]]
        return rest if forest or not len(rest) else alike(x, here(x, rest))

    def here(x: int, rest: np.ndarray) -> np.ndarray:
        least = np.where(np.isin(keys[rest], keys[x]), keys[rest], np.iinfo(np.int64).max).min(axis=1)
        return rest[(least == rows[0, 0]) | (least == np.iinfo(np.int64).max)]

    def alike(x: int, rest: np.ndarray) -> np.ndarray:
        fits = np.ones(len(rest), dtype=bool)
        for w, of_width in parities.items() if width[x] else ():
            at = np.flatnonzero(width[rest] == w)
            if len(at):
                least = min(w, width[x])
                other = np.bitwise_xor.reduce(of_width[place[rest[at]]].reshape(len(at), -1, least), axis=1)
                differing = np.bitwise_count(other ^ _folded(parities[width[x]][place[x]], least)).sum(axis=1, dtype=np.int64)
                fits[at] = 9 * differing <= size[rest[at]] + size[x]
        return rest[fits]

    left = np.arange(len(rows))
    queue: list[int] = []
    while len(left) and (queue or len(left) > 1):
        if queue:
            x = queue.pop()
        else:
            x, left = int(left[0]), left[1:]
        hits = able(x, left)
        if len(hits):
            yield np.column_stack([np.full(len(hits), rows[x, 4]), rows[hits, 4]])
            if forest:
                queue += hits.tolist()
                left = left[~np.isin(left, hits, assume_unique=True)]


def _search_able(forest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within: list[bytes | None] | None = None if forest else []
        for rows, edges in _groups(batches, 8 + len(_PARITY) + (0 if forest else len(_KEYS)), 4, within):
            found, held = [], 0
            for i in np.flatnonzero(np.diff(edges) > 1):
                start, end = edges[i], edges[i + 1]
                for pairs in _able_pairs(rows[start:end, 1:], None if forest else within[start:end]):
                    found.append(pairs)
                    held += len(pairs)
                    if held > 1 << 16:
                        yield _pair_batch(found)
                        found, held = [], 0
            if found:
                yield _pair_batch(found)

    return run


def _pair_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def _candidates(buckets: DataFrame, sets: DataFrame, roots: DataFrame | None, piece_rows: int) -> DataFrame:
    """Pairs of nodes in one bucket that may be similar: without ``roots`` a forest of them, else all between different roots."""
    values = ["node", "n", "root", *_PARITY]
    if roots is None:
        keyed = buckets.join(sets.withColumn("root", F.col("node")), "node")
    else:
        rooted = sets.select("node").join(roots.withColumnRenamed("a", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = buckets.join(rooted, "node")
        mixed = placed.groupBy("key").agg((F.min("root") != F.max("root")).alias("mixed")).filter("mixed").select("key")
        placed = materialize(placed.join(mixed, "key", "left_semi"), "mixed-buckets")
        keys = placed.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, len(_KEYS)).alias("keys"))
        keys = keys.select("node", *[F.coalesce(F.get("keys", F.lit(i)), F.get("keys", F.lit(0))).alias(k) for i, k in enumerate(_KEYS)])
        keyed, values = placed.join(sets.join(keys, "node"), "node"), [*values, *_KEYS, "within"]
    keyed = keyed.select(F.lit(0).alias("tab"), "key", *values)
    dealt = _dealt(materialize(keyed, "similar-buckets"), values, piece_rows, ("node",))
    return map_arrow(dealt, _search_able(roots is None), "a bigint, b bigint").distinct()


def _able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``a, piece, node, parity`` sorted with that of ``a`` first: pairs that the long parities don't rule out."""
    group, size, centre = None, 0, np.zeros(0, dtype=np.uint64)
    for batch in batches:
        found = []
        for a, piece, node, n, parity in zip(*(batch.column(c).to_pylist() for c in ("a", "piece", "node", "n", "value")), strict=True):
            own = np.frombuffer(parity, dtype=np.uint64)
            if (a, piece) != group:
                group, size, centre = (a, piece), n, own
                continue
            width = min(len(own), len(centre))
            if 9 * int(np.bitwise_count(_folded(own, width) ^ _folded(centre, width)).sum(dtype=np.int64)) <= size + n:
                found.append((a, node))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``a, piece, node, text`` sorted with the text of ``a`` first: pairs whose shingle sets are similar by 0.8 or more."""
    group, centre = None, np.zeros(0, dtype=np.uint64)
    for batch in slices(batches, "value"):
        found = []
        for a, piece, node, text in zip(*(batch.column(c).to_pylist() for c in ("a", "piece", "node", "value")), strict=True):
            own = shingle_set(text)
            if (a, piece) != group:
                group, centre = (a, piece), own
                continue
            both = len(np.intersect1d(centre, own, assume_unique=True))
            if 9 * both >= 4 * (len(centre) + len(own)):
                found.append((a, node))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])


def _checked(pairs: DataFrame, values: DataFrame, check, piece_rows: int, tag: str) -> DataFrame:
    """The pairs ``a, b`` that pass ``check``, which sees the value of ``a`` and then those of its partners; written.

    ``values`` has ``node``, ``n``, ``value``.  A node of many partners meets them in pieces.
    """
    pieces = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / piece_rows).cast("int").alias("pieces"))
    dealt = pairs.join(pieces, "a").select("a", F.pmod(F.xxhash64("b"), F.col("pieces")).cast("int").alias("piece"), "b")
    wanted = dealt.select("a", "piece", F.col("b").alias("node")).union(dealt.select("a", "piece", F.col("a").alias("node")).distinct())
    rows = wanted.join(values, "node").select("a", "piece", "node", "n", "value").repartition("a", "piece")
    return materialize(map_arrow(rows.sortWithinPartitions("a", "piece", F.col("node") != F.col("a")), check, "a bigint, b bigint"), tag)


def _marks(rows: DataFrame) -> DataFrame:
    """A bitmap of the ranks of ``rows``: at most ``_MARK_BITS`` bits, in rows of 4 kB."""
    at = F.pmod(F.col("rank"), F.lit(_MARK_BITS))
    return materialize(rows.groupBy(F.shiftright(at, 15).alias("bucket")).agg(F.bitmap_construct_agg(at.bitwiseAND(32767)).alias("bits")), "marks")


def _with_mark(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``marked``: whether a row's rank is in the bitmap, which may be by chance but is never missed.  No row is exchanged."""
    at = F.pmod(F.col("rank"), F.lit(_MARK_BITS))
    found = rows.withColumn("bucket", F.shiftright(at, 15)).join(F.broadcast(marks), "bucket", "left")  # at most _MARK_BITS bits
    byte = F.conv(F.hex(F.substr("bits", F.shiftright(at.bitwiseAND(32767), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.pow(F.lit(2), at.bitwiseAND(7)).cast("int")) != 0
    return found.withColumn("marked", F.coalesce(bit, F.lit(False))).drop("bucket", "bits")


def verified(pairs: DataFrame, sets: DataFrame, classes: DataFrame, tagged: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The pairs ``a, b`` of nodes whose texts have a shingle similarity of 0.8 or more.

    Parities, two to four bits per shingle, leave few pairs; only the texts of these are exchanged.
    """
    able = _checked(materialize(pairs, "candidate-pairs"), sets.select("node", "n", F.col("parity").alias("value")), _able, piece_rows, "able-pairs")
    needed = able.select(F.col("a").alias("node")).union(able.select(F.col("b").alias("node"))).distinct()
    needed = known_size(classes.join(needed, "node", "left_semi").select("node", "first.key", "first.no", "first.rank"), "needed-texts")
    able_rows = _with_mark(tagged.select("key", "no", "rank", "text"), _marks(needed)).filter("marked").drop("marked")
    texts = able_rows.join(needed, ["key", "no", "rank"])
    texts = materialize(texts.groupBy("node").agg(F.first("text").alias("value")).withColumn("n", F.lit(0).cast("long")), "candidate-texts")
    return _checked(able, texts, _verify, piece_rows, "similar-pairs")


def _similar_pairs(tagged: DataFrame, marked: DataFrame, classes: DataFrame, near: DataFrame, piece_rows: int) -> DataFrame:
    """Links that join exactly the nodes whose shingle sets have a similarity of 0.8 or more, directly or by way of others.

    ``near`` are further candidates.  A forest of candidates is verified first; then all candidates
    between what that left apart, so that a family of copies costs no pair of each two.  Nodes that share a
    shingle meet once for all the shingles that just they share; those of a hot shingle meet in pieces.
    """
    near = materialize(near, "near-fingerprints")
    shared = marked.select(F.explode("prefix").alias("h"), "node")
    buckets = map_arrow(shared.repartition("h").sortWithinPartitions("h"), _buckets, "key bigint, node bigint")
    buckets = materialize(buckets.union(marked.select(F.explode("hot").alias("key"), "node")).distinct(), "buckets")
    needed = buckets.select("node").union(near.select("a")).union(near.select("b")).distinct()
    sets = marked.filter("parity is not null").join(needed, "node", "left_semi").groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("n", *_PARITY, "parity", "within")])
    sets = materialize(sets, "candidate-sets")
    links = verified(_candidates(buckets, sets, None, piece_rows).union(near).distinct(), sets, classes, tagged, piece_rows)
    rest = verified(_candidates(buckets, sets, component_roots(links), piece_rows), sets, classes, tagged, piece_rows)
    return links.union(rest)


def one_of_each(docs: DataFrame, id_column: str = "doc_id", words: int = SHINGLE_WORDS, radius: int = RADIUS,
                blocks: int = BLOCKS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest id.

    Near-duplicates are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
    more, directly or by way of others; texts without words (or null) are alike.

    If several rows have that id, or all ids of a group are null, the row of the smallest
    (id, hash of the whole row) stays; of fully equal rows one stays.  All columns are kept.
    """
    ids = F.col(f"`{id_column}`")
    tagged = docs.select(F.struct("*").alias("row"), F.coalesce(ids.cast("string"), F.lit("")).alias("key"), ids.isNull().alias("no"),
                         F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not _has_map(docs, c)]).alias("rank"),
                         ids.alias("id"), F.col("text"))
    marked = materialize(_with_sets(tagged.select("id", "key", "no", "rank", "text"), words, *common_shingles(docs)), "fingerprints")
    first = F.struct("no", "id", "rank", "key")  # null ids come last
    classes = materialize(marked.groupBy("node").agg(F.min(first).alias("first")), "shingle-classes")
    prints = materialize(marked.select("fp", "node").distinct(), "fingerprint-nodes")
    one = materialize(prints.groupBy("fp").agg(F.min("node").alias("one")), "fingerprint-classes")
    near = fingerprint_links(one.select("fp"), radius, blocks, piece_rows)
    near = (near.join(one.select(F.col("fp").alias("a"), F.col("one").alias("x")), "a").join(one.select(F.col("fp").alias("b"), F.col("one").alias("y")), "b")
            .select("x", "y").union(prints.join(one, "fp").select("one", "node")))
    near = near.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    roots = component_roots(_similar_pairs(tagged, marked, classes, near, piece_rows))
    rooted = classes.join(roots, classes["node"] == roots["a"], "left").select("first", F.coalesce("root", "node").alias("root"))
    winners = known_size(rooted.groupBy("root").agg(F.min("first").alias("first"))
                         .select("first.key", "first.no", "first.rank"), "winners")
    # Only rows that aren't alone are exchanged: those of a node with several rows or with links.
    several = marked.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("node")
    together = several.union(roots.select("a")).union(roots.select("root")).distinct()
    whole = _with_mark(tagged.select("row", "key", "no", "rank"), _marks(marked.select("node", "rank").join(together, "node", "left_semi")))
    # Fully equal rows share (key, no, rank): one of them is taken, on the join's own partitioning.
    kept = whole.filter("marked").drop("marked").join(winners, ["key", "no", "rank"], "left_semi")
    kept = kept.groupBy("key", "no", "rank").agg(F.first("row").alias("row"))
    return whole.filter("not marked").select("row.*").union(kept.select("row.*"))


def _has_map(df: DataFrame, column: str) -> bool:
    return "map<" in df.schema[column].dataType.simpleString()
