"""Counting the boxes that each box meets, in groups of any size.

Boxes have few sizes, so those of one group and size are a plain set of points, in which a box asks for a
rectangle.  All points lie in blocks of bounded size in the order (group, size, x, y).  A rectangle's left and right
ends fall into two blocks, where it is counted exactly; of the blocks between, all points are between the ends.  If there are such
blocks, their points also lie in blocks in the order of y: the lower and upper ends are counted there, and of the blocks
between in both orders a table of counts is known.  A box is thus sent to a few blocks whatever its group's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import known_size, materialize, ship_package

BLOCK_ROWS = 32768
_CHUNK = 8  # boxes that a block meets in one task, in blocks

_SCHEMA = "block int, chunk int, kind int, g long, c int, x double, y double, n long, at int"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]

Batches = Iterator[pa.RecordBatch]
Arrays = dict[str, np.ndarray]


def _arrays(batch: pa.RecordBatch) -> Arrays:
    return {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Pairs as complex numbers, which numpy compares by the first part, then the second."""
    out = np.empty(len(first), dtype=np.complex128)
    out.real, out.imag = first, second
    return out


@dataclass(frozen=True)
class Cuts:
    """The first point of each block in the order of one axis; ``sizes`` are the boxes' extents along it, by size number."""

    axis: str
    sizes: np.ndarray
    g: np.ndarray
    c: np.ndarray
    at: np.ndarray

    def ends(self, c: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.sizes[c] / 2
        return at - half, at + half

    def set_of(self, g: np.ndarray, c: np.ndarray | int) -> np.ndarray:
        return g * len(self.sizes) + c

    def blocks(self, g: np.ndarray, own: np.ndarray, at: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
        """The blocks in which boxes' two ends fall among the points of size ``c``; -1 is before all."""
        low, high = self.ends(own, at)
        first_low, first_high = self.ends(self.c, self.at)
        sets, wanted = self.set_of(self.g, self.c), self.set_of(g, c)
        return (np.searchsorted(_pairs(sets, first_high), _pairs(wanted, low), "left") - 1,
                np.searchsorted(_pairs(sets, first_low), _pairs(wanted, high), "right") - 1)


class _Counter:
    """Points in order of index with weights: the weight of those from index l to r whose rank is below v, for many (l, r, v) at once.

    A wavelet matrix: per binary digit of the rank, from the highest, points with digit 0 move before the others.
    """

    def __init__(self, ranks: np.ndarray, weights: np.ndarray):
        self.levels = []
        for digit in range(int(len(ranks)).bit_length() - 1, -1, -1):
            zero = ranks >> digit & 1 == 0
            order = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
            ranks, weights = ranks[order], weights[order]
            self.levels.append((digit, np.concatenate([[0], np.cumsum(zero)]).astype(np.int32), np.concatenate([[0], np.cumsum(weights)])))

    def below(self, l: np.ndarray, r: np.ndarray, v: np.ndarray) -> np.ndarray:  # noqa: E741
        found = np.zeros(len(l), dtype=np.int64)
        for digit, zeros, weight in self.levels:
            l0, r0, one = zeros[l], zeros[r], v >> digit & 1 == 1
            found += np.where(one, weight[r0] - weight[l0], 0)
            l, r = np.where(one, zeros[-1] + l - l0, l0), np.where(one, zeros[-1] + r - r0, r0)  # noqa: E741
        return found


class _Block:
    """The points of a block, by index in the order of ``cuts`` and by rank in the order of the other axis (or of blocks of x)."""

    def __init__(self, points: Arrays, cuts: Cuts, across: Cuts, in_blocks: bool):
        self.cuts, self.across, self.in_blocks = cuts, across, in_blocks
        order = np.lexsort((points[cuts.axis], points["c"], points["g"]))
        p = {k: v[order] for k, v in points.items()}
        sets = cuts.set_of(p["g"], p["c"])
        self.low, self.high = (_pairs(sets, e) for e in cuts.ends(p["c"], p[cuts.axis]))
        by = p["at"] if in_blocks else _pairs(p["c"], p[across.axis])
        order = np.argsort(by, kind="stable")
        ranks = np.empty(len(order), dtype=np.int64)
        ranks[order] = np.arange(len(order))
        if in_blocks:
            self.across_low = self.across_high = by[order]
        else:
            self.across_low, self.across_high = (_pairs(p["c"], e)[order] for e in across.ends(p["c"], p[across.axis]))
        self.counter = _Counter(ranks, p["n"])

    def count(self, q: Arrays) -> np.ndarray:
        """What each box meets, of the sizes in its ``n`` (a digit for each)."""
        found = np.zeros(len(q["g"]), dtype=np.int64)
        for c in range(len(self.cuts.sizes)):
            i = np.flatnonzero(q["n"] >> c & 1)
            g, own, at = q["g"][i], q["c"][i], q[self.cuts.axis][i]
            low, high = (_pairs(self.cuts.set_of(g, c), e) for e in self.cuts.ends(own, at))
            left, right = np.searchsorted(self.high, low, "left"), np.searchsorted(self.low, high, "right")
            if self.in_blocks:
                first, last = self.across.blocks(g, own, q[self.across.axis][i], c)
                first, last = first + 1, last - 1
            else:
                first, last = (_pairs(np.full(len(i), c), e) for e in self.across.ends(own, q[self.across.axis][i]))
            lower, upper = np.searchsorted(self.across_high, first, "left"), np.searchsorted(self.across_low, last, "right")
            found[i] = found[i] + self.counter.below(left, right, np.maximum(lower, upper)) - self.counter.below(left, right, lower)
        return found


def _wide(cuts: Cuts) -> np.ndarray:
    """Sets that may have whole blocks between two ends: those in which two blocks begin."""
    sets, n = np.unique(cuts.set_of(cuts.g, cuts.c), return_counts=True)
    return sets[n > 1]


def _asked(p: Arrays, cuts: Cuts, between: Cuts | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(box, block, sizes to count there); only boxes with whole blocks of ``between`` if that is given."""
    boxes, blocks, of = [], [], []
    for c in range(len(cuts.sizes)):
        first, last = cuts.blocks(p["g"], p["c"], p[cuts.axis], c)
        some = np.ones(len(first), dtype=bool)
        if between is not None:
            low, high = between.blocks(p["g"], p["c"], p[between.axis], c)
            some = high - low > 1
        for block, here in ((first, some & (first >= 0)), (last, some & (last > first))):
            boxes.append(np.flatnonzero(here))
            blocks.append(block[here])
            of.append(np.full(len(boxes[-1]), 1 << c))
    keys, place = np.unique(np.concatenate(blocks).astype(np.int64) * len(p["g"]) + np.concatenate(boxes), return_inverse=True)
    sizes = np.zeros(len(keys), dtype=np.int64)
    np.bitwise_or.at(sizes, place, np.concatenate(of))
    return keys % len(p["g"]), keys // len(p["g"]), sizes


def _rows(p: Arrays, taken: np.ndarray, **own: np.ndarray | int) -> pa.RecordBatch:
    made = {"g": p["g"][taken], "c": p["c"][taken], "x": p["x"][taken], "y": p["y"][taken]}
    made |= {k: v if isinstance(v, np.ndarray) else np.full(len(taken), v) for k, v in own.items()}
    kinds = {"block": pa.int32(), "chunk": pa.int32(), "kind": pa.int32(), "c": pa.int32(), "at": pa.int32(), "g": pa.int64(), "n": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(made[k], kinds.get(k, pa.float64())) for k in _NAMES], _NAMES)


def _count_asked(cuts: Cuts, between: Cuts | None) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        n = np.zeros(len(cuts.g), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                n += np.bincount(_asked(_arrays(batch), cuts, between)[1], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["block", "n"])

    return run


def _send(cuts: Cuts, between: Cuts | None, chunks: np.ndarray, own: str) -> Callable[[Batches], Batches]:
    """Points to their block (column ``own``, -1 for those that only ask) and boxes to the blocks of their ends."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = _arrays(batch)
            points = np.flatnonzero(p[own] >= 0)
            times = chunks[p[own][points]]
            taken = np.repeat(points, times)
            chunk = np.arange(len(taken)) - np.repeat(np.cumsum(times) - times, times)
            yield _rows(p, taken, block=p[own][taken], chunk=chunk, kind=0, n=p["copies"][taken], at=p["part"][taken])
            box, block, sizes = _asked(p, cuts, between)
            yield _rows(p, box, block=block, chunk=np.arange(len(box)) % chunks[block], kind=1, n=sizes, at=0)

    return run


def _meet(cuts: Cuts, across: Cuts, in_blocks: bool) -> Callable[[Batches], Batches]:
    """Rows sorted by (block, chunk, kind): a block's points come first and stay, its boxes stream by."""
    def run(batches: Batches) -> Batches:
        group, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _arrays(batch)
            marks = np.column_stack([rows[k] for k in ("block", "chunk", "kind")])
            edges = np.concatenate([[0], np.flatnonzero((np.diff(marks, axis=0) != 0).any(axis=1)) + 1, [len(marks)]])
            for s, e in zip(edges, edges[1:], strict=False):
                part = {k: v[s:e] for k, v in rows.items()}
                if tuple(marks[s, :2]) != group:
                    group, held, block = tuple(marks[s, :2]), [], None
                if not marks[s, 2]:
                    held.append(part)
                    continue
                if block is None:
                    if not held:
                        continue
                    block = _Block({k: np.concatenate([h[k] for h in held]) for k in _NAMES}, cuts, across, in_blocks)
                    held = []
                found = block.count(part)
                some = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(part[k][some]) for k in ("g", "c", "x", "y")] + [pa.array(found[some])], ["g", "c", "x", "y", "met"])

    return run


def _between(by_x: Cuts, by_y: Cuts, table: np.ndarray) -> Callable[[Batches], Batches]:
    """What boxes meet in blocks that lie between their ends in both orders, from running sums over both."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = _arrays(batch)
            found = np.zeros(batch.num_rows, dtype=np.int64)
            for c in range(len(by_x.sizes)):
                left, right = by_x.blocks(p["g"], p["c"], p["x"], c)
                low, high = by_y.blocks(p["g"], p["c"], p["y"], c)
                i = np.flatnonzero((right - left > 1) & (high - low > 1))
                left, right, low, high = left[i] + 1, right[i], low[i] + 1, high[i]
                found[i] += table[right, high] - table[left, high] - table[right, low] + table[left, low]
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(p[k][some]) for k in ("g", "c", "x", "y")] + [pa.array(found[some])], ["g", "c", "x", "y", "met"])

    return run


_MET = "g long, c int, x double, y double, met long"


def _placed(points: DataFrame, order: Sequence[str], blocks: int, part: str) -> DataFrame:
    """Points in ranges of an order, written once; sampled bounds make the ranges nearly equal."""
    return materialize(points.repartitionByRange(blocks, *order).withColumn(part, F.spark_partition_id()), "box-blocks")


def _cuts(placed: DataFrame, part: str, order: Sequence[str], axis: str, sizes: Sequence[float], blocks: int) -> Cuts:
    """A row per block comes to the driver; an empty range begins where the one behind it does."""
    found = {r[part]: r.first for r in placed.groupBy(part).agg(F.min(F.struct(*order)).alias("first")).collect()}
    last, firsts = None, []
    for b in range(blocks - 1, -1, -1):
        last = found.get(b, last)
        firsts.append(last or (2 ** 50, 0, np.inf, np.inf))
    g, c, at = (np.array(v) for v in list(zip(*firsts[::-1], strict=True))[:3])
    return Cuts(axis, np.asarray(sizes, dtype=float), g.astype(np.int64), c.astype(np.int64), at.astype(float))


def _pass(sent: DataFrame, cuts: Cuts, across: Cuts, own: str, rows: int, in_blocks: bool) -> DataFrame:
    between = across if in_blocks else None
    chunks = np.ones(len(cuts.g), dtype=np.int64)
    for r in sent.mapInArrow(_count_asked(cuts, between), "block int, n long").groupBy("block").agg(F.sum("n").alias("n")).collect():
        chunks[r.block] = -(-r.n // (_CHUNK * rows))
    routed = sent.mapInArrow(_send(cuts, between, chunks, own), _SCHEMA)
    return routed.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "kind").mapInArrow(_meet(cuts, across, in_blocks), _MET)


def boxes_met(points: DataFrame, sizes: Sequence[tuple[float, float]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``g, c, x, y, met``: the copies of boxes of its group that each box meets, itself included; touching edges meet (runs jobs).

    ``points`` (written) has distinct ``g`` (long), ``c`` (int, the place in ``sizes``), ``x``, ``y`` (doubles, the centre, not null or NaN) and ``copies``.
    A block has about ``block_rows`` points or the number of points to the power 2/3 if that is more, so blocks
    are few enough for a table of all their pairs.
    """
    ship_package(points.sparkSession)
    n = points.count()
    rows = max(block_rows, int(n ** (2 / 3)))
    blocks = max(1, -(-n // rows))
    by_x, by_y = ["g", "c", "x", "y"], ["g", "c", "y", "x"]
    placed = _placed(points, by_x, blocks, "part")
    x = _cuts(placed, "part", by_x, "x", [w for w, _ in sizes], blocks)
    y = Cuts("y", np.array([h for _, h in sizes], dtype=float), *(np.zeros(0, dtype=np.int64),) * 3)
    met = _pass(placed, x, y, "part", rows, False)
    wide = _wide(x).tolist()
    if wide:
        sets = known_size(points.sparkSession.createDataFrame([(s // len(sizes), s % len(sizes)) for s in wide], "g long, c int"), "wide-sets")
        crowded = _placed(placed.join(sets, ["g", "c"], "left_semi"), by_y, blocks, "row")
        y = _cuts(crowded, "row", by_y, "y", y.sizes, blocks)
        others = placed.join(sets.select("g").distinct(), "g", "left_semi").join(sets, ["g", "c"], "left_anti")
        asking = crowded.unionByName(others.withColumn("row", F.lit(-1)))
        table = np.zeros((blocks + 1, blocks + 1), dtype=np.int64)
        for r in crowded.groupBy("part", "row").agg(F.sum("copies").alias("n")).collect():
            table[r.part + 1, r.row + 1] = r.n
        table = table.cumsum(axis=0).cumsum(axis=1)
        met = met.union(_pass(asking, y, x, "row", rows, True)).union(asking.mapInArrow(_between(x, y, table), _MET))
    return met.groupBy("g", "c", "x", "y").agg(F.sum("met").alias("met"))
